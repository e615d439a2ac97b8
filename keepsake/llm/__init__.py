"""Operators of a large-scale training-data pipeline, and their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
