"""keepsake: curation of very large exported photo/video archives on Spark.

Every operator is a ``DataFrame -> DataFrame`` function (editors return a
``(new_df, report_df)`` pair) built from Spark SQL / DataFrame primitives.
"""

__version__ = "0.1.0"
