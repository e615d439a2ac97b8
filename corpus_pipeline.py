"""A training-data pipeline over ``documents``: each stage calls one operator.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents, extra ones too.

Every stage takes an empty table (no rows come out), null ids, null, empty and
very long texts, and repeated rows, which it judges alike; what it does with
them stands at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import bpe, langid, mixing, simhash, toxicity
from keepsake.llm.common import table, written

#: No SQL expresses the trained stages; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects (score >= 0.5) go. Null and
    empty texts score as texts without offence; without labels of both kinds
    among the documents nothing is rejected; repeated rows go or stay together."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    return scored.where(F.col("toxic_score") < 0.5).select("row.*")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too) or below a calibrated
    threshold of language ID go; without a labelled document all go, as nothing
    can be identified; repeated rows go or stay together."""
    model = langid.train(docs)
    named = langid.identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    return named.where("lang_accepted").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id.
    Texts without words have fingerprint zero and are one group; of rows
    repeating an id one stays; rows without an id link nothing and stay."""
    return simhash.keep_one(docs, simhash.simhash_groups(docs, shingle=4, max_bits=4))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; a null source is
    a source of its own, and documents without words take no part of a budget."""
    return mixing.repeat_rows(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, encoded and decoded, as digests; a null text is an
    empty one. Repeated rows are encoded alike."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language_id", keep_identified), ("simhash", drop_near_copies),
          ("mixing", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
