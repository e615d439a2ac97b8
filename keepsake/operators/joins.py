"""Joins that spread the rows without a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def left_join_set(rows: DataFrame, key: Column, right: DataFrame, right_key: str,
                  only: Column | None = None) -> DataFrame:
    """``rows`` left-joined with ``right`` on a text key, one join over one
    reading of ``rows``. Rows whose key is blank (or that fail ``only``) cannot
    match: a key of their own, NUL and a hash of the row, deals them over all
    tasks, so the rows without a path never meet in one."""
    use = ~F.coalesce(S.blank(key), F.lit(True))
    if only is not None:
        use = use & F.coalesce(only, F.lit(False))
    plain = [F.col(f"`{f.name}`") for f in rows.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    nobody = F.concat(F.lit("\0"), F.xxhash64(*plain).cast("string"))
    keyed = rows.withColumn("_join_key", F.when(use, key).otherwise(nobody))
    return keyed.join(right, F.col("_join_key") == F.col(right_key), "left").drop("_join_key")
