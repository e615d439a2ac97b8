"""Manifest CSV at the edges: read (header, quoted multi-line cells, every
cell a string, empty = '') and write (stable, widening header)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BASE_COLUMNS, DEDUP_COLUMNS, DELETION_COLUMNS, TYPED

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "encoding": "UTF-8", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}


def read_manifest(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """Read a manifest CSV. Every column is read as text and missing cells
    become ''; with ``typed`` the numeric columns (``row_id``,
    ``timestamp_unix``, ...) are cast, '' -> null."""
    df = spark.read.options(**CSV_OPTIONS).option("inferSchema", "false").csv(path)
    df = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])
    if typed:
        for c, t in TYPED.items():
            if c in df.columns:
                df = df.withColumn(c, F.when(F.trim(c) != "", F.trim(c).try_cast(t)))
    return df


def column_order(original: Sequence[str], df: DataFrame) -> list[str]:
    """Original header first, then columns not seen before (first-seen order)."""
    return list(original) + [c for c in df.columns if c not in original]


def write_manifest(df: DataFrame, path: str, original_header: Sequence[str] | None = None,
                   single_file: bool = False) -> None:
    """Write a manifest as CSV under ``path`` (a new directory; Spark's
    committer makes the swap atomic). Cells are written verbatim: no
    trimming, empty and null both as ''."""
    order = column_order(original_header or [c for c in df.columns], df)
    out = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in order])
    if single_file:
        out = out.coalesce(1)
    (out.write.mode("errorifexists").options(**CSV_OPTIONS)
     .option("emptyValue", "").option("nullValue", "").csv(path))


STANDARD_ORDER = ["row_id"] + BASE_COLUMNS + DEDUP_COLUMNS + DELETION_COLUMNS
