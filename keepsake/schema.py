"""Manifest schema: the table every stage reads and widens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Base columns, in the order a freshly built manifest has them.
BASE_COLUMNS = ["row_type", "json_filename", "json_path", "original_media",
                "media_path", "corrected_path", "timestamp_unix",
                "formatted_time", "new_ext", "action_taken", "notes"]
# Added by the deduplication stage, then by the deletion stage.
DEDUP_COLUMNS = ["content_sha1", "phash64", "hash_mtime", "duration",
                 "dedup_group_id", "delete_flag", "dedup_reason",
                 "visual_review_path", "duplicate_of"]
DELETION_COLUMNS = ["deletion_status"]

TYPED = {
    "row_id": T.LongType(),
    "timestamp_unix": T.LongType(),
    "hash_mtime": T.LongType(),
    "duration": T.DoubleType(),
}


def ensure_columns(df: DataFrame, columns) -> DataFrame:
    """Add missing columns as '' (strings) or null (typed), keep order."""
    for c in columns:
        if c not in df.columns:
            t = TYPED.get(c, T.StringType())
            df = df.withColumn(c, F.lit("" if t == T.StringType() else None).cast(t))
    return df


def require_columns(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"manifest is missing column(s): {', '.join(missing)}")
