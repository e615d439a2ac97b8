"""Manifest editors. Each returns ``(new_manifest, report)``; a dry run is
"use only the report". Existence checks are joins with a file inventory
(``path`` column), never per-row file-system calls."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import paths as P
from ..functions import scalars as S
from .joins import left_join_set

PATH_COLUMNS_WSL = ["media_path", "json_path", "corrected_path", "visual_review_path", "duplicate_of"]
PATH_COLUMNS_AUDIT = ["json_path", "media_path", "corrected_path"]


def _text(df: DataFrame, col: str):
    """A column as text; a missing column reads as ''."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")) if col in df.columns else F.lit("")


def remove_rows(df: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Drop rows whose ``key`` (trimmed, lower-cased) equals ``value``
    (lower-cased). Report: the removed rows."""
    hit = F.lower(F.trim(_text(df, key))) == value.lower()
    return df.where(~hit), df.where(hit)


def clear_column(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Blank a column. Report: ``row_id, column, old_value`` of the cells
    that were not blank."""
    if key not in df.columns:
        return df, df.sparkSession.createDataFrame([], "row_id long, column_name string, old_value string")
    old = F.col(key).cast("string")
    report = df.where(S.nonblank(old)).select(
        "row_id", F.lit(key).alias("column_name"), old.alias("old_value"))
    t = df.schema[key].dataType
    blank = F.lit("") if t.simpleString() == "string" else F.lit(None).cast(t)
    return df.withColumn(key, blank), report


def _exists(df: DataFrame, col: str, existing: DataFrame, flag: str) -> DataFrame:
    ex = existing.select(F.col("path").alias(f"_{flag}_p")).distinct()
    return (left_join_set(df, P.to_local_path(col), ex, f"_{flag}_p")
            .withColumn(flag, F.col(f"_{flag}_p").isNotNull()).drop(f"_{flag}_p"))


def prune_missing(df: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop rows whose media or sidecar path is set but missing; rows with
    either path blank are kept. Report: the removed rows."""
    both = S.nonblank("media_path") & S.nonblank("json_path")
    j = _exists(_exists(df, "media_path", existing, "_m_ok"), "json_path", existing, "_j_ok")
    drop = both & ~(F.col("_m_ok") & F.col("_j_ok"))
    kept = j.where(~drop).select(*df.columns)
    return kept, j.where(drop).select(*df.columns)


def invalid_paths(df: DataFrame, existing: DataFrame,
                  columns: Sequence[str] = PATH_COLUMNS_AUDIT) -> DataFrame:
    """Path audit of non-quarantined rows: ``row_id, column_name, path`` for
    every set path (trimmed) that is not in ``existing``."""
    rows = df.where(~F.lower(F.coalesce("row_type", F.lit(""))).contains("unmatched"))
    cols = [c for c in columns if c in df.columns]
    long = rows.select("row_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), P.strip_ws(F.col(c)).alias("path")) for c in cols
    ])).alias("x")).select("row_id", "x.column_name", "x.path").where(F.col("path") != "")
    ex = existing.select(F.col("path").alias("_ex")).distinct()
    return long.join(ex, F.col("path") == F.col("_ex"), "left_anti")


def windows_to_posix(df: DataFrame, columns: Sequence[str] = PATH_COLUMNS_WSL) -> tuple[DataFrame, DataFrame]:
    """Rewrite drive-letter paths of the listed columns (those present) to
    ``/mnt/<drive>/...``. Report: ``row_id, column_name, old_value, new_value``."""
    cols = [c for c in columns if c in df.columns]
    out = df
    for c in cols:
        out = out.withColumn(c, P.windows_to_posix(F.col(c)))
    changes = df.select("row_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("old_value"),
                 P.windows_to_posix(F.col(c)).alias("new_value")) for c in cols
    ])).alias("x")).select("row_id", "x.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return out, changes


def quarantine_unmatched(df: DataFrame, processing_root: str) -> tuple[DataFrame, DataFrame]:
    """Point unmatched rows at their quarantine location: media and
    corrected paths of ``unmatched_media`` rows under ``__UNMATCHED_MEDIA__``,
    the sidecar path of ``unmatched_json`` rows under ``__UNMATCHED_JSON__``.
    A note ``<col> updated to <path>`` is appended per changed column.
    Report: the changed rows (new values)."""
    rt = F.lower(F.coalesce("row_type", F.lit("")))
    media_root = processing_root.rstrip("/") + "/" + K.UNMATCHED_MEDIA_DIR
    json_root = processing_root.rstrip("/") + "/" + K.UNMATCHED_JSON_DIR
    plan = [("media_path", rt.contains("unmatched_media"), media_root),
            ("corrected_path", rt.contains("unmatched_media"), media_root),
            ("json_path", rt.contains("unmatched_json"), json_root)]
    out = df
    for col, cond, root in plan:
        old = P.strip_ws(F.coalesce(F.col(col), F.lit("")))
        new = P.quarantine_path(old, root)
        out = out.withColumn(f"_new_{col}", F.when(cond & new.isNotNull() & (new != old), new))
    # notes are fixed before the path columns are overwritten
    out = out.withColumn("_joined", F.concat_ws("; ", *[
        F.when(F.col(f"_new_{c}").isNotNull(), F.concat(F.lit(c + K.NOTE_PATH_UPDATED), F.col(f"_new_{c}")))
        for c, _, _ in plan]))
    prev = F.coalesce(F.trim("notes"), F.lit(""))
    combined = F.regexp_replace(F.concat(prev, F.lit("; "), F.col("_joined")), r"^[; ]+|[; ]+$", "")
    out = out.withColumn("_changed", F.col("_joined") != "") \
             .withColumn("notes", F.when(F.col("_changed"), combined).otherwise(F.col("notes")))
    for col, _, _ in plan:
        out = out.withColumn(col, F.coalesce(F.col(f"_new_{col}"), F.col(col)))
    report = out.where("_changed").select(*df.columns)
    return out.select(*df.columns), report
