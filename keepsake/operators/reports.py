"""Reports: file types, conversion markers, run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S


def file_types(manifest: DataFrame, column: str = "new_ext") -> DataFrame:
    """Distinct extensions (dot added, lower-cased before de-duplication;
    blanks ignored) with their class and row count:
    ``ext, file_class, n_rows``."""
    from ..schema import require_columns
    require_columns(manifest, [column])
    e = S.normalised_ext(F.trim(F.col(column)))
    return (manifest.where(S.nonblank(column))
            .groupBy(e.alias("ext")).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("file_class", S.ext_class("ext")))


def file_type_lists(manifest: DataFrame, column: str = "new_ext") -> DataFrame:
    """One row per class with its sorted extension list (the summary)."""
    ft = file_types(manifest, column)
    return ft.groupBy("file_class").agg(
        F.array_join(F.sort_array(F.collect_list("ext")), ", ").alias("extensions"),
        F.count(F.lit(1)).alias("n_extensions"))


def rows_matching(df: DataFrame, pattern: str = K.CONVERSION_MARKER_RE) -> DataFrame:
    """Rows where any cell matches ``pattern``."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return df.where(F.exists(cells, lambda x: x.rlike(pattern)))


def count_matching_rows(df: DataFrame, pattern: str = K.CONVERSION_MARKER_RE) -> DataFrame:
    return rows_matching(df, pattern).agg(F.count(F.lit(1)).alias("n_rows"))


def notes_count(manifest: DataFrame) -> DataFrame:
    """Rows with a non-empty note (what the conversion log counts)."""
    return manifest.agg(F.count_if(F.coalesce(F.col("notes"), F.lit("")) != "").alias("n_rows"))


def conversion_failures(manifest: DataFrame, failed: DataFrame) -> DataFrame:
    """The manifest rows whose conversion failed, apart from what their notes
    say (notes also record recoveries and missing partners): ``row_id,
    media_path, reason, noted``. ``failed``: ``path, reason``; of several
    reasons for a path the first by text order is given."""
    why = failed.groupBy(F.col("path").alias("_failed")).agg(F.min("reason").alias("reason"))
    return manifest.join(why, F.col("media_path") == F.col("_failed")).select(
        "row_id", "media_path", "reason", F.coalesce(S.nonblank("notes"), F.lit(False)).alias("noted"))
