"""Capture-time back-fill and the tag CSV for the metadata writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from .joins import left_join_set

TAG_COLUMNS = ["SourceFile", "DateTimeOriginal", "CreateDate", "ModifyDate",
               "MediaCreateDate", "TrackCreateDate"]


def sibling_extensions(pending: DataFrame, files: DataFrame) -> DataFrame:
    """For sidecar paths (``_jp``), the extension of the first other file
    in the same folder named ``<sidecar stem>.<anything>`` (``.json`` files
    excluded), by path order. Each candidate file is exploded into its
    dot-prefixes, so the match is an equi join on ``(folder, prefix)``."""
    f = files.select(F.col("path").alias("_fp"))
    f = f.select("_fp", P.parent("_fp").alias("_dir"), P.basename("_fp").alias("_nm"))
    f = f.where(~F.lower("_nm").endswith(".json"))
    # every prefix of the name that ends just before a '.'
    f = f.select("_fp", "_dir", "_nm", F.posexplode(F.split("_nm", r"\.")).alias("_i", "_part"))
    f = f.where(F.col("_i") > 0).select(
        "_fp", "_dir", "_nm",
        F.array_join(F.slice(F.split("_nm", r"\."), 1, F.col("_i")), ".").alias("_prefix"))
    p = pending.select("_jp", P.parent("_jp").alias("_dir"), P.stem(P.basename("_jp")).alias("_prefix")).distinct()
    j = p.join(f, ["_dir", "_prefix"])
    return j.groupBy("_jp").agg(F.min_by(P.lower_suffix("_nm"), F.col("_fp")).alias("_sib_ext"))


def backfill_timestamps(manifest: DataFrame, sidecars: DataFrame, files: DataFrame | None = None,
                        retry_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fill ``timestamp_unix`` / ``formatted_time`` of matched rows that
    have none from their sidecar; when ``new_ext`` is blank also fill it
    (media suffix, else a sibling file's suffix). ``sidecars``: the files
    present now, ``path`` + ``content`` (JSON text). Rows whose sidecar is
    missing are left alone; a sidecar without a usable time (0) too.
    ``files`` (``path``): where siblings are looked up, by default the
    sidecars' own listing. ``retry_zero``: rows that hold time 0, as an
    unreadable sidecar leaves behind, are pending like rows without a time.
    Report: ``row_id, timestamp_unix, formatted_time, new_ext`` of updated rows."""
    from ..schema import ensure_columns, require_columns
    manifest = ensure_columns(manifest, ["new_ext"])
    require_columns(manifest, ["timestamp_unix", "formatted_time", "row_type", "json_path"])
    untimed = F.col("timestamp_unix").isNull()
    if retry_zero:
        untimed = untimed | (F.col("timestamp_unix") == 0)
    pend = untimed & (F.lower(F.trim(F.coalesce("row_type", F.lit("")))) == "matched")
    m = manifest.withColumn("_pend", pend).withColumn("_jp", P.strip_ws(F.coalesce("json_path", F.lit(""))))
    # the time is read where the text is: eight bytes a sidecar are shuffled
    docs = sidecars.select(F.col("path").alias("_doc_path"), S.json_timestamp(F.col("content")).alias("_ts"))
    m = left_join_set(m, F.col("_jp"), docs, "_doc_path", only=F.col("_pend"))
    ts = F.col("_ts")
    upd = F.col("_pend") & F.coalesce(ts != 0, F.lit(False))
    sib = sibling_extensions(m.where(upd & S.blank("new_ext") & S.blank("media_path")),
                             sidecars if files is None else files)
    m = left_join_set(m, F.col("_jp"), sib.withColumnRenamed("_jp", "_sib_path"), "_sib_path", only=upd)
    ext = F.when(S.nonblank("media_path"), P.lower_suffix(P.basename(P.strip_ws("media_path")))) \
        .otherwise(F.coalesce(F.col("_sib_ext"), F.lit("")))
    out = (m.withColumn("_upd", upd)
           .withColumn("timestamp_unix", F.when(upd, ts).otherwise(F.col("timestamp_unix")))
           .withColumn("formatted_time", F.when(upd, S.format_unix(ts)).otherwise(F.col("formatted_time")))
           .withColumn("new_ext", F.when(upd & S.blank("new_ext"), ext).otherwise(F.col("new_ext"))))
    report = out.where("_upd").select("row_id", "timestamp_unix", "formatted_time", "new_ext")
    return out.select(*manifest.columns), report


def tag_csv(manifest: DataFrame) -> DataFrame:
    """Rows for the metadata writer: JPEGs get the three EXIF dates, every
    other file the two QuickTime dates; every manifest row is emitted."""
    src = F.coalesce(F.col("media_path"), F.lit(""))
    t = F.coalesce(F.col("formatted_time"), F.lit(""))
    jpeg = P.lower_suffix(P.basename(src)).isin(".jpg", ".jpeg")
    exif = F.when(jpeg, t).otherwise(F.lit(""))
    qt = F.when(jpeg, F.lit("")).otherwise(t)
    return manifest.select(src.alias("SourceFile"), exif.alias("DateTimeOriginal"),
                           exif.alias("CreateDate"), exif.alias("ModifyDate"),
                           qt.alias("MediaCreateDate"), qt.alias("TrackCreateDate"))
