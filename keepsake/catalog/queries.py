"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each composes library operators over archive-shaped data that Spark derives
from the driver tables (see ``fixtures``); the oracle SQL for the same name
lives in ``oracle.py``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import constants as K
from ..functions import paths as P
from ..operators import dedup as D
from ..operators import edits as E
from ..operators import reports as R
from ..operators import recovery as RC
from ..operators import search as SR
from ..operators import similarity as SIM
from ..operators import timestamps as T
from ..plans import actions as A
from ..operators import pixels as PX
from ..sources import archives as ARC
from ..sources import files as SRC
from ..sources import manifest_csv as CSV
from ..sources import texts as TX
from ..sources.sinks import record_events, row_events, write_times_csv
from . import filesets as FS
from ..operators import pairing
from ..operators.joins import left_join_set
from ..functions import scalars as S
from ..schema import ensure_columns
from . import fixtures as X
from .stages import stage

ORDER = ("archive", "name", "file_id")


def _spread(df: DataFrame) -> DataFrame:
    """Derived inputs are written as stage tables spread over all cores
    (the driver tables are single-row-group files, read by one task)."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def inventory(spark, sf_dir):
    return stage(spark, sf_dir, "inventory", lambda: _spread(X.inventory(spark, sf_dir)))


def inventory_now(spark, sf_dir):
    return stage(spark, sf_dir, "inventory_now", lambda: X.inventory_now(inventory(spark, sf_dir)))


def fingerprints(spark, sf_dir):
    return stage(spark, sf_dir, "fingerprints", lambda: X.fingerprints(inventory(spark, sf_dir)))


def similarity_manifest(spark, sf_dir):
    return stage(spark, sf_dir, "similarity_manifest", lambda: _spread(X.similarity_manifest(spark, sf_dir)))


def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.configure(spark)
    return pairing.build_manifest(inventory(spark, sf_dir), ORDER)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest stage table (built once per session and input)."""
    session.configure(spark)
    return stage(spark, sf_dir, "manifest", lambda: build_manifest(spark, sf_dir))


def fingerprinted_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest plus the hashing stage's columns (fingerprints by path)."""
    m = manifest(spark, sf_dir)
    fp = fingerprints(spark, sf_dir).select(
        F.col("path").alias("_fp_path"), "content_sha1", "phash64", F.col("mtime").alias("hash_mtime"))
    out = left_join_set(m, F.col("media_path"), fp, "_fp_path")
    out = out.withColumn("content_sha1", F.coalesce("content_sha1", F.lit(""))) \
             .withColumn("phash64", F.coalesce("phash64", F.lit("")))
    return ensure_columns(out.select(*m.columns, "content_sha1", "phash64", "hash_mtime"),
                          D.VERDICT_COLUMNS)


def deduped_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduplication stage table."""
    return stage(spark, sf_dir, "deduped",
                 lambda: D.deduplicate(fingerprinted_manifest(spark, sf_dir)))


def first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduplication stage table with the status of the deletions after it
    (a second run reads it for its groups and for the rows they are written to)."""
    return stage(spark, sf_dir, "first_run",
                 lambda: D.deletion_status(deduped_manifest(spark, sf_dir), inventory_now(spark, sf_dir)))


# ---------------------------------------------------------------- queries

def q_pair_sidecars(spark, sf_dir):
    session.configure(spark)
    return pairing.pair_sidecars(inventory(spark, sf_dir), ORDER).select(
        "json_path", "json_name", "media_path", "media_name", "year_folder")


def q_pair_sidecars_same_archive(spark, sf_dir):
    """Pairing with both options: inside each archive first, bare sidecars too."""
    return pairing.pair_sidecars(inventory(spark, sf_dir), ORDER, prefer_same_archive=True, allow_bare=True).select(
        "json_path", "json_name", "media_path", "media_name", "year_folder")


def q_manifest_build(spark, sf_dir):
    return build_manifest(spark, sf_dir)


def q_dedup_verdicts(spark, sf_dir):
    d = D.deduplicate(fingerprinted_manifest(spark, sf_dir))
    return d.where(F.col("dedup_group_id") != "").select(
        "row_id", "media_path", "dedup_group_id", "delete_flag", "duplicate_of",
        "dedup_reason", "visual_review_path")


def stale_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest after a second deduplication run: the first run's flagged
    copies were deleted (where present), the re-run groups only live rows
    and overwrites only the rows it groups; rows it no longer groups keep
    their first-run verdicts (group numbers get reused)."""
    def build():
        first = first_run(spark, sf_dir)
        live = first.where(~S.flag_is("deletion_status", "deleted"))
        return D.apply_verdicts(first, D.dedup_verdicts(live))
    return stage(spark, sf_dir, "stale", build)


def q_dedup_groups(spark, sf_dir):
    per_path = D.last_row_per_path(D.dedup_candidates(fingerprinted_manifest(spark, sf_dir)))
    g = D.duplicate_groups(per_path)
    return g.select("dedup_group_id", "n_members", "first_row_id", "keeper_path", "keeper_media")


def q_dedup_last_row_per_path(spark, sf_dir):
    m = fingerprinted_manifest(spark, sf_dir)
    # the same listing appended again by a re-scan that lost the sidecar names
    rescan = (m.where(F.col("row_type") == "matched")
              .withColumn("row_id", F.col("row_id") + m.agg(F.max("row_id")).first()[0])
              .withColumn("json_filename", F.lit("")))
    per_path = D.last_row_per_path(D.dedup_candidates(m.unionByName(rescan)))
    return per_path.select("media_path", "first_row_id", "last_row_id", "original_media", "json_filename")


def q_dedup_multi_keeper(spark, sf_dir):
    return D.multi_keeper_groups(stale_manifest(spark, sf_dir))


def q_dedup_fix_groups(spark, sf_dir):
    return D.fix_groups(stale_manifest(spark, sf_dir))


def q_dedup_verify_issues(spark, sf_dir):
    return D.verify_groups(stale_manifest(spark, sf_dir))


def q_dedup_deletion_plan(spark, sf_dir):
    return D.deletion_plan(deduped_manifest(spark, sf_dir), inventory_now(spark, sf_dir))


def q_dedup_review_paths(spark, sf_dir):
    d = deduped_manifest(spark, sf_dir)
    return d.where(F.col("dedup_group_id") != "").select(
        "dedup_group_id", F.lit("copy").alias("op"), F.col("media_path").alias("src"),
        F.col("visual_review_path").alias("dst"))


def q_fingerprint_cache_misses(spark, sf_dir):
    return D.fingerprint_cache_misses(fingerprinted_manifest(spark, sf_dir),
                                      inventory_now(spark, sf_dir))


def sidecars_now(spark, sf_dir):
    inv = inventory_now(spark, sf_dir)
    return inv.where(F.col("origin") == "sidecar").select("path", "content")


def q_dedup_reset(spark, sf_dir):
    """The second deduplication run of the stale manifest with ``reset``: rows
    that it no longer groups lose the first run's verdicts."""
    first = first_run(spark, sf_dir)
    live = first.where(~S.flag_is("deletion_status", "deleted"))
    return D.apply_verdicts(first, D.dedup_verdicts(live), reset=True).select(
        "row_id", "media_path", "dedup_group_id", "delete_flag", "duplicate_of", "deletion_status")


def q_timestamps_from_json(spark, sf_dir):
    session.configure(spark)
    sc = X.sidecar_files(spark, sf_dir)
    ts = S.json_timestamp(F.col("content"))
    return sc.select("path", ts.alias("timestamp_unix"), S.format_unix(ts).alias("formatted_time"))


def q_backfill_timestamps(spark, sf_dir):
    m = manifest(spark, sf_dir)
    for c in ("timestamp_unix", "formatted_time", "new_ext"):
        m, _ = E.clear_column(m, c)
    _, report = T.backfill_timestamps(m, sidecars_now(spark, sf_dir))
    return report


def repaired_sidecars(spark, sf_dir):
    """The sidecars present now, half of those without a usable time exported anew."""
    inv = inventory_now(spark, sf_dir).where(F.col("origin") == "sidecar")
    anew = F.concat(F.lit('{"photoTakenTime": {"timestamp": "'),
                    (F.lit(1262304000) + F.col("file_id") * 86400).cast("string"), F.lit('"}}'))
    bad = (S.json_timestamp(F.col("content")) == 0) & (F.col("file_id") % 2 == 0)
    return inv.select("file_id", "path", F.when(bad, anew).otherwise(F.col("content")).alias("content"))


def q_backfill_retry_zero(spark, sf_dir):
    """Back-fill with both options: rows that hold time 0 are tried again, and
    rows without a media path take the extension of a file named after their
    sidecar (some sidecars have one or two such files next to them)."""
    side = repaired_sidecars(spark, sf_dir)
    m = (manifest(spark, sf_dir)
         .withColumn("timestamp_unix", F.when(F.col("row_id") % 2 == 1, F.col("timestamp_unix")))
         .withColumn("media_path", F.when(F.col("row_id") % 3 != 0, F.col("media_path")).otherwise(""))
         .withColumn("new_ext", F.lit("")))
    named = F.concat_ws("/", P.parent("path"), P.stem(P.basename("path")))
    near = side.where(F.col("file_id") % 5 == 1).select(F.concat(named, F.lit(".MP4")).alias("path")).unionByName(
        side.where(F.col("file_id") % 10 == 1).select(F.concat(named, F.lit(".A.jpg")).alias("path")))
    files = inventory_now(spark, sf_dir).select("path").unionByName(near)
    return T.backfill_timestamps(m, side.select("path", "content"), files, retry_zero=True)[1]


def q_tag_csv(spark, sf_dir):
    return T.tag_csv(manifest(spark, sf_dir))


def q_file_types(spark, sf_dir):
    return R.file_types(manifest(spark, sf_dir))


def q_file_type_lists(spark, sf_dir):
    return R.file_type_lists(manifest(spark, sf_dir))


def q_remove_rows(spark, sf_dir):
    _, removed = E.remove_rows(manifest(spark, sf_dir), "row_type", "UNMATCHED_JSON")
    return removed.select("row_id", "row_type", "json_path")


def q_clear_column(spark, sf_dir):
    _, report = E.clear_column(manifest(spark, sf_dir), "notes")
    return report


def q_prune_missing(spark, sf_dir):
    _, removed = E.prune_missing(manifest(spark, sf_dir), inventory_now(spark, sf_dir))
    return removed.select("row_id", "media_path", "json_path")


def q_invalid_paths(spark, sf_dir):
    return E.invalid_paths(manifest(spark, sf_dir), inventory_now(spark, sf_dir))


def windows_manifest(spark, sf_dir):
    """The manifest as written on a Windows host: media paths with a drive
    letter, sidecar paths padded with spaces on another drive."""
    m = manifest(spark, sf_dir)
    return (m.withColumn("media_path", F.when(F.col("media_path") != "", F.concat(
                F.lit("C:"), F.translate("media_path", "/", "\\"))).otherwise(F.col("media_path")))
             .withColumn("json_path", F.when(F.col("json_path") != "", F.concat(
                F.lit(" D:"), F.translate("json_path", "/", "\\"), F.lit(" "))).otherwise(F.col("json_path"))))


def q_windows_to_posix(spark, sf_dir):
    _, report = E.windows_to_posix(windows_manifest(spark, sf_dir))
    return report


def q_quarantine_paths(spark, sf_dir):
    _, report = E.quarantine_unmatched(manifest(spark, sf_dir), X.ROOT)
    return report.select("row_id", "media_path", "corrected_path", "json_path", "notes")


def q_restore_paths(spark, sf_dir):
    q, _ = E.quarantine_unmatched(manifest(spark, sf_dir), X.ROOT)
    media = q.where(F.col("row_type") == "unmatched_media").select(F.col("media_path").alias("path"))
    jsons = q.where(F.col("row_type") == "unmatched_json").select(F.col("json_path").alias("path"))
    root = X.ROOT
    return (A.restore_plan(media, f"{root}/{K.UNMATCHED_MEDIA_DIR}", root)
            .unionByName(A.restore_plan(jsons, f"{root}/{K.UNMATCHED_JSON_DIR}", root)))


def converted_changes(spark, sf_dir):
    headers = inventory_now(spark, sf_dir).where(F.col("origin") == "media").select("path", "header_hex")
    return A.conversion_plan(deduped_manifest(spark, sf_dir), headers, inventory_now(spark, sf_dir).select("path"))


def q_conversion_plan(spark, sf_dir):
    return converted_changes(spark, sf_dir)


FAILED_ROOT = f"{X.ROOT}/{K.FAILED_DIR}"


def failed_conversions(spark, sf_dir):
    """Converted files that failed: some videos in the encoder, some pictures in the decoder."""
    i = F.col("file_id")
    return inventory_now(spark, sf_dir).where((F.col("origin") == "media") & ((i % 12 == 5) | (i % 18 == 3))).select(
        "path", F.when(i % 12 == 5, "encoder stopped").otherwise("picture not decoded").alias("reason"))


def q_failed_moves(spark, sf_dir):
    """Failed files and all files named after them move to the failed folder,
    where an earlier run left some of the names."""
    now = inventory_now(spark, sf_dir)
    earlier = now.where((F.col("origin") == "media") & (F.col("file_id") % 24 == 5)).select(
        F.concat_ws("/", P.failed_target_dir("path", FAILED_ROOT), P.basename("path")).alias("path"))
    return A.failed_moves(failed_conversions(spark, sf_dir), now.select("path").unionByName(earlier), FAILED_ROOT)


def q_conversion_failures(spark, sf_dir):
    """Failure events of a conversion run recorded twice (a replay adds none),
    read back beside the rows' notes, which are something else."""
    failed = R.conversion_failures(manifest(spark, sf_dir), failed_conversions(spark, sf_dir))
    out = session.scratch_path(spark, "failures")
    for _ in range(2):
        record_events(row_events(failed, "conversion failed", path="media_path", detail="reason"), out, "r1", "convert")
    return spark.read.parquet(out).join(failed.select("row_id", "noted"), "row_id").select(
        "event", "row_id", "path", "detail", "noted")


def q_row_regex_count(spark, sf_dir):
    m = A.apply_rows(deduped_manifest(spark, sf_dir), converted_changes(spark, sf_dir))
    return R.count_matching_rows(m)


def q_sample_per_extension(spark, sf_dir):
    return A.sample_per_extension(manifest(spark, sf_dir), inventory_now(spark, sf_dir))


def q_archive_intake_plan(spark, sf_dir):
    return A.archive_intake_plan(X.downloads(spark, sf_dir), X.ROOT)


def q_search_names(spark, sf_dir):
    session.configure(spark)
    return SR.search_names(inventory(spark, sf_dir), X.archive_members(spark, sf_dir), "img_0001")


def q_search_names_exact(spark, sf_dir):
    session.configure(spark)
    return SR.search_names(inventory(spark, sf_dir), X.archive_members(spark, sf_dir),
                           "Takeout/Google Photos/Photos from 2012/IMG_00012.jpg", exact=True)


def q_stage_stats(spark, sf_dir):
    inv = pairing.describe_files(inventory(spark, sf_dir)).where(F.col("year_folder") != "")
    m = manifest(spark, sf_dir)

    def counts(df, **metrics):
        """One aggregate over a table, one row per metric."""
        row = df.agg(*[F.count_if(c).alias(n) for n, c in metrics.items()])
        return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("r")) \
            .select("r.*")

    kind, every = F.col("row_type"), F.lit(True)
    status = first_run(spark, sf_dir)
    parts = [
        counts(inv, media_files=~F.col("is_json"), sidecar_files=F.col("is_json")),
        counts(m, matched=kind == "matched", unmatched_json=kind == "unmatched_json", unmatched_media=kind == "unmatched_media",
               rows_with_notes=F.coalesce("notes", F.lit("")) != "", manifest_rows=every),
        counts(status, flagged_copies=S.flag_is("delete_flag", "true"), group_rows=F.col("dedup_group_id") != "",
               deleted_media=S.flag_is("deletion_status", "deleted"),
               media_rows_after_dedup=(F.col("media_path") != "") & ~S.flag_is("deletion_status", "deleted")),
        counts(recovered_pairs(spark, sf_dir), recovered_pairs=every),
        counts(converted_changes(spark, sf_dir), converted=F.col("action_taken").contains("Converted")),
        counts(SIM.reconcile_actions(similarity_manifest(spark, sf_dir), UNMATCHED_ROOT, SIM_ROOT, K.HAMMING_THRESHOLD),
               similar_recovered=F.col("op") == "move"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


UNMATCHED_ROOT = X.ROOT + "/" + K.UNMATCHED_MEDIA_DIR
SIM_ROOT = X.ROOT + "/" + K.SIM_DIR


def q_hamming_nearest(spark, sf_dir):
    session.configure(spark)
    return SIM.best_matches(similarity_manifest(spark, sf_dir), UNMATCHED_ROOT).select("unmatched", "match", "distance")


def q_hamming_top5(spark, sf_dir):
    session.configure(spark)
    near = SIM.best_matches(similarity_manifest(spark, sf_dir), UNMATCHED_ROOT, 5, threshold=None)
    return near.select("unmatched", "match", "distance", "rank")


def q_hamming_nearest_8bands(spark, sf_dir):
    session.configure(spark)
    return SIM.best_matches(similarity_manifest(spark, sf_dir), UNMATCHED_ROOT, bands=8).select("unmatched", "match", "distance")


def q_reconcile_actions(spark, sf_dir):
    session.configure(spark)
    return SIM.reconcile_actions(similarity_manifest(spark, sf_dir), UNMATCHED_ROOT, SIM_ROOT,
                                 K.HAMMING_THRESHOLD)


QJSON_ROOT = X.ROOT + "/" + K.UNMATCHED_JSON_DIR


def quarantined(spark, sf_dir):
    """The manifest after its unmatched rows were pointed at quarantine."""
    return stage(spark, sf_dir, "quarantined",
                 lambda: E.quarantine_unmatched(manifest(spark, sf_dir), X.ROOT)[0])


def quarantined_files(spark, sf_dir):
    """Files now in the quarantine folders (the unmatched rows' files)."""
    q = quarantined(spark, sf_dir)
    media = q.where(F.col("row_type") == "unmatched_media").select(F.col("media_path").alias("path"))
    jsons = q.where(F.col("row_type") == "unmatched_json").select(F.col("json_path").alias("path"))
    return media.unionByName(jsons)


def recovered_pairs(spark, sf_dir):
    return stage(spark, sf_dir, "recovered_pairs", lambda: RC.recover_pairs(
        quarantined_files(spark, sf_dir), QJSON_ROOT, UNMATCHED_ROOT))


def q_fuzzy_recover(spark, sf_dir):
    session.configure(spark)
    return RC.recover_pairs(quarantined_files(spark, sf_dir), QJSON_ROOT, UNMATCHED_ROOT)


def q_fuzzy_recover_rows(spark, sf_dir):
    session.configure(spark)
    _, updated = RC.apply_recovery(quarantined(spark, sf_dir), recovered_pairs(spark, sf_dir),
                                   QJSON_ROOT, UNMATCHED_ROOT, X.ROOT)
    return updated.select("row_id", "row_type", "json_filename", "json_path", "original_media",
                          "media_path", "notes")


# ---------------------------------------------------------------- file-based sources

def _to_archive_path(col):
    return F.concat(F.lit(X.ROOT + "/"), col)


def _below(root: str, col: str = "path"):
    """Path relative to a scratch root (URI scheme ignored)."""
    import re
    local = re.sub(r"^file:(//)?", "", root).rstrip("/") + "/"
    return F.regexp_replace(F.regexp_replace(F.col(col), r"^file:(//)?", ""), "^" + re.escape(local), "")


def q_csv_roundtrip(spark, sf_dir):
    session.configure(spark)
    m = manifest(spark, sf_dir)
    path = session.scratch_path(spark, "manifest-csv")
    CSV.write_manifest(m, path)
    back = CSV.read_manifest(spark, path)
    return back.select(*m.columns)


def q_csv_widened(spark, sf_dir):
    """A later stage's manifest written under an earlier header: the earlier
    columns first and in their order, then the new ones; read back as text."""
    old = ["notes", "media_path", "row_id"]
    out = session.scratch_path(spark, "csv-widened")
    rows = fingerprinted_manifest(spark, sf_dir).select("content_sha1", "row_id", "phash64", "media_path", "hash_mtime", "notes")
    CSV.write_manifest(rows, out, original_header=old)
    back = CSV.read_manifest(spark, out, typed=False)
    return back.withColumn("header", F.lit(",".join(back.columns)))


def q_sidecar_scan(spark, sf_dir):
    session.configure(spark)
    root = FS.sidecar_tree(spark, sf_dir)
    docs = SRC.sidecar_documents(spark, root)
    ts = S.json_timestamp(F.col("content"))
    rel = _below(root)
    return docs.select(_to_archive_path(rel).alias("path"), ts.alias("timestamp_unix"),
                       S.format_unix(ts).alias("formatted_time"))


def q_inventory_scan(spark, sf_dir):
    """Both trees on disk, sidecars and media."""
    session.configure(spark)
    out = None
    for root in (FS.sidecar_tree(spark, sf_dir), FS.media_stub_tree(spark, sf_dir)):
        part = SRC.inventory(spark, root).select(_to_archive_path(_below(root)).alias("path"), "length")
        out = part if out is None else out.unionByName(part)
    return out


def q_zip_listing(spark, sf_dir):
    session.configure(spark)
    root = FS.zip_archives(spark, sf_dir)
    zips = SRC.inventory(spark, root, glob="*.zip").select("path")
    m = ARC.archive_members(zips)
    return m.select(F.regexp_extract("zip_path", r"/(Z[0-9]{3})-[0-9]+\.zip$", 1).alias("archive"),
                    "member", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"))


def q_tag_dump_pivot(spark, sf_dir):
    session.configure(spark)
    root = FS.tag_dumps(spark, sf_dir, manifest(spark, sf_dir))
    return TX.pivot_tags(TX.tag_dump_sections(spark, root))


def q_tool_log_summary(spark, sf_dir):
    """Last progress and closing counts of every log of the metadata writer."""
    root = FS.tool_logs(spark, sf_dir, manifest(spark, sf_dir))
    return TX.tool_log_summary(TX.read_tool_log(spark, root)).select(
        P.basename("path").alias("log"), "kind", "line", "current", "total")


def q_intake_stream(spark, sf_dir):
    session.configure(spark)
    from ..streaming.intake import run_intake
    folder = FS.downloads_folder(spark, sf_dir)
    out = session.scratch_path(spark, "intake-plan")
    ckpt = session.scratch_path(spark, "intake-checkpoint")
    run_intake(spark, folder, out, ckpt, X.ROOT)
    import re
    local = re.sub(r"^file:(//)?", "", folder).rstrip("/")
    return spark.read.parquet(out).select("name", "op", F.regexp_replace("dst", "^" + re.escape(local), "/data/Zipped")
                                          .alias("dst"), "reason")


def q_image_phash(spark, sf_dir):
    session.configure(spark)
    root = FS.image_files(spark, sf_dir)
    ph = PX.image_phash(PX.read_images(spark, root))
    return ph.select(_below(root).alias("file"),
                     S.phash_to_hex(F.col("phash")).alias("phash64"))


def q_guardrail_pixels(spark, sf_dir):
    session.configure(spark)
    root = FS.image_files(spark, sf_dir)
    orig = SRC.inventory(spark, root).where(F.col("path").contains("/orig/")).select(F.col("path").alias("a_path"))
    pairs = orig.select("a_path", F.regexp_replace("a_path", "/orig/", "/copy/").alias("b_path"))
    g = PX.guardrail(pairs, PX.read_images(spark, root), K.PIXEL_DIFF_SECOND_PASS, K.PHASH_DIST_SECOND_PASS, "to_min")
    return g.select(_below(root, "b_path").alias("file"),
                    F.round("diff", 3).alias("diff"), "hash_distance",
                    F.when(F.col("unflag"), K.REASON_UNCERTAIN).otherwise("keep_flag").alias("verdict"))


def extraction_listing(spark, sf_dir):
    """Files of the extracted archives: the inventory plus album and trash
    folders that sit next to the year folders (one album copy of every
    25th document, one trashed file of every 40th)."""
    d = X.table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    arch = F.concat(F.lit(X.ROOT + "/Z"), F.format_string("%03d", i % 3 + 1), F.lit("/" + X.GPHOTOS))
    album = d.where(i % 25 == 0).select(F.concat_ws("/", arch, F.concat(F.lit("Album "), (i % 4).cast("string")),
                                                    F.concat(F.lit("IMG_A"), F.format_string("%05d", i), F.lit(".jpg"))).alias("path"))
    trash = d.where(i % 40 == 0).select(F.concat_ws("/", arch, F.lit("Trash"),
                                                    F.concat(F.lit("IMG_T"), F.format_string("%05d", i), F.lit(".jpg"))).alias("path"))
    return inventory(spark, sf_dir).select("path").unionByName(album).unionByName(trash)


def q_photos_root_prune(spark, sf_dir):
    session.configure(spark)
    return A.photos_root_prune_plan(extraction_listing(spark, sf_dir), X.ROOT)


def q_restore_collision_plan(spark, sf_dir):
    session.configure(spark)
    q = quarantined(spark, sf_dir)
    media = q.where(F.col("row_type") == "unmatched_media").select(F.col("media_path").alias("path"))
    existing = inventory_now(spark, sf_dir).select("path")
    return A.restore_plan_safe(media, f"{X.ROOT}/{K.UNMATCHED_MEDIA_DIR}", X.ROOT, existing)


def q_guardrail_first_pass(spark, sf_dir):
    session.configure(spark)
    root = FS.image_files(spark, sf_dir)
    orig = SRC.inventory(spark, root).where(F.col("path").contains("/orig/")).select(F.col("path").alias("a_path"))
    pairs = orig.select("a_path", F.regexp_replace("a_path", "/orig/", "/copy/").alias("b_path"))
    g = PX.guardrail(pairs, PX.read_images(spark, root), K.PIXEL_DIFF_FIRST_PASS, None, "to_first")
    return g.select(_below(root, "b_path").alias("file"), F.round("diff", 3).alias("diff"),
                    F.when(F.col("unflag"), K.REASON_UNCERTAIN).otherwise("keep_flag").alias("verdict"))


def q_hamming_nearest_year_only(spark, sf_dir):
    session.configure(spark)
    near = SIM.best_matches(similarity_manifest(spark, sf_dir), UNMATCHED_ROOT, year_only=True, processing_root=X.ROOT)
    return near.select("unmatched", "match", "distance")


def q_dedup_guardrail_pairs(spark, sf_dir):
    return D.keeper_pairs(stale_manifest(spark, sf_dir))


def q_image_fingerprints(spark, sf_dir):
    session.configure(spark)
    root = FS.image_files(spark, sf_dir)
    fp = PX.image_fingerprints(PX.read_images(spark, root))
    return fp.select(_below(root).alias("file"), "content_sha1", S.phash_to_hex(F.col("phash")).alias("phash64"))


def picture_manifest(spark, sf_dir):
    """Decoded pictures and a fingerprinted manifest of them: one row per
    file, the original of a picture before its copy."""
    root = FS.image_files(spark, sf_dir)
    images = PX.read_images(spark, root).withColumn("path", F.concat(F.lit("/data/Pictures/"), _below(root)))
    fp = stage(spark, sf_dir, "picture_fingerprints", lambda: PX.image_fingerprints(images))
    number = F.regexp_extract("path", r"v([0-9]+)\.png$", 1).cast("long")
    m = fp.select((number * 2 + F.col("path").contains("/copy/").cast("long")).alias("row_id"), F.col("path").alias("media_path"),
                  P.basename("path").alias("original_media"), F.lit("").alias("json_path"), F.lit("").alias("json_filename"),
                  "content_sha1", F.coalesce(S.phash_to_hex(F.col("phash")), F.lit("")).alias("phash64"))
    return images, ensure_columns(m, D.VERDICT_COLUMNS)


def q_guardrail_writeback(spark, sf_dir):
    """Fingerprints, groups, keeper of each flagged copy, pixel check, and the
    verdicts written back into the manifest."""
    images, m = picture_manifest(spark, sf_dir)
    d = session.materialize(D.deduplicate(m), "picture-verdicts")
    pairs = D.keeper_pairs(d).select(F.col("keeper_path").alias("a_path"), F.col("copy_path").alias("b_path"))
    checks = PX.guardrail(pairs, images, K.PIXEL_DIFF_FIRST_PASS, None, "to_first")
    new, _ = D.apply_guardrail(d, checks)
    return new.where(F.col("dedup_group_id") != "").select("row_id", "media_path", "delete_flag", "dedup_reason")


def q_tag_csv_file(spark, sf_dir):
    """The tag CSV written by its sink and read back as text cells."""
    out = session.scratch_path(spark, "times-csv")
    write_times_csv(T.tag_csv(manifest(spark, sf_dir)), out)
    return CSV.read_manifest(spark, out, typed=False)


def q_fingerprint_refresh(spark, sf_dir):
    """The next version of the fingerprint table: rows whose file changed or had
    no hash are computed from the files present now, the others kept; a second
    pass over the new version finds nothing left to compute (its misses, if
    any, come as rows of version 2)."""
    m, now = fingerprinted_manifest(spark, sf_dir), inventory_now(spark, sf_dir)
    cols = ["row_id", "media_path", "content_sha1", "phash64", "hash_mtime"]

    def computed(misses):
        files = now.where(F.col("origin") == "media").select("path", "content_sha1", S.phash_from_hex("phash64").alias("phash"))
        return files.join(misses.select(F.col("media_path").alias("path")).distinct(), "path", "left_semi")
    first = D.fingerprint_cache_misses(m, now)
    new = session.materialize(D.refresh_fingerprints(m, computed(first), now), "fingerprints-v1")
    again = D.fingerprint_cache_misses(new, now).select("row_id").withColumn("version", F.lit(2))
    return new.select(*cols, F.lit(1).alias("version")).unionByName(
        new.join(again, "row_id").select(*cols, "version"))


def q_audit_events(spark, sf_dir):
    """The audit table after two runs, the second of them replayed: path audit,
    pruning, clearing of notes and path fixes of unmatched rows."""
    m, now = manifest(spark, sf_dir), inventory_now(spark, sf_dir)
    out = session.scratch_path(spark, "audit")
    stages = {
        "verify": row_events(E.invalid_paths(m, now), "missing path", path="path"),
        "prune": row_events(E.prune_missing(m, now)[1], "row removed", path="media_path", detail="json_path"),
        "clear": row_events(E.clear_column(m, "notes")[1], "cell cleared", detail="old_value"),
        "quarantine": row_events(E.quarantine_unmatched(m, X.ROOT)[1], "path updated", path="media_path", detail="notes"),
    }
    # a stage's report is one table, which every run (and its replay) records
    reports = {name: session.materialize(events, f"report-{name}") for name, events in stages.items()}
    for run in ("r1", "r2", "r2"):
        for name, events in reports.items():
            record_events(events, out, run, name)
    return spark.read.parquet(out).select("run", "stage", "event", "row_id", "column_name", "path", "detail")


def _configured(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Every registered query first applies the session settings it relies
    on (UTC, AQE) and ships the package to the Python workers."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session.configure(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _configured(fn) for name, fn in _registry().items()}


def q_quarantine_move_plan(spark, sf_dir):
    """Quarantine moves against the files present now plus an earlier run's
    quarantine contents (a copy of every restored file name that was
    quarantined before), so some names are taken."""
    m = manifest(spark, sf_dir)
    now = inventory_now(spark, sf_dir).select("path")
    earlier = (m.where(F.col("row_type") == "unmatched_media")
               .select(P.quarantine_path(F.col("media_path"), UNMATCHED_ROOT).alias("path"))
               .where(F.col("path").rlike("/IMG_[0-9]*[02468]\\.[a-z]+$")))
    return A.quarantine_move_plan(m, now.unionByName(earlier), X.ROOT)


def q_type_from_magic(spark, sf_dir):
    """Files whose first bytes contradict their extension: listing of the
    media files, 12-byte headers read in the executors, true type."""
    root = FS.media_stub_tree(spark, sf_dir)
    heads = SRC.file_headers(SRC.inventory(spark, root).select("path")).withColumn("ext", P.lower_suffix(P.basename("path")))
    true_ext = S.type_from_magic(F.col("header_hex"), F.col("ext"))
    return heads.where(true_ext.isNotNull()).select(
        _to_archive_path(_below(root)).alias("path"), F.col("ext").alias("current_ext"), true_ext.alias("true_ext"))


def q_unmatched_sidecars(spark, sf_dir):
    return manifest(spark, sf_dir).where(F.col("row_type") == "unmatched_json").select(
        "row_id", "json_filename", "json_path", "notes")


def q_unmatched_media(spark, sf_dir):
    return manifest(spark, sf_dir).where(F.col("row_type") == "unmatched_media").select(
        "row_id", "original_media", "media_path", "new_ext", "notes")


def q_dedup_groups_exact(spark, sf_dir):
    """Exact duplicate groups: images keyed by content SHA-1 too."""
    per_path = D.last_row_per_path(D.dedup_candidates(fingerprinted_manifest(spark, sf_dir), key="sha1"))
    g = D.duplicate_groups(per_path)
    return g.select("dedup_group_id", "n_members", "first_row_id", "keeper_path", "keeper_media")


def q_format_times(spark, sf_dir):
    """Capture-time text for every event time (whole UTC seconds)."""
    ev = X.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    secs = F.unix_timestamp("ts")
    return ev.select("event_id", secs.alias("timestamp_unix"), S.format_unix(secs).alias("formatted_time"))


def q_zip_search(spark, sf_dir):
    """Name search over the media files on disk and the members of the
    downloaded archives (real ZIP central directories)."""
    stubs = FS.media_stub_tree(spark, sf_dir)
    files = SRC.inventory(spark, stubs).select(_to_archive_path(_below(stubs)).alias("path"))
    zroot = FS.zip_archives(spark, sf_dir)
    members = ARC.archive_members(SRC.inventory(spark, zroot, glob="*.zip").select("path")).where(
        F.col("error").isNull()).select(
        F.concat(F.lit("/data/Zipped/"), F.regexp_extract("zip_path", r"/(Z[0-9]{3})-[0-9]+\.zip$", 1),
                 F.lit(".zip")).alias("zip_path"), "member")
    return SR.search_names(files, members, "img_0001")


def _registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "unmatched_sidecars": q_unmatched_sidecars,
        "unmatched_media": q_unmatched_media,
        "dedup_groups_exact": q_dedup_groups_exact,
        "format_times": q_format_times,
        "zip_search": q_zip_search,
        "type_from_magic": q_type_from_magic,
        "quarantine_move_plan": q_quarantine_move_plan,
        "hamming_nearest_year_only": q_hamming_nearest_year_only,
        "dedup_guardrail_pairs": q_dedup_guardrail_pairs,
        "image_fingerprints": q_image_fingerprints,
        "photos_root_prune": q_photos_root_prune,
        "restore_collision_plan": q_restore_collision_plan,
        "guardrail_first_pass": q_guardrail_first_pass,
        "csv_roundtrip": q_csv_roundtrip,
        "csv_widened": q_csv_widened,
        "sidecar_scan": q_sidecar_scan,
        "inventory_scan": q_inventory_scan,
        "zip_listing": q_zip_listing,
        "tag_dump_pivot": q_tag_dump_pivot,
        "tool_log_summary": q_tool_log_summary,
        "intake_stream": q_intake_stream,
        "image_phash": q_image_phash,
        "guardrail_pixels": q_guardrail_pixels,
        "guardrail_writeback": q_guardrail_writeback,
        "fuzzy_recover": q_fuzzy_recover,
        "fuzzy_recover_rows": q_fuzzy_recover_rows,
        "hamming_nearest": q_hamming_nearest,
        "hamming_top5": q_hamming_top5,
        "hamming_nearest_8bands": q_hamming_nearest_8bands,
        "reconcile_actions": q_reconcile_actions,
        "timestamps_from_json": q_timestamps_from_json,
        "backfill_timestamps": q_backfill_timestamps,
        "backfill_retry_zero": q_backfill_retry_zero,
        "failed_moves": q_failed_moves,
        "conversion_failures": q_conversion_failures,
        "dedup_reset": q_dedup_reset,
        "tag_csv": q_tag_csv,
        "tag_csv_file": q_tag_csv_file,
        "audit_events": q_audit_events,
        "fingerprint_refresh": q_fingerprint_refresh,
        "file_types": q_file_types,
        "file_type_lists": q_file_type_lists,
        "remove_rows": q_remove_rows,
        "clear_column": q_clear_column,
        "prune_missing": q_prune_missing,
        "invalid_paths": q_invalid_paths,
        "windows_to_posix": q_windows_to_posix,
        "quarantine_paths": q_quarantine_paths,
        "restore_paths": q_restore_paths,
        "conversion_plan": q_conversion_plan,
        "row_regex_count": q_row_regex_count,
        "sample_per_extension": q_sample_per_extension,
        "archive_intake_plan": q_archive_intake_plan,
        "search_names": q_search_names,
        "search_names_exact": q_search_names_exact,
        "stage_stats": q_stage_stats,
        "pair_sidecars": q_pair_sidecars,
        "pair_sidecars_same_archive": q_pair_sidecars_same_archive,
        "manifest_build": q_manifest_build,
        "dedup_verdicts": q_dedup_verdicts,
        "dedup_groups": q_dedup_groups,
        "dedup_last_row_per_path": q_dedup_last_row_per_path,
        "dedup_multi_keeper": q_dedup_multi_keeper,
        "dedup_fix_groups": q_dedup_fix_groups,
        "dedup_verify_issues": q_dedup_verify_issues,
        "dedup_deletion_plan": q_dedup_deletion_plan,
        "dedup_review_paths": q_dedup_review_paths,
        "fingerprint_cache_misses": q_fingerprint_cache_misses,
    }
