"""Duplicate groups, keeper choice, group repair and verification.

All per-group decisions are aggregations (``min`` of a score struct, counts),
which Spark pre-aggregates map-side, so a fingerprint shared by a third of
all rows never lands whole in one task. Results go back to rows by joins on
the group key; a hot key there is split at run time by AQE's skew-join
handling (both sides are shuffled, the group side has one row per key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import paths as P
from ..functions import scalars as S
from ..session import materialize
from .ids import dense_index
from .joins import left_join_set

REVIEW_ROOT_DEFAULT = "/data/Processing/" + K.DUPLICATE_GROUPS_DIR


def _score_struct(original_media: Column, json_filename: Column, pos: Column) -> Column:
    """Keeper preference as an ascending-sortable struct: has a sidecar,
    then a clean name, then the shortest lower-cased name, then first seen."""
    nm = F.lower(F.coalesce(original_media, F.lit("")))
    return F.struct(
        S.blank(json_filename).alias("no_json"),
        S.unclean_name(nm).alias("unclean"),
        F.length(nm).alias("name_len"),
        pos.alias("pos"),
    )


def dedup_candidates(manifest: DataFrame, key: str = "phash",
                     existing: DataFrame | None = None, images: bool = True,
                     videos: bool = True) -> DataFrame:
    """Rows that take part in grouping: images keyed by perceptual hash
    (``key='sha1'``: by content SHA-1), videos by content SHA-1; blank
    fingerprints never group. ``existing`` (``path``) restricts to files
    that are present. ``images`` / ``videos`` = False skip that class."""
    ext = P.lower_suffix(P.basename(P.strip_ws("media_path")))
    kind = (F.when(F.lit(images) & ext.isin(*K.DEDUP_IMAGE_EXTS), F.lit(0))
            .when(F.lit(videos) & ext.isin(*K.DEDUP_VIDEO_EXTS), F.lit(1)))
    img_fp = F.col("phash64") if key == "phash" else F.col("content_sha1")
    fp = F.when(kind == 0, F.trim(img_fp)).when(kind == 1, F.trim(F.col("content_sha1")))
    c = (manifest.withColumn("_kind", kind).withColumn("_fp", fp)
         .where(F.col("_kind").isNotNull() & S.nonblank("_fp")))
    if existing is not None:
        c = c.join(existing.select(F.col("path").alias("_ex")).distinct(),
                   P.to_local_path("media_path") == F.col("_ex"), "left_semi")
    return c


def last_row_per_path(cands: DataFrame) -> DataFrame:
    """One row per (group key, media_path): the values of the last row with
    that path, at the position of the first."""
    last = F.max_by(F.struct("row_id", "original_media", "json_filename"), F.col("row_id"))
    return (cands.groupBy("_kind", "_fp", "media_path")
            .agg(F.min("row_id").alias("first_row_id"), last.alias("_last"))
            .select("_kind", "_fp", "media_path", "first_row_id",
                    F.col("_last.row_id").alias("last_row_id"),
                    F.col("_last.original_media").alias("original_media"),
                    F.col("_last.json_filename").alias("json_filename")))


def duplicate_groups(per_path: DataFrame) -> DataFrame:
    """Groups of >= 2 distinct paths with their keeper and number."""
    best = F.min(F.struct(_score_struct(F.col("original_media"), F.col("json_filename"),
                                        F.col("first_row_id")).alias("s"),
                          F.col("media_path").alias("media_path"),
                          F.col("original_media").alias("original_media")))
    g = (per_path.groupBy("_kind", "_fp")
         .agg(F.count(F.lit(1)).alias("n_members"),
              F.min("first_row_id").alias("first_row_id"),
              best.alias("_best"))
         .where(F.col("n_members") >= 2))
    # numbered in first-seen order, images before videos
    g = dense_index(g, ["_kind", "first_row_id"], name="_gnum", start=0)
    return g.select("_kind", "_fp", "n_members", "first_row_id",
                    F.format_string(K.GROUP_ID_FORMAT, F.col("_gnum")).alias("dedup_group_id"),
                    F.col("_best.media_path").alias("keeper_path"),
                    F.col("_best.original_media").alias("keeper_media"))


def dedup_verdicts(manifest: DataFrame, key: str = "phash", existing: DataFrame | None = None,
                   review_root: str = REVIEW_ROOT_DEFAULT) -> DataFrame:
    """Verdict per distinct media path in a duplicate group:
    ``media_path, dedup_group_id, delete_flag, duplicate_of, dedup_reason,
    visual_review_path``."""
    # read for the groups and again for their members
    per_path = materialize(last_row_per_path(dedup_candidates(manifest, key, existing)), "dedup-paths")
    groups = duplicate_groups(per_path)
    v = per_path.join(groups.drop("first_row_id"), ["_kind", "_fp"])
    keeper = F.col("media_path") == F.col("keeper_path")
    return v.select(
        "media_path", "dedup_group_id",
        F.when(keeper, "false").otherwise("true").alias("delete_flag"),
        F.when(keeper, "").otherwise(F.col("keeper_media")).alias("duplicate_of"),
        F.when(keeper, K.REASON_KEEPER).otherwise(K.REASON_DUPLICATE).alias("dedup_reason"),
        F.concat_ws("/", F.lit(review_root), F.col("dedup_group_id"),
                    P.basename("media_path")).alias("visual_review_path"),
    )


VERDICT_COLUMNS = ["dedup_group_id", "delete_flag", "duplicate_of", "dedup_reason",
                   "visual_review_path"]


def apply_verdicts(manifest: DataFrame, verdicts: DataFrame, reset: bool = False) -> DataFrame:
    """Write verdicts back by ``media_path`` (every row with that path);
    rows outside all groups keep their previous values, or lose them with
    ``reset``, so that only the groups of this run stand."""
    from ..schema import ensure_columns
    m = ensure_columns(manifest, VERDICT_COLUMNS)
    v = verdicts.select(F.col("media_path").alias("_v_path"), *[F.col(c).alias(f"_v_{c}") for c in VERDICT_COLUMNS])
    out = left_join_set(m, F.col("media_path"), v, "_v_path")
    hit = F.col("_v_dedup_group_id").isNotNull()
    for c in VERDICT_COLUMNS:
        out = out.withColumn(c, F.when(hit, F.col(f"_v_{c}")).otherwise(F.lit("") if reset else F.col(c)))
    return out.select(*m.columns)


def deduplicate(manifest: DataFrame, key: str = "phash", existing: DataFrame | None = None,
                review_root: str = REVIEW_ROOT_DEFAULT, reset: bool = False) -> DataFrame:
    return apply_verdicts(manifest, dedup_verdicts(manifest, key, existing, review_root), reset)


# ---------------------------------------------------------------- repair

def multi_keeper_groups(manifest: DataFrame) -> DataFrame:
    """Groups with more than one ``best_candidate`` row (all rows counted)."""
    gid = F.trim(F.coalesce(F.col("dedup_group_id"), F.lit("")))
    return (manifest.where(gid != "").groupBy(gid.alias("dedup_group_id"))
            .agg(F.count_if(F.trim("dedup_reason") == K.REASON_KEEPER).alias("n_best"),
                 F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_best") > 1))


def fix_groups(manifest: DataFrame) -> DataFrame:
    """Re-rank groups with several keepers: returns the rewritten rows
    ``row_id, dedup_group_id, delete_flag, dedup_reason, duplicate_of``."""
    gid = F.trim(F.coalesce(F.col("dedup_group_id"), F.lit("")))
    rows = manifest.where(gid != "").withColumn("_gid", gid)
    best = F.min(F.struct(_score_struct(F.col("original_media"), F.col("json_filename"),
                                        F.col("row_id")).alias("s"),
                          F.col("row_id").alias("row_id"),
                          F.trim(F.coalesce("original_media", F.lit(""))).alias("media")))
    g = (rows.groupBy("_gid")
         .agg(F.count_if(F.trim("dedup_reason") == K.REASON_KEEPER).alias("_nb"), best.alias("_b"))
         .where(F.col("_nb") > 1))
    j = rows.join(g, "_gid")
    keeper = F.col("row_id") == F.col("_b.row_id")
    return j.select(
        "row_id", F.col("dedup_group_id"),
        F.when(keeper, "FALSE").otherwise("TRUE").alias("delete_flag"),
        F.when(keeper, K.REASON_KEEPER).otherwise(K.REASON_DUPLICATE).alias("dedup_reason"),
        F.when(keeper, "").otherwise(F.col("_b.media")).alias("duplicate_of"))


def apply_fixes(manifest: DataFrame, fixes: DataFrame) -> DataFrame:
    cols = ["delete_flag", "dedup_reason", "duplicate_of"]
    f = fixes.select("row_id", *[F.col(c).alias(f"_f_{c}") for c in cols])
    out = manifest.join(f, "row_id", "left")
    hit = F.col("_f_delete_flag").isNotNull()
    for c in cols:
        out = out.withColumn(c, F.when(hit, F.col(f"_f_{c}")).otherwise(F.col(c)))
    return out.select(*manifest.columns)


def verify_groups(manifest: DataFrame) -> DataFrame:
    """Integrity issues of live groups (deleted rows ignored): a group must
    have exactly one keeper (flag false) and at least two members. Returns
    ``dedup_group_id, n_keepers, n_duplicates, n_members, issues``."""
    live = manifest
    if "deletion_status" in manifest.columns:
        live = manifest.where(~S.flag_is("deletion_status", K.STATUS_DELETED))
    gid = F.trim(F.coalesce(F.col("dedup_group_id"), F.lit("")))
    g = (live.where(gid != "").groupBy(gid.alias("dedup_group_id"))
         .agg(F.count_if(S.flag_is("delete_flag", "false")).alias("n_keepers"),
              F.count_if(S.flag_is("delete_flag", "true")).alias("n_duplicates"),
              F.count(F.lit(1)).alias("n_members")))
    issues = ((F.col("n_keepers") != 1).cast("long") + (F.col("n_members") < 2).cast("long"))
    return g.withColumn("issues", issues).where(F.col("issues") > 0)


# ---------------------------------------------------------------- deletion

def deletion_plan(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Flagged rows -> file actions. The media is deleted when its path
    exists, the sidecar likewise; ``deletion_status`` is ``deleted`` iff the
    media is. Returns ``row_id, op, src, reason, deletion_status``."""
    ex = existing.select(F.col("path").alias("_ex")).distinct()
    flagged = manifest.where(S.flag_is("delete_flag", "true"))
    m = flagged.withColumn("_ml", P.to_local_path("media_path")) \
               .withColumn("_jl", P.to_local_path("json_path"))
    m = left_join_set(m, F.col("_ml"), ex.withColumnRenamed("_ex", "_mex"), "_mex")
    m = left_join_set(m, F.col("_jl"), ex.withColumnRenamed("_ex", "_jex"), "_jex")
    del_media = S.nonblank("media_path") & F.col("_mex").isNotNull()
    del_json = S.nonblank("json_path") & F.col("_jex").isNotNull()
    status = F.when(del_media, K.STATUS_DELETED).otherwise(K.STATUS_NOT_DELETED)
    acts = F.array(
        F.when(del_media, F.struct(F.lit("delete").alias("op"), F.col("_ml").alias("src"),
                                   F.lit("duplicate media").alias("reason"))),
        F.when(del_json, F.struct(F.lit("delete").alias("op"), F.col("_jl").alias("src"),
                                  F.lit("duplicate sidecar").alias("reason"))))
    return (m.select("row_id", status.alias("deletion_status"),
                     F.explode(F.filter(acts, lambda a: a.isNotNull())).alias("a"))
            .select("row_id", "a.op", "a.src", "a.reason", "deletion_status"))


def deletion_status(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Manifest with ``deletion_status`` set on flagged rows."""
    from ..schema import ensure_columns
    m = ensure_columns(manifest, ["deletion_status"])
    ex = existing.select(F.col("path").alias("_ex")).distinct()
    flagged = S.flag_is("delete_flag", "true")
    j = left_join_set(m, P.to_local_path("media_path"), ex, "_ex", only=flagged)
    st = F.when(flagged, F.when(S.nonblank("media_path") & F.col("_ex").isNotNull(), K.STATUS_DELETED)
                .otherwise(K.STATUS_NOT_DELETED)).otherwise(F.col("deletion_status"))
    return j.withColumn("deletion_status", st).select(*m.columns)


# ---------------------------------------------------------------- cache

def refresh_fingerprints(manifest: DataFrame, computed: DataFrame, files: DataFrame) -> DataFrame:
    """Write freshly computed fingerprints (``path, content_sha1, phash``)
    into the manifest's hash columns, with the file's whole-second mtime
    (``files``: ``path, mtime``); other rows keep their cached values."""
    c = (computed.join(files.select("path", "mtime"), "path", "left")
         .select(F.col("path").alias("_p"), F.col("content_sha1").alias("_sha"),
                 F.when(F.col("phash").isNotNull(), S.phash_to_hex(F.col("phash"))).otherwise(F.lit("")).alias("_ph"),
                 F.round("mtime").cast("long").alias("_mt")))
    j = left_join_set(manifest, P.to_local_path("media_path"), c, "_p")
    hit = F.col("_p").isNotNull()
    return (j.withColumn("content_sha1", F.when(hit, F.col("_sha")).otherwise(F.col("content_sha1")))
             .withColumn("phash64", F.when(hit, F.col("_ph")).otherwise(F.col("phash64")))
             .withColumn("hash_mtime", F.when(hit, F.col("_mt")).otherwise(F.col("hash_mtime")))
             .select(*manifest.columns))


def fingerprint_cache_misses(manifest: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Media rows whose fingerprint must be (re)computed: forced, no cached
    hash, or the file's whole-second mtime differs from the cached one.
    Rows whose file is missing yield nothing. Returns
    ``row_id, media_path, reason``."""
    f = files.select(F.col("path").alias("_p"), F.col("mtime").alias("_mtime"))
    ext = P.lower_suffix(P.basename(P.strip_ws("media_path")))
    m = manifest.where(ext.isin(*(K.DEDUP_IMAGE_EXTS + K.DEDUP_VIDEO_EXTS)))
    j = m.join(f, P.to_local_path("media_path") == F.col("_p"))
    reason = (F.when(F.lit(force), "forced")
              .when(S.blank("content_sha1"), "no_hash")
              .when(F.coalesce(F.col("hash_mtime"), F.lit(-1)) != F.round(F.col("_mtime")).cast("long"),
                    "mtime_changed"))
    return j.select("row_id", "media_path", reason.alias("reason")).where(F.col("reason").isNotNull())


def keeper_pairs(manifest: DataFrame) -> DataFrame:
    """Flagged copies with their group's keeper, found through the group id
    (the keeper is the group's row flagged false): ``dedup_group_id,
    keeper_path, copy_path, copy_row_id``. Groups without exactly one
    keeper give no pairs (they are reported by :func:`verify_groups`)."""
    gid = F.trim(F.coalesce(F.col("dedup_group_id"), F.lit("")))
    rows = manifest.where(gid != "").withColumn("_gid", gid)
    keepers = (rows.where(S.flag_is("delete_flag", "false")).groupBy("_gid")
               .agg(F.count(F.lit(1)).alias("_nk"), F.min("media_path").alias("keeper_path"))
               .where(F.col("_nk") == 1))
    copies = rows.where(S.flag_is("delete_flag", "true"))
    return copies.join(keepers, "_gid").select(
        F.col("_gid").alias("dedup_group_id"), "keeper_path", F.col("media_path").alias("copy_path"),
        F.col("row_id").alias("copy_row_id"))


def apply_guardrail(manifest: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Un-flag copies the pixel guardrail found uncertain: ``checks`` has
    ``b_path`` (the copy's media path) and ``unflag``; those rows get
    ``delete_flag = 'false'`` and ``dedup_reason = 'guardrail_uncertain'``.
    Returns ``(new_manifest, cleared_rows)``."""
    u = checks.where("unflag").select(F.col("b_path").alias("_u")).distinct()
    j = manifest.join(u, P.to_local_path("media_path") == F.col("_u"), "left")
    hit = F.col("_u").isNotNull() & S.flag_is("delete_flag", "true")
    # the condition is fixed in a column before the flag it reads is rewritten
    out = (j.withColumn("_hit", hit)
            .withColumn("delete_flag", F.when(F.col("_hit"), F.lit("false")).otherwise(F.col("delete_flag")))
            .withColumn("dedup_reason", F.when(F.col("_hit"), F.lit(K.REASON_UNCERTAIN)).otherwise(F.col("dedup_reason"))))
    return out.select(*manifest.columns), out.where("_hit").select(*manifest.columns)
