"""File-action plans. Spark computes the whole plan as a DataFrame
``(row_id, op, src, dst, reason)``; carrying it out is left to a file
mover. Collision-free names are found by joins with the inventory."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import names as N
from ..functions import paths as P
from ..functions import scalars as S
from ..operators.joins import left_join_set

ACTION_COLUMNS = ["row_id", "op", "src", "dst", "reason"]


# ------------------------------------------------------------ free names

#: One variant mark at the end of a stem: what stands before it, and its number.
_VARIANT = {
    "underscore": r"(?s)^(.+)_([1-9][0-9]*)$",
    "paren": r"(?s)^(.+)\(([1-9][0-9]*)\)$",
    "restored": r"(?s)^(.+)_restored(?:_([1-9][0-9]*))?$",
}
#: Variant marks counted to order nested targets.
_MARK = {"underscore": r"_[0-9]+", "paren": r"\([0-9]+\)", "restored": r"_restored(_[0-9]+)?"}


#: Candidates generated by one task at a time; batching only, none is dropped.
NAME_CHUNK = 10_000


def _numbered(path: Column, number: Column, style: str) -> Column:
    return F.when(number == 0, path).otherwise(
        F.concat_ws("/", P.parent(path), N.numbered_name(P.basename(path), number, style)))


def _variant_of(path: Column, style: str) -> Column:
    """The target that ``path`` is a numbered variant of; null if of none."""
    st = P.stem(P.basename(path))
    base = F.regexp_extract(st, _VARIANT[style], 1)
    # a name ending in a dot has no suffix, but its variants look as if they had one
    dotted = P.suffix(P.basename(path)).rlike(r"^\." + _MARK[style] + "$")
    return F.when(dotted, F.concat_ws("/", P.parent(path), F.concat(st, F.lit(".")))).when(base != "", F.concat_ws("/", P.parent(path), F.concat(base, P.suffix(P.basename(path)))))


def free_names(targets: DataFrame, existing: DataFrame, style: str) -> DataFrame:
    """Collision-free destinations (exact, no cap on the number tried).

    ``targets``: ``(key, target, order)``; ``existing``: ``path``. Targets
    are served in ``order``; each gets the lowest-numbered name -- the plain
    target first, then its numbered variants in ``style`` -- that neither
    exists nor was given to an earlier target, whatever target that name was
    a variant of. Returns ``(key, dst)``; no ``dst`` repeats.

    A target wanted once, free, and not handed to a row of the target it is a
    variant of keeps its name: it only passes joins. The others are crowded,
    and a row can lose its plain name only to the target one mark shorter
    (``a_1.jpg`` to ``a.jpg``), so crowded targets are settled from the
    shortest nesting on. At each nesting the n-th row of a target takes its
    n-th free name; a name that another target's row wants plainly is free
    for earlier rows only, and rows that come too late for one move on, in
    rounds, until none does.
    """
    from ..session import materialize
    ex = existing.select(F.col("path").alias("_ex")).distinct()
    rank = F.struct("order", "key")
    classes = targets.groupBy("target").agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_first"))
    marks = F.regexp_count(P.basename("target"), F.lit(_MARK[style]))
    classes = materialize(classes.join(ex, F.col("target") == F.col("_ex"), "left").select(
        "target", "_n", "_first", F.col("_ex").isNotNull().alias("_taken"), _variant_of(F.col("target"), style).alias("_base"),
        marks.alias("_depth")), "name-classes")
    crowded = classes.where((F.col("_n") > 1) | F.col("_taken"))
    depths = {r[0] for r in crowded.select("_depth").distinct().collect()}       # nesting levels
    lost = served = done = None
    while depths:
        depth = min(depths)
        depths.discard(depth)
        now = crowded.where(F.col("_depth") == depth).select("target", "_n", F.lit(False).alias("_lost"))
        if lost is not None:
            now = now.join(lost, "target", "left_anti").unionByName(
                classes.where(F.col("_depth") == depth).join(lost, "target").select("target", "_n", F.lit(True).alias("_lost")))
        now = materialize(now, "names-crowded")
        got = materialize(_settle(targets, now, classes, ex, style), "names-settled")
        part = got.select("key", "dst")
        served = now.select("target") if served is None else served.unionByName(now.select("target"))
        done = part if done is None else done.unionByName(part)
        # plain names that rows of this nesting took; their own rows are served later
        lost = got.where("_of is not null").select(F.col("dst").alias("target"))
        depths |= {r[0] for r in classes.join(lost, "target", "left_semi").select("_depth").distinct().collect()}
    if done is None:
        return targets.select("key", F.col("target").alias("dst"))
    return targets.join(served.distinct(), "target", "left_anti").select("key", F.col("target").alias("dst")).unionByName(done)


def _settle(targets: DataFrame, now: DataFrame, classes: DataFrame, ex: DataFrame, style: str) -> DataFrame:
    """``key, dst, _of`` of all rows of the crowded targets ``now``; ``_of`` is
    set where ``dst`` is wanted plainly by another target's row.

    For a target wanted by ``n`` rows, with ``E`` existing files and ``W``
    wanted targets among its variants, the first ``n + E + W + 2`` candidates
    always hold ``n`` free names, so exactly that many are generated per
    distinct target -- never one list per row."""
    from ..operators.ids import group_rank
    from ..session import materialize
    near = ex.select(_variant_of(F.col("_ex"), style).alias("target")).unionByName(
        classes.select(F.col("_base").alias("target"))).where("target is not null") \
        .join(now, "target", "left_semi").groupBy("target").agg(F.count(F.lit(1)).alias("_near"))
    last = F.col("_n") + F.coalesce("_near", F.lit(0)) + 1
    # candidate numbers are generated in chunks spread over tasks, so a target
    # wanted by millions of rows is not expanded inside one task
    chunks = now.join(near, "target", "left").select("target", "_lost", last.alias("_last"), F.explode(
        F.sequence(F.lit(0), F.floor(last / NAME_CHUNK).cast("long"))).alias("_c")).repartition("target", "_c")
    names = chunks.select("target", "_lost", F.explode(F.sequence(
        F.col("_c") * NAME_CHUNK, F.least((F.col("_c") + 1) * NAME_CHUNK - 1, F.col("_last")))).alias("_k"))
    names = names.withColumn("dst", _numbered(F.col("target"), F.col("_k"), style)) \
        .where((F.col("_k") > 0) | ~F.col("_lost")).join(ex, F.col("dst") == F.col("_ex"), "left_anti")
    limits = classes.select(F.col("target").alias("_of"), F.col("_first").alias("_limit"))
    names = names.join(limits, (F.col("dst") == F.col("_of")) & (F.col("_k") > 0), "left").select("target", "_k", "dst", "_of", "_limit")
    names = materialize(names, "names-free")
    rows = group_rank(targets.join(now, "target", "left_semi"), ["target"], ["order", "key"], "_nth")
    rows = materialize(rows.select("target", "key", F.struct("order", "key").alias("_rank"), "_nth"), "names-rows")
    while True:
        pairs = rows.join(group_rank(names, ["target"], ["_k"], "_nth"), ["target", "_nth"])
        pairs = materialize(pairs, "names-tried")
        late = pairs.where(F.col("_limit") < F.col("_rank"))
        if late.isEmpty():
            return pairs.select("key", "dst", "_of")
        # below a target's first refusal all is settled; names closed to its row are closed to later rows too
        first = late.groupBy("target").agg(F.min(F.struct("_k", "_rank")).alias("_at"))
        closed = F.coalesce((F.col("_k") >= F.col("_at._k")) & (F.col("_limit") < F.col("_at._rank")), F.lit(False))
        names = materialize(names.join(first, "target", "left").where(~closed).drop("_at"), "names-free")


# ------------------------------------------------------------ conversion

def _rename_sidecar(json_path: Column, json_name: Column, media_name: Column):
    new_fn = N.renamed_sidecar(json_name, media_name)
    changed = (new_fn != json_name) & (json_name != "")
    new_path = F.when(changed, F.concat_ws("/", P.parent(json_path), new_fn)).otherwise(json_path)
    return F.when(changed, new_fn).otherwise(json_name), new_path


def conversion_plan(manifest: DataFrame, headers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Per manifest row one of: type correction from magic bytes, conversion of
    an image format to JPEG, of a video format to MP4; the sidecar follows the
    new media name. ``headers``: ``path, header_hex`` (first 12 bytes) of
    present files. With ``existing`` (``path``), no new name repeats or exists:
    media names that are taken become ``<stem>_1``, ``_2``, ... and sidecars
    ``<stem>(1).json``, ``(2)``, ...
    Returns the rewritten rows that changed: ``row_id, media_path,
    corrected_path, new_ext, json_filename, json_path, action_taken``."""
    from ..session import materialize
    h = headers.select(F.col("path").alias("_hp"), F.col("header_hex").alias("_hdr"))
    m = left_join_set(manifest, F.col("media_path"), h, "_hp")
    media = F.coalesce(F.col("media_path"), F.lit(""))
    old_ext = P.lower_suffix(P.basename(media))
    fixed_ext = S.type_from_magic(F.col("_hdr"), old_ext)
    m = m.select(*manifest.columns, F.when(media != "", fixed_ext).alias("_fixed"),
                 F.when(media != "", S.conversion_target(old_ext)).alias("_to"), P.basename(media).alias("_name"),
                 old_ext.alias("_old"), P.parent(media).alias("_dir"))
    # a corrected file is a .jpg or .mov, which no conversion takes
    m = m.withColumn("_kind", F.when(F.col("_fixed").isNotNull(), "fix").when(F.col("_to") == ".jpg", "image")
                     .when(F.col("_to") == ".mp4", "video")).where("_kind is not null")
    bare = F.regexp_replace(F.col("_old"), r"^\.", "")
    # the tag: the lower-case suffix, but as written for images other than png, heic and dng
    tag = F.when((F.col("_kind") == "image") & ~F.col("_old").isin(".png", ".heic", ".dng"),
                 F.regexp_replace(P.suffix(F.col("_name")), r"^\.", "")).otherwise(bare)
    ext = F.coalesce("_fixed", "_to")
    m = m.withColumn("_new", F.concat_ws("/", "_dir", N.tagged_conversion_name(F.col("_name"), ext, tag)))
    if existing is not None:
        # the naming steps read the changed rows several times: write them once
        m = materialize(m, "conversion-rows")
        free = free_names(m.select(F.col("row_id").alias("key"), F.col("_new").alias("target"), F.col("row_id").alias("order")),
                          existing, "underscore")
        m = m.drop("_new").join(free.select(F.col("key").alias("row_id"), F.col("dst").alias("_new")), "row_id")
    new_name = P.basename("_new")
    done = F.when(F.col("_kind") == "fix", F.concat(F.lit(K.ACTION_RENAMED), F.col("_name"), F.lit(K.ACTION_ARROW), new_name)) \
        .when(F.col("_kind") == "image", F.concat(F.lit(K.ACTION_CONVERTED), new_name)) \
        .otherwise(F.concat(F.lit(K.ACTION_CONVERTED_VIDEO), bare, F.lit(K.ACTION_TO_MP4)))
    old_json = F.coalesce(F.col("json_path"), F.lit(""))
    jn, jp = _rename_sidecar(old_json, P.basename(old_json), new_name)
    has = old_json != ""
    out = m.select("row_id", F.col("_new").alias("media_path"), F.col("_new").alias("corrected_path"), ext.alias("new_ext"),
                   F.when(has, jn).otherwise(F.col("json_filename")).alias("json_filename"),
                   F.when(has, jp).otherwise(F.col("json_path")).alias("json_path"),
                   S.append_history("action_taken", done).alias("action_taken"), (has & (jp != old_json)).alias("_renamed"))
    if existing is None:
        return out.drop("_renamed")
    out = materialize(out, "conversion-sidecars")
    ren = out.where("_renamed").select(F.col("row_id").alias("key"), F.col("json_path").alias("target"),
                                       F.col("row_id").alias("order"))
    free = free_names(ren, existing, "paren").select(F.col("key").alias("row_id"), F.col("dst").alias("_free"))
    return out.join(free, "row_id", "left").select(
        "row_id", "media_path", "corrected_path", "new_ext",
        F.when(F.col("_free").isNotNull(), P.basename("_free")).otherwise(F.col("json_filename")).alias("json_filename"),
        F.coalesce(F.col("_free"), F.col("json_path")).alias("json_path"), "action_taken")


def apply_rows(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite the changed columns of rows present in ``changes`` (by row_id)."""
    cols = [c for c in changes.columns if c != "row_id"]
    ch = changes.select("row_id", *[F.col(c).alias(f"_c_{c}") for c in cols], F.lit(True).alias("_hit"))
    out = manifest.join(ch, "row_id", "left")
    for c in cols:
        out = out.withColumn(c, F.when(F.col("_hit").isNotNull(), F.col(f"_c_{c}")).otherwise(F.col(c)))
    return out.select(*manifest.columns)


# ------------------------------------------------------------ sampling

def sample_per_extension(manifest: DataFrame, existing: DataFrame | None,
                         exts=tuple(K.SAMPLE_EXTS), exclude_deleted: bool = False) -> DataFrame:
    """Test mode: the first row (manifest order) of every listed extension.
    Conversion flavour (default): the row is kept only if its media and
    sidecar exist in ``existing`` (a blank sidecar path counts as present, as
    an empty path names the working folder). Dedup flavour
    (``existing=None``, ``exclude_deleted=True``, image or video extensions):
    deleted rows are skipped before choosing. Returns ``ext, row_id, media_path``."""
    ext = P.lower_suffix(P.basename(F.coalesce(F.col("media_path"), F.lit(""))))
    m = manifest.withColumn("ext", ext).where(F.col("ext").isin(*exts))
    if exclude_deleted and "deletion_status" in manifest.columns:
        m = m.where(~S.flag_is("deletion_status", K.STATUS_DELETED))
    first = m.groupBy("ext").agg(F.min("row_id").alias("row_id"))
    rows = m.join(first, ["ext", "row_id"])
    if existing is None:
        return rows.select("ext", "row_id", "media_path")
    ex = existing.select(F.col("path").alias("_ex")).distinct()
    rows = rows.join(ex.withColumnRenamed("_ex", "_m"), F.col("media_path") == F.col("_m"), "left") \
               .join(ex.withColumnRenamed("_ex", "_j"), F.col("json_path") == F.col("_j"), "left")
    ok = F.col("_m").isNotNull() & (S.blank("json_path") | F.col("_j").isNotNull())
    return rows.where(ok).select("ext", "row_id", "media_path")


# ------------------------------------------------------------ restore

def restore_plan(paths: DataFrame, quarantine_root: str, processing_root: str) -> DataFrame:
    """Moves back from a quarantine root: ``(src, dst)``; files directly
    below the root (no archive folder) are ``skip`` rows."""
    dst = P.restore_path(F.col("path"), quarantine_root, processing_root)
    under = F.col("path").startswith(quarantine_root.rstrip("/") + "/")
    return paths.where(under).select(
        F.when(dst.isNotNull(), "move").otherwise("skip").alias("op"),
        F.col("path").alias("src"), F.coalesce(dst, F.lit("")).alias("dst"),
        F.when(dst.isNotNull(), "restore").otherwise("unexpected structure").alias("reason"))


# ------------------------------------------------------------ intake

def archive_intake_plan(zips: DataFrame, processing_root: str, processed: DataFrame | None = None,
                        taken: DataFrame | None = None) -> DataFrame:
    """New downloads (``.zip`` suffix in any case, name not starting with
    ``Z``) -> extract into ``<root>/Z###`` and rename to ``Z###.zip`` (the
    name is kept when that one exists or an earlier new archive takes it). A name without a ``-NNN.zip`` number (case
    sensitive) is a skip row. ``zips``: ``path``; ``processed`` (optional
    tracker, ``stem``): archives already extracted are left out. ``taken``
    (optional, ``path``): names of earlier batches, present or promised to
    them. Returns ``name, op, dst, reason``."""
    name = P.basename("path")
    z = zips.withColumn("name", name).withColumn("_dir", P.parent("path"))
    new = z.where((P.lower_suffix("name") == ".zip") & ~F.col("name").startswith("Z"))
    if processed is not None:
        # the tracker: one row per archive already extracted (its name stem)
        new = new.join(processed.select(F.col("stem").alias("_done")),
                       P.stem(F.col("name")) == F.col("_done"), "left_anti")
    num = F.regexp_extract("name", K.ARCHIVE_NUMBER_RE, 1)
    new = new.withColumn("_num", num)
    names = (z.select("path") if taken is None else z.select("path").unionByName(taken.select("path"))) \
        .select(F.col("path").alias("_taken")).distinct()
    std = F.concat_ws("/", F.col("_dir"), F.concat(F.lit("Z"), F.col("_num"), F.lit(".zip")))
    new = new.withColumn("_std", std).join(names, F.col("_std") == F.col("_taken"), "left")
    # of several new archives of one number, the first in name order takes the name
    first = new.groupBy(F.col("_std").alias("_of")).agg(F.min("name").alias("_first"))
    new = new.join(first, F.col("_std") == F.col("_of"))
    free = F.col("_taken").isNull() & (F.col("name") == F.col("_first"))
    ok = F.col("_num") != ""
    acts = F.when(ok, F.array(
        F.struct(F.lit("extract").alias("op"),
                 F.concat(F.lit(processing_root.rstrip("/") + "/Z"), F.col("_num")).alias("dst"),
                 F.lit("new archive").alias("reason")),
        F.struct(F.when(free, "rename").otherwise("keep_name").alias("op"),
                 F.col("_std").alias("dst"),
                 F.when(free, "standard name").otherwise("target exists").alias("reason")),
    )).otherwise(F.array(F.struct(F.lit("skip").alias("op"), F.lit("").alias("dst"),
                                  F.lit("no archive number").alias("reason"))))
    return new.select("name", F.explode(acts).alias("a")).select("name", "a.op", "a.dst", "a.reason")


# ------------------------------------------------------------ extraction pruning

def ancestor_dirs(files: DataFrame) -> DataFrame:
    """Every ancestor folder of every file (``path``): ``dir, depth, name,
    parent`` (distinct)."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    d = files.select(F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("depth"), parts.alias("_p"))
    d = d.select("depth", F.concat(F.lit("/"), F.array_join(F.slice("_p", 1, F.col("depth")), "/")).alias("dir"))
    return d.distinct().withColumn("name", P.basename("dir")).withColumn("parent", P.parent("dir"))


def photos_root_prune_plan(files: DataFrame, archive_root: str) -> DataFrame:
    """Per extracted archive (first folder below ``archive_root``): the photos
    root is the shallowest folder with a child named exactly ``Photos from
    dddd``; its other child folders are planned for deletion.
    Returns ``archive, root, op, dst, reason`` (``dst`` = the folder)."""
    base = archive_root.rstrip("/") + "/"
    dirs = ancestor_dirs(files.where(F.col("path").startswith(base)))
    dirs = dirs.withColumn("archive", F.regexp_extract("dir", "^" + re.escape(base) + "([^/]+)", 1)).where(F.col("archive") != "")
    years = dirs.where(P.is_year_folder_name("name"))
    roots = (years.groupBy("archive").agg(F.min(F.struct(F.col("depth"), F.col("parent"))).alias("_r"))
             .select("archive", F.col("_r.parent").alias("root")))
    kids = (dirs.alias("d").join(roots.alias("r"), (F.col("d.archive") == F.col("r.archive"))
                                 & (F.col("d.parent") == F.col("r.root")))
            .select(F.col("d.archive").alias("archive"), "root", "dir", "name"))
    return kids.where(~P.is_year_folder_name("name")).select(
        "archive", "root", F.lit("delete_tree").alias("op"), F.col("dir").alias("dst"),
        F.lit("non-year folder next to year folders").alias("reason"))


# ------------------------------------------------------------ failed files

def failed_moves(failed: DataFrame, files: DataFrame, failed_root: str) -> DataFrame:
    """Quarantine of failed conversions: every file in the failed file's
    folder named ``<stem>.<anything>`` moves to the failed folder (parts from
    the archive folder on), numbered ``_n`` when the name is taken there.
    ``failed``: ``path, reason``; ``files``: ``path`` (present files).
    A file that several failed files claim moves once, for the first of them
    by path. Returns ``op, src, dst, reason``."""
    f = failed.select(F.col("path").alias("_fp"), "reason",
                      P.parent("path").alias("_dir"), P.stem(P.basename("path")).alias("_prefix"))
    cand = files.select(F.col("path").alias("src"), P.parent("path").alias("_dir"), P.basename("path").alias("_nm"))
    cand = cand.select("src", "_dir", "_nm", F.posexplode(F.split("_nm", r"\.")).alias("_i", "_x")).where(F.col("_i") > 0)
    cand = cand.select("src", "_dir", "_nm",
                       F.array_join(F.slice(F.split("_nm", r"\."), 1, F.col("_i")), ".").alias("_prefix"))
    j = (f.join(cand, ["_dir", "_prefix"]).groupBy("src", "_nm")
         .agg(F.min(F.struct("_fp", "reason")).alias("_of")).select("src", "_nm", "_of.*"))
    target = F.concat_ws("/", P.failed_target_dir(F.col("_fp"), failed_root), F.col("_nm"))
    t = j.select(F.col("src").alias("key"), target.alias("target"), F.col("src").alias("order"), "reason")
    named = free_names(t.select("key", "target", "order"), files.select("path"), "underscore")
    return t.join(named, "key").select(F.lit("move").alias("op"), F.col("key").alias("src"), "dst", "reason")


# ------------------------------------------------------------ restore with collisions

def restore_plan_safe(paths: DataFrame, quarantine_root: str, processing_root: str,
                      existing: DataFrame) -> DataFrame:
    """Restore moves where an occupied destination becomes ``<stem>_restored``
    (then ``_restored_1``, ...), never overwriting. Returns ``op, src, dst, reason``."""
    plan = restore_plan(paths, quarantine_root, processing_root)
    moves = plan.where(F.col("op") == "move")
    t = moves.select(F.col("src").alias("key"), F.col("dst").alias("target"), F.col("src").alias("order"))
    named = free_names(t, existing, "restored")
    return (moves.join(named.withColumnRenamed("key", "src").withColumnRenamed("dst", "_safe"), "src")
            .select("op", "src", F.col("_safe").alias("dst"),
                    F.when(F.col("_safe") == F.col("dst"), "restore").otherwise("restore (target exists)").alias("reason"))
            .unionByName(plan.where(F.col("op") != "move")))


# ------------------------------------------------------------ quarantine moves

def quarantine_move_plan(manifest: DataFrame, existing: DataFrame, processing_root: str) -> DataFrame:
    """Moves of unmatched files into the quarantine folders (media under
    ``__UNMATCHED_MEDIA__``, sidecars under ``__UNMATCHED_JSON__``, keeping
    the parts from the archive folder on, without ``Takeout`` / ``Google
    Photos``); a destination that is taken becomes ``<stem>_1``, ``_2``, ...
    Returns ``row_id, op, src, dst, reason``."""
    rt = F.lower(F.coalesce(F.col("row_type"), F.lit("")))
    root = processing_root.rstrip("/")
    media = manifest.where(rt == "unmatched_media").select(
        "row_id", F.col("media_path").alias("src"),
        P.quarantine_path(F.col("media_path"), f"{root}/{K.UNMATCHED_MEDIA_DIR}").alias("target"))
    side = manifest.where(rt == "unmatched_json").select(
        "row_id", F.col("json_path").alias("src"),
        P.quarantine_path(F.col("json_path"), f"{root}/{K.UNMATCHED_JSON_DIR}").alias("target"))
    moves = media.unionByName(side).where(F.col("target").isNotNull())
    named = free_names(moves.select(F.col("src").alias("key"), "target", F.col("row_id").alias("order")),
                       existing, "underscore")
    return moves.join(named.withColumnRenamed("key", "src"), "src").select(
        "row_id", F.lit("move").alias("op"), "src", "dst",
        F.when(F.col("dst") == F.col("target"), "quarantine").otherwise("quarantine (name taken)").alias("reason"))
