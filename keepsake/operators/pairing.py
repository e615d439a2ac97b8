"""Sidecar <-> media pairing and the manifest build.

Pairing rule: inside one year folder, a sidecar ``base.ext.<x>(n).json``
describes the media ``base(n).ext`` (compared case-insensitively). Sidecars
are served in scan order and each takes the first media of that name not
yet taken. Because all sidecars with the same expected name compete only
for media of that name, the k-th such sidecar gets the k-th such media:
the greedy loop is an equi join on ``(year_folder, name, k)``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import paths as P
from ..functions import names as N
from ..functions import scalars as S
from ..session import materialize
from .ids import dense_index, group_rank


def describe_files(inv: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``name``, ``archive``, ``year_folder`` and ``is_json`` to a file
    inventory."""
    return (inv.withColumn("name", P.basename(path_col))
            .withColumn("archive", P.archive_part(path_col))
            .withColumn("year_folder", P.year_folder(path_col))
            .withColumn("is_json", F.lower(F.col("name")).endswith(".json")))


def _ranked(keyed: DataFrame, order_by: Sequence[str], prefer_same_archive: bool) -> DataFrame:
    """Files with ``_tier`` and ``_rk``: a sidecar and a media file pair if they
    agree on year folder, ``_k``, ``_tier`` and ``_rk``.

    One ranking pass serves both sides: the side is part of the group key.
    With ``prefer_same_archive`` the first tier ranks within the archive and
    holds as many files of a side as the other side has there; what is left
    of all archives is ranked anew in the tier ``''``."""
    by = ["year_folder", "_k", "is_json"]
    if not prefer_same_archive:
        return group_rank(keyed, by, order_by, "_rk").withColumn("_tier", F.lit(""))
    home = ["archive", "year_folder", "_k"]
    room = keyed.groupBy(*home).agg(F.least(F.count_if("is_json"), F.count_if(~F.col("is_json"))).alias("_room"))
    own = materialize(group_rank(keyed, [*home, "is_json"], order_by, "_rk").join(room, home), "paired-at-home")
    here = own.where(F.col("_rk") <= F.col("_room")).drop("_room").withColumn("_tier", F.col("archive"))
    rest = group_rank(own.where(F.col("_rk") > F.col("_room")).drop("_room", "_rk"), by, order_by, "_rk")
    return here.unionByName(rest.withColumn("_tier", F.lit("")))


def pair_sidecars(inv: DataFrame, order_by: Sequence[str], prefer_same_archive: bool = False,
                  allow_bare: bool = False) -> DataFrame:
    """Pairs ``(json_path, json_name, media_path, media_name, year_folder)``
    plus the sidecar's ``content`` when the inventory carries it. By default
    all archives of a year folder are one pool; ``prefer_same_archive`` first
    pairs inside each archive. ``allow_bare``: ``a.jpg.json`` names ``a.jpg``."""
    files = describe_files(inv).where(F.col("year_folder") != "")
    expected = N.sidecar_expected_media("name")
    if allow_bare:
        expected = F.coalesce(expected, N.bare_sidecar_media("name"))
    key = F.when(F.col("is_json"), F.lower(expected)).otherwise(F.lower("name"))
    both = files.withColumn("_k", key).where(F.col("_k").isNotNull())
    ranked = _ranked(both, order_by, prefer_same_archive)
    jr = ranked.where("is_json")
    mr = ranked.where(~F.col("is_json"))
    content = F.col("j.content") if "content" in inv.columns else F.lit(None).cast("string")
    return (jr.alias("j").join(mr.alias("m"), ["year_folder", "_k", "_tier", "_rk"])
            .select(F.col("j.path").alias("json_path"), F.col("j.name").alias("json_name"),
                    F.col("m.path").alias("media_path"), F.col("m.name").alias("media_name"),
                    "year_folder", content.alias("content")))


def build_manifest(inv: DataFrame, order_by: Sequence[str],
                   sidecar_docs: DataFrame | None = None) -> DataFrame:
    """The manifest: one row per sidecar (matched or unmatched) and one per
    media file no sidecar took. Files outside a year folder are skipped.

    One full outer join of ranked sidecars and ranked media on
    ``(year_folder, expected name, rank)`` yields matched rows (both sides),
    unmatched sidecars (no media) and unmatched media (no sidecar) at once;
    sidecars whose name has no expected media are unmatched directly.

    Row order (``row_id``, 1-based): sidecar rows by year folder then scan
    order, followed by unmatched media by year folder then scan order.
    ``sidecar_docs`` (``path``, ``content``) supplies JSON text when the
    inventory has no ``content`` column.
    """
    if sidecar_docs is not None:
        inv = inv.drop("content").join(sidecar_docs.select("path", "content"), "path", "left")
    elif "content" not in inv.columns:
        inv = inv.withColumn("content", F.lit(None).cast("string"))
    files = describe_files(inv).where(F.col("year_folder") != "")
    key = F.when(F.col("is_json"), F.lower(N.sidecar_expected_media("name"))).otherwise(F.lower("name"))
    # names are taken apart once: the files are read again for hot keys and for either side
    needed = dict.fromkeys(["path", "name", "content", "year_folder", "is_json", "_k", *order_by])
    files = materialize(files.withColumn("_k", key).select(*needed), "manifest-files")
    keyed = files.where(F.col("_k").isNotNull())
    ranked = group_rank(keyed, ["year_folder", "_k", "is_json"], order_by, "_rk")
    ocols = list(order_by)
    j = ranked.where("is_json").select(
        "year_folder", "_k", "_rk", *[F.col(c).alias(f"jo_{c}") for c in ocols],
        F.col("path").alias("j_path"), F.col("name").alias("j_name"), F.col("content").alias("j_content"))
    m = ranked.where(~F.col("is_json")).select(
        "year_folder", "_k", "_rk", *[F.col(c).alias(f"mo_{c}") for c in ocols],
        F.col("path").alias("m_path"), F.col("name").alias("m_name"))
    both = j.join(m, ["year_folder", "_k", "_rk"], "full_outer")
    # sidecars without an expected media name never pair
    nokey = files.where(F.col("is_json") & F.col("_k").isNull()).select(
        "year_folder", *[F.col(c).alias(f"jo_{c}") for c in ocols],
        F.col("path").alias("j_path"), F.col("name").alias("j_name"), F.col("content").alias("j_content"),
        *[F.lit(None).alias(f"mo_{c}") for c in ocols],
        F.lit(None).cast("string").alias("m_path"), F.lit(None).cast("string").alias("m_name"))
    rows = both.select("year_folder", *[f"jo_{c}" for c in ocols], "j_path", "j_name", "j_content",
                       *[f"mo_{c}" for c in ocols], "m_path", "m_name").unionByName(nokey)
    has_j, has_m = F.col("j_path").isNotNull(), F.col("m_path").isNotNull()
    matched = has_j & has_m
    ts = S.json_timestamp(F.col("j_content"))
    out = rows.select(
        F.when(has_j, F.lit(0)).otherwise(F.lit(1)).alias("_section"), F.col("year_folder").alias("_yf"),
        *[F.when(has_j, F.col(f"jo_{c}")).otherwise(F.col(f"mo_{c}")).alias(f"_o{i}") for i, c in enumerate(ocols)],
        F.when(matched, "matched").when(has_j, "unmatched_json").otherwise("unmatched_media").alias("row_type"),
        F.coalesce(F.col("j_name"), F.lit("")).alias("json_filename"),
        F.coalesce(F.col("j_path"), F.lit("")).alias("json_path"),
        F.coalesce(F.col("m_name"), F.lit("")).alias("original_media"),
        F.coalesce(F.col("m_path"), F.lit("")).alias("media_path"),
        F.coalesce(F.col("m_path"), F.lit("")).alias("corrected_path"),
        F.when(matched, ts).alias("timestamp_unix"),
        F.when(matched, S.format_unix(ts)).otherwise("").alias("formatted_time"),
        F.when(has_m, P.lower_suffix(F.col("m_name"))).otherwise("").alias("new_ext"),
        F.lit("").alias("action_taken"),
        F.when(matched, "").when(has_j, F.concat(F.lit(K.NOTE_NO_MEDIA), F.col("year_folder")))
        .otherwise(F.concat(F.lit(K.NOTE_NO_JSON), F.col("year_folder"))).alias("notes"),
    )
    okeys = ["_section", "_yf"] + [f"_o{i}" for i in range(len(ocols))]
    out = dense_index(out, okeys, name="row_id", start=1, materialize=True)
    return out.select("row_id", "row_type", "json_filename", "json_path", "original_media",
                      "media_path", "corrected_path", "timestamp_unix", "formatted_time",
                      "new_ext", "action_taken", "notes")
