"""Recovery of orphaned sidecars and media by fuzzy name matching.

Keys: a sidecar name lower-cased without its trailing ``.json``, a media
stem lower-cased; both keep ASCII letters and digits only. A sidecar and a
media file match when one key equals or contains the other. Sidecars are
served in order; each takes the first remaining matching media (in media
order) -- serial dictatorship.

Everything is found on distinct keys: the files of one key are a class with an
ordered queue. "a contains b" is found exactly by exploding every substring of
the longer key whose length occurs among the other side's keys, then
equi-joining on the substring (both directions, equality is the full-length
case). Edges join keys, never files.

Assignment: the n-th sidecar of a class tries the n-th media of the queues its
class has edges to, taken together in media order; a class of n sidecars needs
the first n of each queue only. If no two sidecars of a component of keys try
the same media, that is what the sequential loop gives them. Otherwise it is
so for all sidecars before the component's first loser (the earliest sidecar
that tries a media an earlier one tries): they are served, and the component's
others try again with what is left. The loser's rival is always served, so
every round makes progress; only contested components see a second round, and
homonyms alone never contest. Rounds are written under the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import names as N
from ..functions import paths as P
from ..session import materialize
from .ids import group_rank


def _substrings(df: DataFrame, key: str, lengths: DataFrame) -> DataFrame:
    """Every distinct substring of ``key`` whose length is in ``lengths``.

    The distinct key lengths of the other side are collected (a list bounded
    by the longest name) and only substrings of those lengths are generated."""
    lens = sorted(r[0] for r in lengths.collect())
    n = F.length(key)
    wanted = F.filter(F.array(*[F.lit(x) for x in lens]) if lens else F.array().cast("array<int>"),
                      lambda x: x <= n)
    sub = df.select("*", F.explode(wanted).alias("_len"))
    sub = sub.select("*", F.explode(F.sequence(F.lit(1), n - F.col("_len") + 1)).alias("_start"))
    return sub.withColumn("_sub", F.substring(key, F.col("_start"), F.col("_len"))) \
              .drop("_start", "_len").dropDuplicates([c for c in df.columns] + ["_sub"])


def key_edges(j_keys: DataFrame, m_keys: DataFrame) -> DataFrame:
    """``j_key, m_key`` of distinct keys (blank ones left out) of which one
    equals or contains the other."""
    j = j_keys.select("j_key").where(F.col("j_key") != "").distinct()
    m = m_keys.select("m_key").where(F.col("m_key") != "").distinct()
    m_len = m.select(F.length("m_key").alias("_len")).distinct()
    j_len = j.select(F.length("j_key").alias("_len")).distinct()
    # media key inside sidecar key, then sidecar key inside media key
    a = _substrings(j, "j_key", m_len).join(m, F.col("_sub") == F.col("m_key"))
    b = _substrings(m, "m_key", j_len).join(j, F.col("_sub") == F.col("j_key"))
    return a.select("j_key", "m_key").unionByName(b.select("j_key", "m_key")).distinct()


def key_components(edges: DataFrame) -> DataFrame:
    """``j_key, part``: the smallest sidecar key reachable over the edges."""
    part = edges.select("j_key").distinct().withColumn("part", F.col("j_key"))
    while True:
        around = edges.join(part, "j_key").groupBy("m_key").agg(F.min("part").alias("part"))
        new = edges.join(around, "m_key").groupBy("j_key").agg(F.min("part").alias("part"))
        new = materialize(new.join(part.withColumnRenamed("part", "_old"), "j_key"), "recovery-parts")
        part = new.select("j_key", "part")
        if new.where(F.col("part") != F.col("_old")).isEmpty():
            return part


def assign_in_order(sidecars: DataFrame, media: DataFrame, edges: DataFrame) -> DataFrame:
    """Accepted ``j_id, m_id``. ``sidecars``: ``j_id, j_order, j_key``;
    ``media``: ``m_id, m_order, m_key``; ids are unique. Runs to the fixpoint."""
    edges = materialize(edges, "recovery-edges")
    j = materialize(sidecars.join(key_components(edges), "j_key"), "recovery-sidecars")
    m = materialize(media.join(edges.select("m_key").distinct(), "m_key", "left_semi"), "recovery-media")
    turn, accepted = F.struct("j_order", "j_id"), None
    while True:
        want = j.groupBy("j_key").agg(F.count(F.lit(1)).alias("_want"))
        queue = group_rank(m, ["m_key"], ["m_order", "m_id"], "_place")
        offer = edges.join(want, "j_key").join(queue, "m_key").where(F.col("_place") <= F.col("_want"))
        offer = group_rank(materialize(offer, "recovery-offers"), ["j_key"], ["m_order", "m_id"], "_nth")
        tried = group_rank(j, ["j_key"], ["j_order", "j_id"], "_nth").join(offer.select("j_key", "_nth", "m_id"), ["j_key", "_nth"])
        tried = materialize(tried.select("part", "j_id", "j_order", "m_id"), "recovery-tried")
        first = tried.groupBy("m_id").agg(F.min(turn).alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        lost = tried.join(first, "m_id").where(turn > F.col("_first")).groupBy("part").agg(F.min(turn).alias("_lost"))
        lost = materialize(lost, "recovery-lost")
        won = tried.join(lost, "part", "left").where(F.coalesce(turn < F.col("_lost"), F.lit(True))).select("j_id", "m_id")
        accepted = won if accepted is None else accepted.unionByName(won)
        if lost.isEmpty():
            return accepted
        j = materialize(j.join(lost, "part", "left_semi").join(won, "j_id", "left_anti"), "recovery-sidecars")
        m = materialize(m.join(won, "m_id", "left_anti"), "recovery-media")


def recover_pairs(files: DataFrame, json_root: str, media_root: str) -> DataFrame:
    """Fuzzy pairs among quarantined files (``path``): sidecars are ``.json``
    files under ``json_root``; media are files under ``media_root``. Both
    are served in path order. Returns ``json_path, media_path``."""
    jr, mr = json_root.rstrip("/") + "/", media_root.rstrip("/") + "/"
    j = (files.where(F.col("path").startswith(jr) & F.lower("path").endswith(".json"))
         .select(F.col("path").alias("j_id"), F.col("path").alias("j_order"),
                 N.fuzzy_key_sidecar(P.basename("path")).alias("j_key")))
    m = (files.where(F.col("path").startswith(mr))
         .select(F.col("path").alias("m_id"), F.col("path").alias("m_order"),
                 N.fuzzy_key_media(P.basename("path")).alias("m_key")))
    won = assign_in_order(j, m, key_edges(j, m))
    return won.select(F.col("j_id").alias("json_path"), F.col("m_id").alias("media_path"))


def apply_recovery(manifest: DataFrame, pairs: DataFrame, quarantine_json_root: str,
                   quarantine_media_root: str, processing_root: str) -> tuple[DataFrame, DataFrame]:
    """Update the unmatched-media row of each pair (by its quarantined path)
    to a matched row pointing at the restored locations, and drop the pair's
    unmatched-sidecar row when the media row was found. Returns
    ``(new_manifest, updated_rows)``."""
    new_json = P.restore_path(F.col("json_path"), quarantine_json_root, processing_root)
    new_media = P.restore_path(F.col("media_path"), quarantine_media_root, processing_root)
    p = pairs.select(F.col("media_path").alias("_qm"), F.col("json_path").alias("_qj"),
                     P.basename("json_path").alias("_jn"), new_json.alias("_nj"), new_media.alias("_nm"))
    is_media_row = F.lower(F.coalesce("row_type", F.lit(""))) == "unmatched_media"
    m = manifest.join(p, is_media_row & (F.col("media_path") == F.col("_qm")), "left")
    hit = F.col("_qm").isNotNull()
    out = m
    for c, v in [("json_filename", F.col("_jn")), ("json_path", F.col("_nj")),
                 ("original_media", P.basename(F.col("_nm"))), ("media_path", F.col("_nm")),
                 ("corrected_path", F.col("_nm")), ("row_type", F.lit("matched")),
                 ("notes", F.lit(K.NOTE_RECOVERED))]:
        out = out.withColumn(c, F.when(hit, v).otherwise(F.col(c)))
    out = out.withColumn("_hit", hit)
    updated = out.where("_hit").select(*manifest.columns)
    # sidecar rows of pairs whose media row was updated are dropped
    done = m.where(hit).select(F.col("_qj").alias("_drop"))
    is_json_row = F.lower(F.coalesce("row_type", F.lit(""))) == "unmatched_json"
    kept = out.select(*manifest.columns).join(
        done, is_json_row & (F.col("json_path") == F.col("_drop")), "left_anti")
    return kept, updated
