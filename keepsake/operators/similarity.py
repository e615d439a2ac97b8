"""Near-duplicate search by Hamming distance of 64-bit perceptual hashes.

The search runs on classes: the distinct (hash, year folder) on either side,
a candidate class with its ``k`` first files. However many files share a hash,
they are one row of the search, and each file gets at most ``k`` rows, made
after ranking.

Pairs within distance ``t`` are found with multi-index hashing (Norouzi,
Punjani & Fleet, CVPR 2012): the hash is cut into ``bands`` disjoint
bands; two hashes within distance ``t`` agree within ``r = t // bands``
bits on at least one band (pigeonhole). Each query hash is expanded into
every band value within radius ``r`` (a fixed list of XOR masks, exploded
in place -- no join with a mask table) and equi-joined with the candidate
bands on ``(band, value)``. A band value of many candidate hashes is dealt in
parts, each met by the queries. Pairs are verified with the exact distance, so
the result equals the brute-force ``distance <= t`` set.

Without a threshold the ``k`` nearest are wanted, however far: files with
``k`` matches inside the radius of the search are settled by it; the classes
of the others meet all candidate classes in blocks, each keeping ``k`` a class.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import paths as P
from ..functions import scalars as S
from ..session import materialize


#: Bands of the search: 4 runs of 16 bits, 137 probes a band at distance 10.
BANDS = 4
#: Bits by which a band may differ in a search without a threshold.
RADIUS = 2


def _masks(width: int, radius: int) -> list[int]:
    out = [0]
    for k in range(1, radius + 1):
        for bits in combinations(range(width), k):
            m = 0
            for b in bits:
                m |= 1 << b
            out.append(m)
    return out


def _band_values(h, bands: int):
    width = 64 // bands
    mask = (1 << width) - 1
    return [F.shiftrightunsigned(h, i * width).bitwiseAND(F.lit(mask)) for i in range(bands)]


#: Candidate hashes of one band value that one task meets; more are dealt in parts.
BAND_CHUNK = 50_000


def hamming_pairs(queries: DataFrame, candidates: DataFrame, threshold: int, bands: int = 4,
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """All (query, candidate) pairs with ``bit_count(q_hash ^ c_hash) <=
    threshold`` that also agree on ``keys``.

    ``queries``: ``q_id, q_hash`` (+ keys); ``candidates``: ``c_id, c_hash``
    (+ keys). Returns ``q_id, c_id, distance`` + keys."""
    if 64 % bands:
        raise ValueError("bands must divide 64")
    radius = threshold // bands
    masks = _masks(64 // bands, radius)
    spot = ["band", "value", *keys]
    cb = candidates.select("c_id", "c_hash", *keys, F.posexplode(F.array(*_band_values(F.col("c_hash"), bands)))
                           .alias("band", "value"))
    qb = (queries.select("q_id", "q_hash", *keys,
                         F.posexplode(F.array(*_band_values(F.col("q_hash"), bands))).alias("band", "qv"))
          .select("q_id", "q_hash", *keys, "band",
                  F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("_m"), "qv")
          .select("q_id", "q_hash", *keys, "band", F.col("qv").bitwiseXOR(F.col("_m")).alias("value")))
    # at most bands * candidates / BAND_CHUNK rows, so broadcast
    hot = F.broadcast(cb.groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / BAND_CHUNK).cast("int").alias("_parts"))
                      .where(F.col("_parts") > 1))
    parts = F.coalesce("_parts", F.lit(1))
    cb = cb.join(hot, spot, "left").withColumn("_part", F.pmod(F.xxhash64("c_id"), parts).cast("int")).drop("_parts")
    qb = qb.join(hot, spot, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    # a small table, but many rows of it once exploded: neither side may be broadcast by its size before that
    pairs = qb.join(cb.hint("merge"), [*spot, "_part"])
    d = S.hamming64(F.col("q_hash"), F.col("c_hash"))
    return (pairs.select("q_id", "c_id", d.alias("distance"), *keys)
            .where(F.col("distance") <= threshold)
            .dropDuplicates(["q_id", "c_id", *keys]))


#: Hashes of either side that one task compares as a block.
BLOCK = 2048


def nearest_in_blocks(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``q_hash, year, c_hash, distance``: for each class of ``queries``
    (``q_hash, year``) the candidate classes (``c_hash, year, files``) that
    hold its ``k`` nearest files, by comparing blocks of both sides. A block
    keeps ``k`` classes per query, by distance and first file: ``k`` files
    stand before any of the classes behind them."""
    n_q = queries.groupBy("year").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_nq"))
    n_c = candidates.groupBy("year").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_nc"))
    grid = n_q.join(n_c, "year")
    left = queries.join(grid, "year").select("year", "q_hash", F.pmod(F.xxhash64("q_hash"), "_nq").cast("int").alias("qb"),
                                             F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)).alias("cb"))
    right = candidates.join(grid, "year").select("year", "c_hash", F.col("files")[0]["c_order"].alias("o"), F.col("files")[0]["c_id"].alias("i"),
                                                 F.pmod(F.xxhash64("c_hash"), "_nc").cast("int").alias("cb"),
                                                 F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("qb"))

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"q_hash": [], "year": [], "c_hash": [], "distance": []})
        c = c.sort_values(["o", "i"])
        a, b = q["q_hash"].to_numpy(np.int64).view(np.uint64), c["c_hash"].to_numpy(np.int64).view(np.uint64)
        far = np.bitwise_count(a[:, None] ^ b[None, :]).astype(np.int64)
        near = np.argsort(far, axis=1, kind="stable")[:, :k]
        i, j = np.repeat(np.arange(len(a)), near.shape[1]), near.ravel()
        return pd.DataFrame({"q_hash": q["q_hash"].to_numpy()[i], "year": q["year"].iloc[0], "c_hash": c["c_hash"].to_numpy()[j],
                             "distance": far[i, j]})
    spot = ["year", "qb", "cb"]
    return left.groupBy(*spot).cogroup(right.groupBy(*spot)).applyInPandas(
        compare, "q_hash long, year string, c_hash long, distance long")


def is_masked(path_col) -> object:
    """Some parent folder starts with '_' but not with '__'."""
    parts = F.split(P.parent(path_col), "/")
    return F.exists(parts, lambda p: p.startswith("_") & ~p.startswith("__"))


def reconcile_inputs(manifest: DataFrame, unmatched_root: str) -> tuple[DataFrame, DataFrame]:
    """Split a manifest (``row_id, media_path, phash64``) into query files
    (under the quarantine root, not in a masked folder) and candidates
    (every other row with a hash). The last row of a path wins."""
    root = unmatched_root.rstrip("/") + "/"
    m = (manifest.where(S.nonblank("phash64") & S.nonblank("media_path"))
         .withColumn("_path", F.trim("media_path"))
         .withColumn("_h", S.phash_from_hex("phash64"))
         .where(F.col("_h").isNotNull()))
    last = m.groupBy("_path").agg(F.max_by(F.struct("row_id", "_h"), F.col("row_id")).alias("_l"))
    q = (last.where(F.col("_path").startswith(root) & ~is_masked(F.col("_path")))
         .select(F.col("_path").alias("q_id"), F.col("_l._h").alias("q_hash"),
                 P.nearest_year_ancestor(F.col("_path")).alias("year")))
    c = (m.where(~F.col("_path").startswith(root))
         .select(F.col("_path").alias("c_id"), F.col("_h").alias("c_hash"), F.col("row_id").alias("c_order"),
                 P.nearest_year_ancestor(F.col("_path")).alias("year")))
    return q, c


def year_folder_candidates(c: DataFrame, processing_root: str) -> DataFrame:
    """Year-restricted mode: candidates must sit in ``<root>/<Z archive>/
    Takeout/Google Photos/<year folder>/...`` (archive name starting with
    z/Z, not '_'), have an image or video extension and no '_' folder."""
    root = processing_root.rstrip("/")
    pat = "^" + re.escape(root) + r"/([Zz][^/]*)/Takeout/Google Photos/([^/]+)/"
    ok = (F.col("c_id").rlike(pat) & ~F.regexp_extract("c_id", pat, 1).startswith("_")
          & (F.regexp_extract("c_id", pat, 2) == F.col("year"))
          & P.lower_suffix(P.basename("c_id")).isin(*(K.DEDUP_IMAGE_EXTS + K.DEDUP_VIDEO_EXTS))
          & ~F.exists(F.split(P.parent("c_id"), "/"), lambda p: p.startswith("_")))
    return c.where(ok)


def _classes(q: DataFrame, c: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Query classes ``q_hash, year`` and candidate classes ``c_hash, year,
    files`` (the first ``k`` by order); a file without a year folder looks
    among all years, which are the year ``''`` of the candidate side."""
    every = c.where("year <> ''").unionByName(c.withColumn("year", F.lit("")))
    first = Window.partitionBy("c_hash", "year").orderBy("c_order", "c_id")
    top = every.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k)
    files = F.sort_array(F.collect_list(F.struct("c_order", "c_id")))       # k at most
    return q.select("q_hash", "year").distinct(), top.groupBy("c_hash", "year").agg(files.alias("files"))


def best_matches(manifest: DataFrame, unmatched_root: str, k: int = 1, threshold: int | None = K.HAMMING_THRESHOLD,
                 bands: int = BANDS, year_only: bool = False, processing_root: str | None = None) -> DataFrame:
    """The ``k`` nearest candidates of every quarantined file (by distance,
    then candidate order) within ``threshold`` (None: however far), restricted
    to the file's year folder when it has one. ``year_only``: files without a
    year folder are skipped and candidates come only from the archives' year
    folders (see :func:`year_folder_candidates`). Every ``bands`` is exact.
    Returns ``unmatched, match, distance, c_order, rank``."""
    q, c = reconcile_inputs(manifest, unmatched_root)
    if year_only:
        c = year_folder_candidates(c, processing_root or unmatched_root.rstrip("/").rsplit("/", 1)[0])
        q = q.where(F.col("year") != "")
    c = c.groupBy("c_id", "c_hash", "year").agg(F.min("c_order").alias("c_order"))
    q = materialize(q, "similarity-queries")
    asked, there = _classes(q, c, k)
    cores = q.sparkSession.sparkContext.defaultParallelism      # a class has hundreds of probes: the few bytes are read by all cores
    asked, there = materialize(asked.repartition(cores), "similarity-asked"), materialize(there, "similarity-there")
    reach = threshold if threshold is not None else (RADIUS + 1) * bands - 1
    near = hamming_pairs(asked.select(F.col("q_hash").alias("q_id"), "q_hash", "year"),
                         there.select(F.col("c_hash").alias("c_id"), "c_hash", "year"), reach, bands, keys=("year",)) \
        .select(F.col("q_id").alias("q_hash"), "year", F.col("c_id").alias("c_hash"), F.col("distance").cast("long").alias("distance"))
    if threshold is None:
        near = materialize(near, "similarity-near")
        files = near.join(there, ["c_hash", "year"]).groupBy("q_hash", "year").agg(F.sum(F.size("files")).alias("_n"))
        short = asked.join(files.where(F.col("_n") >= k), ["q_hash", "year"], "left_anti")
        far = nearest_in_blocks(materialize(short, "similarity-short"), there, k)
        near = near.join(files.where(F.col("_n") >= k), ["q_hash", "year"], "left_semi").unionByName(far)
    best = Window.partitionBy("q_hash", "year").orderBy("distance", "f.c_order", "f.c_id")
    found = near.join(there, ["c_hash", "year"]).select("q_hash", "year", "distance", F.explode("files").alias("f")) \
        .withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    return q.join(found, ["q_hash", "year"]).select(F.col("q_id").alias("unmatched"), F.col("f.c_id").alias("match"),
                                                    "distance", F.col("f.c_order").alias("c_order"), "rank")


def reconcile_actions(manifest: DataFrame, unmatched_root: str, sim_root: str,
                      threshold: int = K.HAMMING_THRESHOLD, bands: int = BANDS) -> DataFrame:
    """Action per quarantined file with a near match: distance 0 ->
    ``delete`` (exact duplicate), otherwise ``move`` to
    ``<sim_root>/<relative folder>/<stem>_sim<suffix>`` carrying the
    match's capture time when the match is an image.
    Returns ``unmatched, match, op, dest, timestamp, distance``."""
    best = best_matches(manifest, unmatched_root, 1, threshold, bands)
    times = manifest.select(F.trim("media_path").alias("match"),
                            F.col("formatted_time").alias("_t"), F.col("row_id").alias("_r"))
    times = times.groupBy("match").agg(F.max_by("_t", "_r").alias("_t"))
    b = best.join(times, "match", "left")
    root = unmatched_root.rstrip("/") + "/"
    rel = F.expr(f"substr(unmatched, {len(root) + 1})")
    name = P.basename(rel)
    rel_dir = P.parent(rel)
    dest = F.concat_ws("/", F.lit(sim_root.rstrip("/")), F.when(rel_dir != "", rel_dir),
                       F.concat(P.stem(name), F.lit(K.SIM_MARK), P.suffix(name)))
    is_img = P.lower_suffix(P.basename("match")).isin(*K.DEDUP_IMAGE_EXTS)
    op = F.when(F.col("distance") == 0, "delete").otherwise("move")
    ts = F.when((F.col("distance") > 0) & is_img & S.nonblank("_t"), F.col("_t"))
    return b.select("unmatched", "match", op.alias("op"),
                    F.when(F.col("distance") > 0, dest).otherwise(F.lit("")).alias("dest"),
                    ts.alias("timestamp"), "distance")
