"""Approximate nearest neighbours on shifted space-filling curves.

Each curve projects the vectors on ``AXES`` random orthonormal directions of
its own, adds a random shift and orders them by Hilbert key. The key range of
a curve is cut at its quantiles into ``blocks`` blocks of about equal row
counts; a query looks at the ``reach`` blocks on either side of its own. Rows
are dealt to tasks by (curve, block); blocks beyond ``chunk`` rows (copies of
one key cannot be cut) and queries beyond ``query_chunk`` are dealt in parts,
each query meeting every part. A task scores its queries against its block in
double precision and keeps the best k of each; the merge ranks the union.

The quantiles are a mergeable sketch over all rows. Windows are a share of
the rows, (2 * reach + 1) / blocks per curve, because neighbours in isotropic
vectors thin out with any fixed row count; the README has the measured recall.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without vec_id, take no part; only vectors of the query's
length are candidates; rows repeating a vec_id are one vector; equal scores go
to the smaller vec_id; fewer than k candidates are all returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, unpack, vectors

AXES = 4
LEVELS = 8                                   # bits per axis


def hilbert_keys(cells: np.ndarray, bits: int = LEVELS) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers.

    The axes are turned level by level from the coarsest: a set bit reflects
    the first axis, a clear one swaps it with the axis looked at; a Gray code
    of the turned bits, read level by level, is the position."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(dims):
            on = (x[:, axis] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, axis]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, axis] ^= swap
    for axis in range(1, dims):
        x[:, axis] ^= x[:, axis - 1]
    fix = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[:, -1] >> level) & 1, (1 << level) - 1, 0)
    x ^= fix[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | (x[:, axis] >> level) & 1
    return key


def curve_keys(x: np.ndarray, scale: float, curves: int, seed: int) -> np.ndarray:
    """Keys (rows x curves) of vectors whose components have deviation ``scale``."""
    dim, out = x.shape[1], []
    axes = min(AXES, dim)
    turn = None
    for c in range(curves):
        per_turn = max(1, dim // axes)
        if c % per_turn == 0:                # a rotation gives dim // axes disjoint sets of axes
            turn = np.linalg.qr(np.random.default_rng([seed, dim, c]).normal(size=(dim, dim)))[0]
        own = turn[:, (c % per_turn) * axes:][:, :axes]
        y = 1 / (1 + np.exp(np.clip(-1.7 * (x @ own) / scale, -50, 50)))
        shift = np.random.default_rng([seed, 1, c]).random(axes) * 0.25
        cells = ((y * 0.8 + shift) % 1.0 * (1 << LEVELS)).astype(np.int64)
        out.append(hilbert_keys(np.minimum(cells, (1 << LEVELS) - 1)))
    return np.stack(out, axis=1)


def best(q: np.ndarray, x: np.ndarray, q_id: np.ndarray, x_id: np.ndarray, k: int):
    """Per query the k best other vectors, ties to the smaller id; the scores
    come from one summation order, whatever block a pair is met in."""
    rows, cols, scores = [], [], []
    for lo in range(0, len(q), 512):
        part = q[lo:lo + 512]
        rough = part @ x.T
        rough[q_id[lo:lo + 512, None] == x_id[None, :]] = -np.inf
        if x.shape[0] > k:
            edge = np.partition(rough, -k, axis=1)[:, -k]
            take = rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]
        else:
            take = np.ones(rough.shape, bool)
        i, j = np.nonzero(take & np.isfinite(rough))
        score = np.concatenate([np.einsum("ij,ij->i", part[i[a:a + 65536]], x[j[a:a + 65536]])
                                for a in range(0, len(i), 65536)] or [np.empty(0)])
        order = np.lexsort((x_id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        rows.append(i[rank < k] + lo), cols.append(j[rank < k]), scores.append(score[rank < k])
    return tuple(np.concatenate(v) if v else np.empty(0, int) for v in (rows, cols, scores))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, curves: int = 10, blocks: int = 32, reach: int = 2,
            chunk: int = 16_384, query_chunk: int = 4096, seed: int = 42) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` (a
    condition on vec_id) its ``k`` nearest others found by inner product."""
    rows = vectors(embeddings).where("ok and vec_id is not null").select("vec_id", "dim", "v")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = {r["dim"]: (r["n"], max(r["s"], 1e-300) ** 0.5) for r in
             rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.avg(square / F.col("dim")).alias("s")).collect()}

    def keyed(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                x = matrix(part["v"])
                keys = curve_keys(x, sizes[dim][1], curves, seed)
                yield pd.DataFrame({"vec_id": part["vec_id"], "dim": dim, "v": [r.tobytes() for r in x.astype("<f8")],
                                    "keys": list(keys)})
    points = written(rows.mapInPandas(keyed, "vec_id long, dim int, v binary, keys array<long>"), "curve-keys")
    spread = points.select("vec_id", "dim", "v", F.posexplode("keys").alias("curve", "key"))
    plan = embeddings.sparkSession.createDataFrame(
        [(d, max(1, min(blocks, n // 64))) for d, (n, _) in sizes.items()], "dim int, cuts int")
    cuts = spread.groupBy("dim", "curve").agg(F.percentile_approx("key", [i / 1024 for i in range(1, 1024)], F.lit(10000)).alias("q")) \
        .join(F.broadcast(plan), "dim")
    cuts = written(cuts.select("dim", "curve", "cuts", F.expr(
        "transform(sequence(1, cuts), i -> if(i = cuts, 9223372036854775807, q[cast(i * 1024 / cuts as int) - 1]))").alias("q")), "curve-cuts")
    # size of cuts: lengths of vectors x curves
    placed = spread.join(F.broadcast(cuts), ["dim", "curve"]) \
        .withColumn("block", F.size(F.filter("q", lambda b: b < F.col("key"))))
    aims = placed.where(is_query).withColumn("low", F.greatest(F.lit(0), F.least(F.col("block") - reach, F.col("cuts") - 1 - 2 * reach))) \
        .select(F.col("vec_id").alias("query_id"), "dim", "curve", "v",
                F.explode(F.sequence("low", F.least(F.col("low") + 2 * reach, F.col("cuts") - 1))).alias("block"))
    spot = ["dim", "curve", "block"]
    parts = placed.groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    query_parts = aims.groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / query_chunk).cast("int").alias("qparts"))
    deal = F.broadcast(written(parts.join(query_parts, spot), "curve-parts"))        # lengths x curves x blocks rows
    some = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))                  # noqa: E731
    cand = placed.join(deal, spot).select(*spot, F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"),
                                          some("qparts").alias("qpart"), "vec_id", "v")
    look = aims.join(deal, spot).select(*spot, some("parts").alias("part"),
                                        F.pmod(F.xxhash64("query_id"), "qparts").cast("int").alias("qpart"), "query_id", "v")
    by = [*spot, "part", "qpart"]
    look = look.select(*[F.col(c).alias(f"q_{c}") for c in by], "query_id", F.col("v").alias("q_v"))

    def score(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        dim = int(c["dim"].iloc[0])
        q_id, x_id = q["query_id"].to_numpy(), c["vec_id"].to_numpy()
        i, j, s = best(unpack(q["q_v"], dim), unpack(c["v"], dim), q_id, x_id, k)
        return pd.DataFrame({"query_id": q_id[i], "vec_id": x_id[j], "score": s})
    hits = cand.groupBy(*by).cogroup(look.groupBy(*[f"q_{c}" for c in by])).applyInPandas(score, "query_id long, vec_id long, score double")
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"]) \
        .select("query_id", "rank", "vec_id", "score")
