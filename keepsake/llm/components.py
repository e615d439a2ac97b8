"""Connected components of an edge table by alternating star contractions.

Large-star links every larger neighbour of a node to the smallest id around
it, small-star links every smaller neighbour (and the node) to it; repeated
until no edge changes, each component is a star on its smallest id. Each
round is written below ``spark.checkpoint.dir``, so a lost executor re-reads
a table instead of replaying rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their smallest reachable node, for the edges ``u - v``.

    Vectorised: every edge pulls both roots to the smaller one and parents are
    shortened by pointer jumping until all edges join equal roots.
    """
    if not len(u):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while not (root == (jumped := root[root])).all():
            root = jumped


def _local_stars(batches):
    """Edges of one partition replaced by one star per local component."""
    nodes = low = np.empty(0, np.int64)
    for pdf in batches:
        nodes, low = forest(np.concatenate([nodes, pdf["u"].to_numpy(np.int64)]),
                            np.concatenate([low, pdf["v"].to_numpy(np.int64)]))
    keep = nodes != low
    yield pd.DataFrame({"u": nodes[keep], "v": low[keep]})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges                                  # u > v in every stored edge
    lowest = around.groupBy("u").agg(F.min("v").alias("m"))
    lowest = lowest.select("u", F.least("u", "m").alias("m"))
    joined = around.join(lowest, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(lowest.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node of an edge; ``component`` is
    the smallest node reachable. Loops, repeated edges and both directions are
    allowed; edges with a null end are ignored; no edges give no rows.

    Partitions first replace their own edges by stars (memory: the nodes of
    one partition), which leaves few rounds.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
        .where(a.isNotNull() & b.isNotNull() & (a != b))
    cur = written(clean.mapInPandas(_local_stars, "u long, v long").distinct(), "components")
    state = None
    for _ in range(max_rounds):
        found = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
        nxt = written(_star(_star(cur, True), False), "components")
        drop_written(cur)
        cur = nxt
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
