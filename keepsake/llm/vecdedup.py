"""Embedding near-duplicates by sorted projection passes.

Equal vectors of one label are one class (grouped exactly). In each pass the
classes of a label are ordered lexicographically by the 63 sign bits of random
projections (a hash of its own per pass) and each is compared with the
following ``window`` ones; as long as a block of comparisons still finds links
the window goes on, so a dense run is compared to its end and nothing is
capped. Pairs are kept only if their cosine in double precision on the original
vectors reaches the threshold; pairs of all passes are united.

A pass numbers the rows of each label in order (range partitions and offsets,
hashes only), cuts them into cells of ``CELL`` numbers and hands each cell the
``window`` rows that follow it, so a hot label spreads over many tasks and no
comparison depends on where partitions end. The rows of a cell are all compared
with each other. Cells whose last comparisons still find links go on with the
next cell, then with the next 2, 4, ... cells. A row carries its numbers in all
passes, and a pair that an earlier pass compares in any case (one cell, or
within the window there) is not emitted again.

There are at least ``passes`` passes. Two rows at the threshold differ in a
sign bit with probability q = acos(threshold) / pi and stand within the window
if they share about L = log2(classes / window) leading bits, so one pass finds
them with about (1 - q) ** L; passes are added until the expected recall of
such pairs in the largest label is ``RECALL``.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label or null vec_id, link with nothing (one
row each; component is the own id); vectors of different length never link;
repeated rows are vectors of their own with cosine 1; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import dense_index
from .common import shuffle_partitions, written
from .components import components
from .vectors import matrix, vectors

BITS = 63
BLOCK = 256
CELL = 1024
RECALL = 0.999
PLACE = ["p", "label", "dim"]


def _projection(dim: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, number]).normal(size=(dim, BITS))


def _hash(u: np.ndarray, number: int, seed: int) -> np.ndarray:
    bits = u @ _projection(u.shape[1], number, seed) > 0
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _rows_per_pass(passes: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                for at in range(0, len(part), 2000):
                    few = part.iloc[at:at + 2000]
                    x = matrix(few["v"])
                    u = x / np.linalg.norm(x, axis=1, keepdims=True)
                    for p in range(passes):
                        yield pd.DataFrame({"p": p, "label": few["label"], "dim": dim, "h": _hash(u, p, seed),
                                            "rep": few["rep"], "h1": few["h1"], "h2": few["h2"]})
    return run


def passes_for(classes: int, threshold: float, passes: int, window: int) -> int:
    """Passes for a label of ``classes`` classes: ``passes``, or as many as ``RECALL`` needs."""
    q = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    once = (1 - q) ** max(0.0, math.log2(max(1, classes) / window))
    return passes if once >= 1 else max(passes, math.ceil(math.log(1 - RECALL) / math.log1p(-once)))


def _links(u: np.ndarray, owners: int, threshold: float, window: int, least: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """:func:`links_in_order` of the first ``owners`` rows with those behind
    them (with the first ``least`` in any case), and whether links are still
    found where the rows end."""
    a, b, n, more = [], [], len(u), False
    for lo in range(0, owners, BLOCK):
        hi = min(owners, lo + BLOCK)
        to, upto = lo, min(n, max(hi + window, least))
        while to < upto:
            i, j = np.nonzero(u[lo:hi] @ u[to:upto].T >= threshold)
            i, j = i + lo, j + to
            keep = j > i
            a.append(i[keep]), b.append(j[keep])
            tail = (keep & (j >= upto - max(1, (upto - to) // 4))).any()       # links in the last quarter
            more |= bool(tail and upto == n)
            to, upto = upto, (min(n, upto + BLOCK) if tail else upto)
    return (np.concatenate(a), np.concatenate(b), more) if a else (np.empty(0, int), np.empty(0, int), False)


def links_in_order(u: np.ndarray, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of unit rows with cosine >= threshold, each row
    compared with the next ``window`` rows and on while links are found."""
    return _links(u, len(u), threshold, window)[:2]


def _not_before(at: np.ndarray, i: np.ndarray, j: np.ndarray, p: int, window: int,
                cell: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no pass before ``p`` compares in any case; ``at``: the rows' numbers per pass."""
    for q in range(p):
        x, y = at[i, q], at[j, q]
        new = (np.abs(x - y) > window) & (x // cell != y // cell)
        i, j = i[new], j[new]
    return i, j


def _compare(threshold: float, window: int, first: bool, cell: int):
    """Links of each (pass, label, dim, cell, far): of the cell's own rows with
    each other and the rows behind them (far 0), or with those of the cell
    ``far`` cells later. A row with null ``a`` says that links are still found
    where those rows end."""
    key = [*PLACE, "cell", "far"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now = None

        def links() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            x = matrix(pdf["v"])
            u, owners = x / np.linalg.norm(x, axis=1, keepdims=True), int(pdf["own"].sum())
            if first:
                i, j, more = _links(u, owners, threshold, window, owners)
            else:
                i, j = np.nonzero(u[:owners] @ u[owners:].T >= threshold)
                j, more = j + owners, False
                more = bool((j >= len(u) - max(1, (len(u) - owners) // 4)).any())
            i, j = _not_before(np.stack(pdf["ats"]), i, j, now[0], window, cell)
            rep, n = pdf["rep"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
            swap = rep[i] > rep[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            out = pd.DataFrame({"a": rep[i], "b": rep[j], "na": n[i], "nb": n[j]}).reindex(columns=["a", "b", "na", "nb", *key])
            if more:
                out.loc[len(out), key] = now
            return out.astype("Int64")
        for pdf in batches:                                   # sorted: runs of key, own rows first
            change = (pdf[key].diff().fillna(0) != 0).any(axis=1).to_numpy()
            for part in np.split(np.arange(len(pdf)), np.flatnonzero(change)):
                if not len(part):
                    continue
                rows = pdf.iloc[part[0]:part[-1] + 1]
                this = tuple(int(x) for x in rows[key].iloc[0])
                if held and this != now:
                    yield links()
                    held = []
                now = this
                held.append(rows)
        if held:
            yield links()
    return run


def _pairs(classes: DataFrame, threshold: float, passes: int, window: int, seed: int) -> DataFrame:
    """Distinct linked classes ``a < b`` (representatives) with their sizes."""
    spark, kinds = classes.sparkSession, ["label", "dim", "h1", "h2"]
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    hashed = classes.select(*kinds, "rep", "v").mapInPandas(
        _rows_per_pass(passes_for(largest, threshold, passes, window), seed),
        "p int, label long, dim int, h long, rep long, h1 long, h2 long")
    order = [*PLACE, "h", "rep", "h1", "h2"]
    numbered = dense_index(written(hashed, "vector-hashes"), order, "at", 0).drop("h", "rep")
    starts = numbered.groupBy(*PLACE).agg(F.min("at").alias("start"))
    places = written(numbered.join(starts, PLACE).withColumn("at", F.col("at") - F.col("start")).drop("start")
                     .withColumn("own_cell", F.expr(f"at div {CELL}")), "vector-places")
    ats = places.groupBy(*kinds).agg(F.sort_array(F.collect_list(F.struct("p", "at")))["at"].alias("ats"))    # one per pass
    known = written(classes.join(ats, kinds), "vector-places-seen")
    kind = "a long, b long, na long, nb long, p int, label long, dim int, cell long, far long"

    def compared(cells: DataFrame, first: bool) -> DataFrame:
        rows = cells.join(known, kinds).select(*PLACE, "cell", "far", "own", "at", "rep", "n", "v", "ats")
        rows = rows.repartition(shuffle_partitions(spark), *PLACE, "cell", "far") \
            .sortWithinPartitions(*PLACE, "cell", "far", F.desc("own"), "at")
        return written(rows.mapInPandas(_compare(threshold, window, first, CELL), kind), "vector-links")

    # a cell and the `window` rows behind it, over as many cells as that takes
    back = F.sequence(F.greatest(F.lit(0), F.expr(f"(at - {window}) div {CELL}")), F.col("own_cell"))
    cells = places.withColumn("cell", F.explode(back)) \
        .withColumn("own", F.col("cell") == F.col("own_cell")).withColumn("far", F.lit(0).cast("long"))
    found = [compared(cells, True)]
    lo, hi = 1, 2
    while True:
        # cells that still found links at the farthest place they have seen
        open_ = found[-1].where(F.col("a").isNull() & (F.col("far") == lo - 1)).select(*PLACE, "cell").distinct()
        if open_.isEmpty():
            break
        todo = open_.withColumn("far", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long"))))
        left = todo.join(places, [*[todo[c] == places[c] for c in PLACE], todo["cell"] == places["own_cell"]]) \
            .select(*[places[c] for c in places.columns], todo["cell"], todo["far"], F.lit(True).alias("own"))
        right = todo.join(places, [*[todo[c] == places[c] for c in PLACE], todo["cell"] + todo["far"] == places["own_cell"]]) \
            .select(*[places[c] for c in places.columns], todo["cell"], todo["far"], F.lit(False).alias("own"))
        found.append(compared(left.unionByName(right), False))
        lo, hi = hi, 2 * hi
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return written(every.where("a is not null").select("a", "b", "na", "nb").distinct(), "vector-pairs")


def near_vectors(embeddings: DataFrame, threshold: float = 0.98, passes: int = 12, window: int = 64,
                 seed: int = 42) -> DataFrame:
    """Per row of ``embeddings``: ``vec_id, n_links, component_id, kept``."""
    rows = vectors(embeddings)
    rows = rows.withColumn("ok", F.col("ok") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()) \
        .withColumn("h1", F.xxhash64(F.lit(1), "v")).withColumn("h2", F.xxhash64(F.lit(2), "v"))
    kinds = ["label", "dim", "h1", "h2"]
    classes = written(rows.where("ok").groupBy(*kinds).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"),
                                                           F.first("v").alias("v")), "vector-classes")
    pairs = _pairs(classes, threshold, passes, window, seed)
    linked = pairs.select(F.col("a").alias("rep"), F.col("nb").alias("m")) \
        .unionByName(pairs.select(F.col("b").alias("rep"), F.col("na").alias("m"))).groupBy("rep").agg(F.sum("m").alias("m"))
    # class representatives are the smallest ids of their classes, so the smallest node is the smallest vec_id
    reach = components(pairs, "a", "b").select(F.col("node").alias("rep"), "component")
    found = written(classes.drop("v").join(linked, "rep", "left").join(reach, "rep", "left")
                    .select(*kinds, (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"),
                            F.coalesce("component", "rep").alias("component_id")), "vector-found")
    good, bad = rows.where("ok").select("vec_id", *kinds), rows.where(~F.col("ok")).select("vec_id")
    out = good.join(found, kinds).select("vec_id", "n_links", "component_id") \
        .unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
