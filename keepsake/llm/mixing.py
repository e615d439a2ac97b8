"""Mixing sources to target weights by subset-sum budget fitting.

1. Targets: the weights share the sum of all sizes; a target stops at
   ``max_repeats`` times its source's size and the excess goes to the others
   by weight until none is above.
2. Every document of a source is taken floor(target / size) times; the
   remaining budget is fitted from counts per exact length: each length first
   gives its proportional share, long lengths close the gap to ``window``
   words, and a bounded knapsack over the remaining counts (sums reachable up
   to twice the rest of the budget, as only sums nearer than none matter, with
   the item that first reached each) finds the nearest sum. If more than
   ``window`` words stay because every document left is longer, the documents
   above ``window`` words are chosen anew by a knapsack over sparse sums (one
   sum in each unit of a 2**20th of the range) and the shorter ones fill what
   they leave. One task handles one source's counts, whose rows are its
   distinct lengths.
3. The chosen number of documents of each length is filled in the order of a
   seeded hash: counts per hash bucket decide whole buckets, and only the
   bucket that the count ends in is ranked, so no length, however common, is
   ordered in one task.

Size: number of ``[^\\x20\\x09-\\x0D]+`` in the whole text.

Defined cases: null and empty texts have size 0 and are taken 0 words; a null
source is a source of its own, last in order; repeated rows and ties of the
hash are interchangeable (equal rows), so the multiset of results is the same
in each run; a null doc_id is an ordinary row; an empty table gives no rows;
other columns are ignored. The driver holds one row per source.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 1000
UNITS = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: float = 3) -> list[float]:
    """Targets of the sources, in the given order (see step 1)."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        full = [i for i in open_ if share[i] > max_repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take: 0 <= k <= counts, and
    sum(k * lengths) the nearest to ``budget`` that step 2 reaches."""
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(a * b for a, b in zip(lengths, counts))
    budget = max(0, min(int(budget), total))
    if not total or not budget:
        return np.zeros(len(lengths), np.int64)
    k = [c * budget // total for c in counts]
    rest = budget - sum(a * b for a, b in zip(lengths, k))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest <= window:
            break
        if lengths[i]:
            more = min(counts[i] - k[i], rest // lengths[i], -(-(rest - window) // lengths[i]))
            k[i] += more
            rest -= more * lengths[i]
    if rest > window:
        return _fit_long(lengths, counts, budget, window, np.array(k, np.int64))
    top = 2 * rest                                         # sums above may be nearer, up to as far as none
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    first = np.full(top + 1, -1, np.int32)
    items: list[tuple[int, int]] = []                      # (index of the length, documents in the item)
    for i in np.argsort(lengths, kind="stable")[::-1]:
        have = min(counts[i] - k[i], top // lengths[i]) if lengths[i] else 0
        part = 1
        while have > 0 and not reach[rest]:                # binary splitting of the bounded count
            n = min(part, have)
            w = n * lengths[i]
            new = np.flatnonzero(reach[:-w] & ~reach[w:]) + w
            first[new] = len(items)
            reach[new] = True
            items.append((int(i), n))
            have, part = have - n, part * 2
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])         # the smaller of two equally near
    while at:
        i, n = items[first[at]]
        k[i] += n
        at -= n * lengths[i]
    return np.array(k, np.int64)


def _fit_long(lengths: list[int], counts: list[int], budget: int, window: int, fallback: np.ndarray) -> np.ndarray:
    """The fit where documents above ``window`` words decide, ``fallback``
    unless a sum is nearer."""
    size = np.array(lengths, np.int64)
    k = np.zeros(len(size), np.int64)
    short = size <= window
    fill = int((size[short] * np.array(counts, np.int64)[short]).sum())       # what the short ones can add
    miss = abs(budget - int((fallback * size).sum()))
    top = budget + miss                                    # sums above this are no nearer
    unit = top // UNITS + 1
    sums = np.full(top // unit + 1, -1, np.int64)          # the first sum found in each unit, how, and from which
    how, base = np.full(len(sums), -1, np.int32), np.full(len(sums), -1, np.int32)
    sums[0] = 0
    items: list[tuple[int, int]] = []

    def gaps(s: np.ndarray) -> np.ndarray:
        return np.where(s > budget, s - budget, np.maximum(0, budget - s - fill))
    best, least = 0, int(gaps(sums[:1])[0])
    for i in np.argsort(-size, kind="stable"):
        if short[i] or least < unit:
            break
        have, part = min(counts[i], top // lengths[i]), 1
        while have > 0 and least >= unit:                  # binary splitting of the bounded count
            n = min(part, have)
            old = np.flatnonzero(sums >= 0)
            new = sums[old] + n * lengths[i]
            keep = new <= top
            at, first = np.unique(new[keep] // unit, return_index=True)
            old, new = old[keep][first], new[keep][first]
            free = sums[at] < 0
            at, old, new = at[free], old[free], new[free]
            if len(at):
                sums[at], how[at], base[at] = new, len(items), old
                gap = gaps(new)
                near = int(gap.argmin())
                if gap[near] < least:
                    best, least = int(at[near]), int(gap[near])
            items.append((int(i), n))
            have, part = have - n, part * 2
    taken = int(sums[best])
    while how[best] >= 0:
        i, n = items[how[best]]
        k[i] += n
        best = int(base[best])
    if short.any() and taken < budget:
        k[short] = fit_budget(size[short], np.array(counts)[short], budget - taken, window)
    return k if abs(budget - int((k * size).sum())) < miss else fallback


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = 3, seed: int = 42,
        window: int = 1 << 16) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): ``doc_id, source, size,
    source_size, target, taken, repeats`` with ``taken = size * repeats``."""
    spark = docs.sparkSession
    source = F.col("source").cast("string")
    rows = written(docs.select(
        "doc_id", source.alias("source"), F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("k"),
        word_count(F.col("text")).alias("size")), "mixing")
    counts = rows.groupBy("k", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("k").agg(F.sum(F.col("size") * F.col("n")).alias("s")).orderBy("k").collect()
    goal = targets([r["s"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], max_repeats)
    goals = spark.createDataFrame([(r["k"], r["s"], t) for r, t in zip(totals, goal)],
                                  "k string, source_size long, target double")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(max_repeats, int(target // size)) if size else 0
        budget = round(target - whole * size) if whole < max_repeats else 0
        pdf = pdf.sort_values("size", ignore_index=True)
        return pdf.assign(whole=whole, extra=fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget, window))

    planned = counts.join(F.broadcast(goals), "k").groupBy("k").applyInPandas(
        plan, "k string, size long, n long, source_size long, target double, whole int, extra long")
    planned = written(planned, "mixing-plan")
    chosen = written(rows.join(planned, ["k", "size"]).withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id")))
                     .withColumn("b", F.pmod("h", F.ceil(F.col("n") / BUCKET_ROWS))), "mixing-rows")
    partial = chosen.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    upto = Window.partitionBy("k", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = partial.groupBy("k", "size", "b").agg(F.count(F.lit(1)).alias("bn"), F.first("extra").alias("x")) \
        .withColumn("before", F.coalesce(F.sum("bn").over(upto), F.lit(0))) \
        .select("k", "size", "b", F.greatest(F.lit(0), F.least("bn", F.col("x") - F.col("before"))).alias("need"), "bn")
    buckets = written(buckets, "mixing-buckets")
    inside = partial.join(buckets, ["k", "size", "b"])
    rank = F.row_number().over(Window.partitionBy("k", "size", "b").orderBy("h", "doc_id"))
    ranked = inside.where((F.col("need") > 0) & (F.col("need") < F.col("bn"))).withColumn("more", (rank <= F.col("need")).cast("int"))
    settled = inside.where((F.col("need") == 0) | (F.col("need") == F.col("bn"))).withColumn("more", (F.col("need") > 0).cast("int"))
    plain = chosen.where((F.col("extra") == 0) | (F.col("extra") == F.col("n"))) \
        .withColumn("more", ((F.col("extra") > 0)).cast("int"))
    cols = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).alias("repeats")]
    out = plain.select(*cols).unionByName(settled.select(*cols)).unionByName(ranked.select(*cols))
    return out.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def repeat_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, with their columns;
    ``mixed`` is :func:`mix` of the same rows. Equal (doc_id, source, size)
    rows are paired by number."""
    key = ["i", "s", "n", "nth"]
    number = F.row_number().over(Window.partitionBy("i", "s", "n").orderBy("x"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"),
                       F.col("source").cast("string").alias("s"), word_count(F.col("text")).alias("n"),
                       F.xxhash64("text").alias("x")).withColumn("nth", number)
    right = mixed.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("n"),
                         F.col("repeats").alias("x")).withColumn("nth", number)
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in key], F.col("x").alias("repeats"))
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in key]
    return left.join(right, same).where("repeats > 0") \
        .select("row", F.explode(F.sequence(F.lit(1), "repeats"))).select("row.*")
