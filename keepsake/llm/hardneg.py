"""Hard negatives by inner product over an STR-packed R-tree.

Vectors are packed as sort-tile-recursive does: per label, slabs along the
coordinate of largest spread, tiles along the next, which become pages of at
most about ``PAGE`` rows (more rows of one tile, as copies of one vector, are
dealt to several pages); inside a page two more coordinates order the rows
into leaves of ``LEAF``. Each page and leaf has its minimum bounding box. For
an anchor ``a`` a box bounds the inner product per coordinate by
``[min(a lo, a hi), max(a lo, a hi)]``; the sums are the box's interval.

A search has score windows per anchor and wants the best ``k`` of each. Boxes
whose interval misses every window, or ends strictly below the k-th best score
found, are pruned. Anchors first search the page of largest upper bound, which
gives k-th scores; then every page that is left. Pages are taken by tasks;
inside a page each anchor's leaves come in the order of their upper bounds, in
waves of 1, 2, 4, ..., and each wave prunes with what the ones before found.

Positives are searched among the anchor's label (no window), negatives among
the other labels, one window per positive. The answer is exact whatever is
pruned. Anchors and pages meet in blocks, so no task or broadcast holds all.

Defined cases: rows with a null label, a null or empty vector, a null or
non-finite component or a null vec_id take no part; rows repeating a vec_id
are one vector (the smallest label, then vector); only vectors of one length
meet; equal scores go to the smaller vec_id; fewer than asked are all
returned; scaled components beyond +-2^60, and scores
beyond +-2^62, are cut to that; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, unpack

PAGE = 2048
LEAF = 32
NODE = 256                     # pages of one directory node
PART = 2048                    # anchors that meet a node or page together
EDGE = 1 << 62
AXES = 4


def _points(embeddings: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, dim, v``: v holds floor(scale * component) as doubles."""
    e = F.col("embedding").cast("array<double>")
    fine = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e")) \
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.coalesce(fine, F.lit(False)))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("one")).select("vec_id", "one.label", "one.e")

    def floored(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["e"].map(len), sort=False):
                x = np.clip(np.floor(np.clip(matrix(part["e"]), -2.0**60, 2.0**60) * scale), -2.0**60, 2.0**60)
                yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "dim": dim,
                                    "v": [r.tobytes() for r in x.astype("<f8")]})
    return written(one.mapInPandas(floored, "vec_id long, label long, dim int, v binary"), "floored-vectors")


def _axes(points: DataFrame) -> dict[int, list[int]]:
    """The coordinates of largest spread for each vector length."""
    def sums(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                x = unpack(part["v"], dim)
                yield pd.DataFrame({"dim": dim, "axis": np.arange(dim), "n": len(x), "s": x.sum(axis=0), "q": (x * x).sum(axis=0)})
    spread = F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), F.lit(2))
    wide = points.mapInPandas(sums, "dim int, axis int, n long, s double, q double").groupBy("dim", "axis").agg(spread.alias("wide"))
    best = Window.partitionBy("dim").orderBy(F.desc("wide"), "axis")
    out: dict[int, list[int]] = {}
    for r in wide.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= AXES).orderBy("dim", "nth").collect():
        out.setdefault(r["dim"], []).append(r["axis"])       # at most AXES for each length
    return out


def _cut(rows: DataFrame, by: list[str], axis: str, name: str, pages: Column) -> DataFrame:
    """``rows`` with the number of their quantile along ``axis`` within ``by``;
    ``pages`` (of the row count ``n``) says how many quantiles."""
    cuts = rows.groupBy(*by).agg(F.percentile_approx(axis, [i / 256 for i in range(1, 256)], F.lit(10000)).alias("q"),
                                 F.count(F.lit(1)).alias("n")).withColumn("m", F.least(pages, F.lit(256)).cast("int"))
    edges = F.when(F.col("m") > 1, F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda i: F.get(
        "q", (i * 256 / F.col("m")).cast("int") - 1))).otherwise(F.array().cast("array<double>"))
    cuts = cuts.select(*by, edges.alias("edges"))
    return rows.join(cuts, by).withColumn(name, F.size(F.filter("edges", lambda c: c < F.col(axis)))).drop("edges")


def pages_of(points: DataFrame) -> DataFrame:
    """The tree's pages: ``page, label, dim, ids, v, lo, hi`` (packed)."""
    axes = _axes(points)

    def places(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                x, own = unpack(part["v"], dim), axes[dim]
                yield part.assign(**{f"t{k}": x[:, own[min(k, len(own) - 1)]] for k in range(AXES)})
    rows = points.mapInPandas(places, "vec_id long, label long, dim int, v binary, t0 double, t1 double, t2 double, t3 double")
    n = F.col("n").cast("double")
    rows = _cut(rows, ["label", "dim"], "t0", "slab", F.ceil(F.sqrt(F.ceil(n / PAGE))))
    rows = _cut(rows, ["label", "dim", "slab"], "t1", "tile", F.ceil(n / PAGE))
    tile = ["label", "dim", "slab", "tile"]
    parts = rows.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / PAGE).alias("parts"))
    rows = rows.join(parts, tile).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        t2, t3 = pdf["t2"].to_numpy(), pdf["t3"].to_numpy()
        side = max(1, round((len(pdf) / LEAF) ** 0.5))
        slab = np.argsort(np.lexsort((pdf["vec_id"], t2))) * side // len(pdf)
        pdf = pdf.iloc[np.lexsort((pdf["vec_id"], t3, slab))]
        x = unpack(pdf["v"], int(pdf["dim"].iloc[0]))
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[0], "v": x.astype("<f8").tobytes(),
                             "ids": pdf["vec_id"].to_numpy("<i8").tobytes(),
                             "lo": x.min(axis=0).astype("<f8").tobytes(), "hi": x.max(axis=0).astype("<f8").tobytes()})
    packed = rows.groupBy(*tile, "part").applyInPandas(pack, "label long, dim int, v binary, ids binary, lo binary, hi binary")
    return written(packed.withColumn("page", F.monotonically_increasing_id()), "rtree-pages")


def intervals(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product of each row of ``a`` with any vector
    of each box, safe against rounding."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    low, high = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    slack = 1e-12 * (np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T)
    return low - slack, high + slack


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows holding whole numbers."""
    if np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * a.shape[1] < 2.0**53:
        return (a @ x.T).astype(np.int64)
    exact = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object)      # noqa: E731
    return np.clip(exact(a) @ exact(x).T, -EDGE, EDGE).astype(np.int64)


def search_page(a: np.ndarray, a_id: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """Of one page: ``(anchor, window, id, score)`` of the best ``k`` in each
    window [low, high] of each anchor (rows of ``a``), best first. ``low`` may
    be the k-th best score known."""
    low = low.copy()
    starts = np.arange(0, len(x), LEAF)
    lower, upper = intervals(a, np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts))
    order = np.argsort(-upper, axis=1, kind="stable")
    held = [np.empty(0, np.int64)] * 4
    every, at, wave = np.arange(len(a))[:, None], 0, 1
    while at < len(starts):
        leaf = order[:, at:at + wave]
        up, down = upper[every, leaf], lower[every, leaf]
        need = ((up[:, :, None] >= low[:, None, :]) & (down[:, :, None] <= high[:, None, :])).any(axis=2)
        at, wave = at + wave, 2 * wave
        who, col = np.nonzero(need)
        leaves = leaf[who, col]
        by_leaf = np.argsort(leaves, kind="stable")
        found = [held]
        cut = np.flatnonzero(np.diff(leaves[by_leaf])) + 1 if len(who) else np.empty(0, int)
        for part in np.split(by_leaf, cut) if len(who) else []:
            rows, first = who[part], starts[leaves[part[0]]]
            own = ids[first:first + LEAF]
            score = products(a[rows], x[first:first + LEAF])
            other = own[None, :] != a_id[rows][:, None]
            for w in range(low.shape[1]):
                i, j = np.nonzero(other & (score >= low[rows, w][:, None]) & (score <= high[rows, w][:, None]))
                found.append([rows[i], np.full(len(i), w), own[j], score[i, j]])
        if len(found) > 1:
            q, w, v, s = (np.concatenate([f[c] for f in found]) for c in range(4))
            best = np.lexsort((v, -s, w, q))
            q, w, v, s = q[best], w[best], v[best], s[best]
            spot = q * low.shape[1] + w
            nth = np.arange(len(q)) - np.searchsorted(spot, spot)
            last = nth == k - 1
            low[q[last], w[last]] = s[last]
            held = [c[nth < k] for c in (q, w, v, s)]
    return held


def _bounds(column: pd.Series, fill: int) -> np.ndarray:
    wide = max(map(len, column))
    return np.array([[*map(int, v), *[fill] * (wide - len(v))] for v in column], np.int64).reshape(len(column), wide)


def _meet(anchors: DataFrame, pages: DataFrame, same: bool, seed: bool) -> DataFrame:
    """``vec_id, page`` of the pages each anchor has to search: the one of
    largest upper bound (``seed``), or all others not pruned."""
    spark = anchors.sparkSession
    nodes, parts = max(1, -(-pages.count() // NODE)), max(1, -(-anchors.count() // PART))
    spot = ["dim", "node", "part"]
    tree = pages.select("dim", F.pmod(F.xxhash64("page"), F.lit(nodes)).cast("int").alias("node"),
                        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "page", "label", "lo", "hi")
    look = anchors.select("dim", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"),
                          F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"),
                          *[c for c in anchors.columns if c != "dim"])

    def run(boxes: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(boxes) or not len(q):
            return pd.DataFrame({"vec_id": [], "page": [], "bound": []})
        dim = int(q["dim"].iloc[0])
        lower, upper = intervals(unpack(q["v"], dim), unpack(boxes["lo"], dim), unpack(boxes["hi"], dim))
        low, high = _bounds(q["low"], EDGE), _bounds(q["high"], -EDGE)
        use = (q["label"].to_numpy()[:, None] == boxes["label"].to_numpy()[None, :]) == same
        hit = np.zeros(use.shape, bool)
        for w in range(low.shape[1]):
            hit |= (upper >= low[:, w:w + 1]) & (lower <= high[:, w:w + 1])
        use &= hit
        if seed:
            first = np.where(use, upper, -np.inf).argmax(axis=1)
            only = np.zeros(use.shape, bool)
            only[np.arange(len(q)), first] = True
            use &= only
        else:
            use &= q["seen"].to_numpy(np.int64)[:, None] != boxes["page"].to_numpy(np.int64)[None, :]
        i, j = np.nonzero(use)
        return pd.DataFrame({"vec_id": q["vec_id"].to_numpy()[i], "page": boxes["page"].to_numpy()[j], "bound": upper[i, j]})
    got = tree.groupBy(*spot).cogroup(look.groupBy(*spot)).applyInPandas(run, "vec_id long, page long, bound double")
    if not seed:
        return got.select("vec_id", "page")
    top = got.groupBy("vec_id").agg(F.max(F.struct("bound", "page")).alias("top"))
    return top.select("vec_id", "top.page")


def _visit(meet: DataFrame, anchors: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """``anchor, window, id, score``: the best k of each page met, ranked over pages."""
    parts = meet.groupBy("page").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    look = meet.join(parts, "page").join(anchors.select("vec_id", "v", "low", "high"), "vec_id") \
        .select("page", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), "vec_id", F.col("v").alias("q_v"), "low", "high")
    rows = pages.join(parts, "page").select("page", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "dim", "ids", "v")

    def run(page: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(page) or not len(q):
            return pd.DataFrame({"anchor": [], "window": [], "id": [], "score": []})
        dim = int(page["dim"].iloc[0])
        a_id = q["vec_id"].to_numpy(np.int64)
        i, w, v, s = search_page(unpack(q["q_v"], dim), a_id, _bounds(q["low"], EDGE), _bounds(q["high"], -EDGE),
                                 np.frombuffer(page["ids"].iloc[0], "<i8"), unpack(page["v"], dim), k)
        return pd.DataFrame({"anchor": a_id[i], "window": w, "id": v, "score": s})
    return rows.groupBy("page", "part").cogroup(look.groupBy("page", "part")).applyInPandas(
        run, "anchor long, window int, id long, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)


def best_in_windows(anchors: DataFrame, pages: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor, window, nth, id, score``: for each row of ``anchors``
    (``vec_id, label, dim, v, low, high``; low and high are arrays, one entry
    per window) the best ``k`` rows of the same or of other labels."""
    seen = written(_meet(anchors, pages, same, True), "rtree-first-pages")
    first = written(_ranked(_visit(seen, anchors, pages, k), k), "rtree-first-hits")
    kth = first.where(F.col("nth") == k).groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))      # one entry per window
    low = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("kth", w), x)))
    then = anchors.join(kth, F.col("anchor") == F.col("vec_id"), "left") \
        .join(seen.select(F.col("vec_id").alias("by"), F.col("page").alias("seen")), F.col("by") == F.col("vec_id"), "left") \
        .select("vec_id", "label", "dim", "v", low.alias("low"), "high", F.coalesce("seen", F.lit(-1).cast("long")).alias("seen"))
    then = written(then, "rtree-anchors")
    rest = _visit(written(_meet(then, pages, same, False), "rtree-pages-left"), then, pages, k)
    return _ranked(first.drop("nth").unionByName(rest), k)


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low_percent: int = 50,
         high_percent: int = 95, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each row with ``is_anchor`` (a condition on vec_id)
    and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels that score between ``low_percent`` and
    ``high_percent`` of the positive."""
    points = _points(embeddings, scale)
    pages = pages_of(points)
    anchors = points.where(is_anchor)
    open_ = lambda x: F.array(F.lit(x).cast("long"))                                   # noqa: E731
    found = best_in_windows(written(anchors.withColumn("low", open_(-EDGE)).withColumn("high", open_(EDGE)), "hard-anchors"),
                            pages, positives, True)
    hundreds = F.expr("(score - pmod(score, 100)) div 100")
    low = hundreds * low_percent + F.expr(f"(pmod(score, 100) * {low_percent} + 99) div 100")
    high = hundreds * high_percent + F.expr(f"(pmod(score, 100) * {high_percent}) div 100")
    pairs = written(found.select("anchor", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                                 low.alias("low"), high.alias("high")), "hard-positives")
    asked = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "low", "high"))).alias("w"))   # <= positives
    asked = asked.join(anchors, F.col("anchor") == F.col("vec_id")).select(
        "vec_id", "label", "dim", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    hard = best_in_windows(written(asked, "hard-windows"), pages, negatives, False)
    hard = hard.select("anchor", (F.col("window") + 1).alias("of"), F.col("nth").alias("rank"), F.col("id").alias("negative_id"),
                       F.col("score").alias("negative_score"))
    return hard.join(pairs, (hard["anchor"] == pairs["anchor"]) & (hard["of"] == pairs["nth"])).select(
        pairs["anchor"].alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
