"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, ``shingle`` words
space-joined (fewer words: the whole sequence), XXH64 of the UTF-8 bytes with
seed 42; a bit is 1 if it is set in over half of the hashes, repeats counted.
No words: fingerprint 0.

Linking: the 64 bits are cut into ``blocks`` runs. Two fingerprints at
``max_bits`` or fewer differing bits agree on at least ``blocks - max_bits``
whole runs, so they meet under one of the C(blocks, max_bits) choices of
agreeing runs: rows are dealt by (choice, bits of those runs) and each pair
under one key is verified by Hamming distance. Only distinct fingerprints are
dealt, and a task emits the edges of a spanning forest of the pairs it has
verified, never the pairs. A key with more than ``chunk`` fingerprints is cut
into chunks; each pair of its chunks is a key of its own, so no task holds an
unbounded group and no pair is lost.

Defined cases: null, empty or blank text has fingerprint 0 and links like any
other; repeated rows return one row each; a row without doc_id gets its
fingerprint but no component and links nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import itertools
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, shuffle_partitions, written
from .components import components, forest

SEED = 42
#: Block keys are counted by hash cell; cells above ``chunk`` rows are cut into chunks.
CELLS = 1 << 18
#: Hot cells (at most 35 fingerprints / chunk) are broadcast up to this number, 12 bytes each.
HOT_CELLS = 2_000_000
_SPACE = bytes.maketrans(UPPER.encode() + b"\t\n\x0b\x0c\r", LOWER.encode() + b"     ")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "replace").translate(_SPACE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())),
                         np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` per row; ``fp`` is the fingerprint as a signed long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"],
                                "fp": [_signed(fingerprint(t if isinstance(t, str) else None, shingle))
                                       for t in pdf["text"]]})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInPandas(run, "doc_id long, fp long")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Bit masks of every choice of ``blocks - max_bits`` whole runs."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in itertools.combinations(runs, blocks - max_bits)]


def _near_in_runs(keys: np.ndarray, fps: np.ndarray, side: np.ndarray, max_bits: int):
    """Forest edges of the verified pairs inside runs of equal keys; rows of
    side 1 and side 2 meet only each other, rows of side 0 meet all."""
    n = len(keys)
    same = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.empty(0, np.int64)
    end = np.repeat(np.append(same[1:], n), np.diff(np.append(same, n)))
    us, vs, step, at = [], [], 1, np.arange(n)
    at = at[at + 1 < end]
    while len(at):
        near = np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits
        near &= (side[at] == 0) | (side[at] != side[at + step])
        if near.any():
            us.append(fps[at[near]]), vs.append(fps[at[near] + step])
            if sum(map(len, us)) > 1_000_000:
                u, v = forest(np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64))
                us, vs = [u.view(np.uint64)], [v.view(np.uint64)]
        step += 1
        at = at[at + step < end[at]]
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, v = forest(np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64))
    return u[u != v], v[u != v]


def _verify(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def edges(pdf: pd.DataFrame) -> pd.DataFrame:
            change = (pdf[["m", "b", "c"]].diff().fillna(0) != 0).any(axis=1).to_numpy()
            u, v = _near_in_runs(np.cumsum(change), pdf["fp"].to_numpy(np.int64).view(np.uint64),
                                 pdf["side"].to_numpy(), max_bits)
            return pd.DataFrame({"u": u, "v": v})
        for pdf in batches:            # sorted by key; the last key of a batch may go on in the next
            last = pdf[["m", "b", "c"]].iloc[-1]
            cut = int((pdf[["m", "b", "c"]] != last).any(axis=1).to_numpy().sum())
            if cut:
                yield edges(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield edges(pd.concat(held, ignore_index=True))
    return run


def near_edges(fps: DataFrame, max_bits: int = 4, blocks: int = 7, chunk: int = 20_000) -> DataFrame:
    """Spanning edges ``(u, v)`` of all pairs of distinct ``fp`` at
    ``max_bits`` or fewer differing bits."""
    masks = block_masks(blocks, max_bits)
    dealt = fps.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("m", "mask")) \
        .select("m", F.col("fp").bitwiseAND(F.col("mask")).alias("b"), "fp")
    # cells grow with the rows, a quarter chunk each on average, so a hot cell holds a hot key
    cell = F.pmod(F.xxhash64("m", "b"), F.lit(max(CELLS, 4 * len(masks) * fps.count() // chunk)))
    hot = dealt.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk) \
        .select("cell", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    hot = written(hot, "simhash-hot-cells")
    hot = F.broadcast(hot) if hot.count() <= HOT_CELLS else hot
    rows = dealt.withColumn("cell", cell).join(hot, "cell", "left") \
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # chunk pair (i <= j) is numbered i * parts + j; a chunk meets itself (side 0) and every other
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
        (F.least(j, F.col("own")) * F.col("parts") + F.greatest(j, F.col("own"))).alias("c"),
        F.when(j == F.col("own"), 0).when(j > F.col("own"), 1).otherwise(2).alias("side")))
    rows = rows.withColumn("own", own).select("m", "b", "fp", F.inline(meets).alias("c", "side"))
    n = shuffle_partitions(fps.sparkSession)
    return rows.repartition(n, "m", "b", "c").sortWithinPartitions("m", "b", "c") \
        .mapInPandas(_verify(max_bits), "u long, v long")


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (16 lowercase hex
    digits) and ``component_id`` (smallest doc_id reachable by links)."""
    prints = written(fingerprints(docs, shingle), "simhash")
    classes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    linked = components(near_edges(classes.select("fp"), max_bits, blocks))
    smallest = linked.join(classes, linked["node"] == classes["fp"]).groupBy("component").agg(F.min("rep").alias("low"))
    of_fp = classes.join(linked, classes["fp"] == linked["node"], "left").join(smallest, "component", "left") \
        .select("fp", F.coalesce("low", "rep").alias("component_id"))
    out = prints.join(of_fp, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is their group's component id, with their
    columns; of rows repeating a kept doc_id the one of smallest hash over its
    columns stays, rows without doc_id stay."""
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant", "struct", "array"))]
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(*plain).alias("order"))
    once = rows.where("id is not null").join(kept, F.col("id") == F.col("kept_id"), "left_semi") \
        .groupBy("id").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return once.unionByName(rows.where("id is null").select("row.*"))
