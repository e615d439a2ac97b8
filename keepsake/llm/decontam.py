"""Benchmark decontamination with a broadcast hash set of n-gram windows.

A window is ``n`` consecutive words of a benchmark item; a shorter item, if
not empty, is one window. The distinct windows, under a 64-bit hash, are the
broadcast side. The corpus is scanned once: each document hashes the window at
every word, hashes are looked up, and a hit counts only if the words
themselves are equal. Documents are never shuffled; only hits and one narrow
row per document are, to be joined per row again.

The broadcast holds at most ``MAX_WINDOWS`` windows and item links; a larger
benchmark is cut into blocks of that size by hash, with one scan per block
over a written copy of the documents. DataFrame functions only.

Defined cases: a null text has no words; an item without words, and a null
item text, have no windows; an item without id marks words but is not listed;
items of one id are one item; repeated documents are judged one by one, also
without a doc_id; an empty benchmark hits nothing; an empty corpus gives no
rows; other columns are ignored (``scan``) or kept (``remove_*``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

# Characters between words, before and after A-Z is lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Windows, and links of windows to items, in one broadcast: about 300 bytes each.
MAX_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Normalised words of a text, in order."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), GAP), "")


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows: ``h`` (hash), ``size``, ``w`` (words), ``items`` (ids as text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("all")) \
        .where(F.size("all") > 0).withColumn("size", F.least(F.size("all"), F.lit(n)))
    each = items.select("item", "size", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("all") - F.col("size") + 1), lambda i: F.slice("all", i, F.col("size")))).alias("w"))
    return each.groupBy("w", "size").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("w"))


def _found(docs: DataFrame, block: DataFrame, sizes: list[int], first: bool) -> DataFrame:
    """Hits of one block of windows, and (``first``) one row without a hit per document."""
    size = F.lit(sizes[0]) if len(sizes) == 1 else F.col("window")
    if len(sizes) > 1:
        docs = docs.withColumn("window", F.explode(F.array(*[F.lit(s) for s in sizes])))
    # place 0 stands for the document itself
    hashes = F.when(F.col("n_words") >= size, F.transform(
        F.sequence(F.lit(1), F.col("n_words") - size + 1), lambda i: F.xxhash64(F.slice("all", i, size))))
    at = F.posexplode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(hashes, F.array().cast("array<long>"))))
    every = docs.select(*docs.columns, at.alias("place", "hash"))
    same = (F.col("hash") == F.col("h")) & (F.slice("all", F.greatest("place", F.lit(1)), size) == F.col("w"))
    every = every.join(F.broadcast(block), same, "left")
    own = (F.col("place") == 0) & F.lit(first) & (size == sizes[0])
    return every.where(F.col("h").isNotNull() | own).drop("all", "window", "hash", "h", "w")


def _scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int) -> DataFrame:
    known = written(windows(benchmark, n), "benchmark-windows")
    facts = known.agg(F.count(F.lit(1)), F.sum(F.size("items")), F.collect_set("size")).first()
    blocks = max(1, -(-max(facts[0], facts[1] or 0) // MAX_WINDOWS))
    sizes = sorted(facts[2]) or [n]                        # at most n different
    rows = docs.select(F.struct(*keep).alias("kept"), "text", F.monotonically_increasing_id().alias("row"))
    if blocks > 1:
        rows = written(rows, "decontaminated-documents")   # the same row numbers in every scan
    rows = rows.select("row", "kept", words(F.col("text")).alias("all")).withColumn("n_words", F.size("all"))
    hits = None
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b).select("h", "w", "size", "items")
        found = _found(rows, part, sizes, b == 0)
        hits = found if hits is None else hits.unionByName(found)
    spot = F.when(F.col("size").isNotNull(), F.struct((F.col("place") - 1).alias("a"), (F.col("place") + F.col("size") - 2).alias("b")))
    grouped = hits.groupBy("row").agg(F.first("kept").alias("kept"), F.first("n_words").alias("n_words"),
                                      F.collect_list(spot).alias("spots"), F.collect_set("items").alias("items"))
    covered = F.sort_array(F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["a"], s["b"])))))
    return grouped.select("kept", "n_words", covered.alias("covered"),
                          F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, n: int = 10) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns, ``n_words``, ``n_hit`` (words
    inside occurring windows), ``item_ids`` (as sorted text) and ``spans`` of
    hit words (``first``, ``last``, from 0)."""
    keep = keep or ["doc_id"]
    c = F.col("covered")
    edge = lambda step: F.filter(c, lambda x, i: ~F.coalesce(F.get(c, i + step) == x + step, F.lit(False)))
    spans = F.transform(F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last")),
                        lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    return _scan(docs, benchmark, keep, n).select("kept.*", F.col("n_words").cast("long").alias("n_words"),
                                                  F.size(c).cast("long").alias("n_hit"), F.col("items").alias("item_ids"),
                                                  F.when(F.size(c) > 0, spans).otherwise(F.array().cast(
                                                      "array<struct<first:int,last:int>>")).alias("spans"))


def _marked(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """``doc`` (all columns), ``n_words``, ``n_hit`` and ``spans``, null where nothing is hit."""
    whole = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                                F.monotonically_increasing_id().alias("mark")), "documents-to-clean")
    hit = scan(whole.select("mark", F.col("doc.text").alias("text")), benchmark, ["mark"], n).where("n_hit > 0")
    return whole.join(hit.drop("item_ids"), "mark", "left").drop("mark")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, share: float = 0.0) -> DataFrame:
    """``docs`` without those of whose words more than ``share`` are hit."""
    clean = F.coalesce(F.col("n_hit") / F.col("n_words"), F.lit(0.0)) <= share
    return _marked(docs, benchmark, n).where(clean).select("doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``, each with the characters
    up to the next word; texts without a hit stay as they are."""
    text = F.col("doc.text").cast("string")
    rows = _marked(docs, benchmark, n).select("doc", "spans", "n_words", F.when(F.col("spans").isNotNull(), F.split(text, RAW_WORD)).alias("gaps"),
                                              F.when(F.col("spans").isNotNull(), F.array_remove(F.split(text, RAW_GAP), "")).alias("own"))
    pieces = F.transform("own", lambda w, i: F.concat(w, F.get("gaps", i + 1)))
    rows = rows.select("doc", "spans", "n_words", F.get("gaps", F.lit(0)).alias("head"), pieces.alias("pieces"))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["last"] + 1))
    ends = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.col("n_words").cast("int")))
    left = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")),
                       lambda s: F.array_join(F.slice("pieces", s["a"] + 1, s["b"] - s["a"]), ""))
    clean = F.when(F.col("spans").isNotNull(), F.concat("head", F.array_join(left, ""))).otherwise(F.col("doc.text"))
    return rows.select(F.col("doc").withField("text", clean).alias("doc")).select("doc.*").select(*docs.columns)
