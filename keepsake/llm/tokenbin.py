"""Token-ID output: files of independently decodable rANS blocks.

Layout of a written corpus (one folder):

* ``tokens``: rows of the ids in ascending doc_id order (null first, equal ids
  by the hash of their ids); staged, removed once the blocks are written;
* ``table``: the shared frequency table, one row per used symbol;
* ``blocks``: one row per block: file number, block number, position of its
  first id inside the file, its documents (ids and lengths) and its payload
  (lane states, words, checkpoints, CRC-32). Blocks hold whole documents, about
  ``block_ids`` ids; a longer document is a block of its own;
* ``files``: one row per file with its number of ids, from which starts follow.

The folders are Spark tables, so the commit protocol of Spark's writers keeps
each file whole when tasks are retried. The frequency table is counted over
all documents. Text is encoded by the tokenizers library without special
tokens, and ``END`` closes each document. Because the vocabulary drops white
space before it cuts words, a text is the concatenation of its blank-separated
chunks; distinct chunks are encoded once per Python worker, in a bounded cache.

Defined cases: a null or empty text is the end id alone; a null doc_id is a
document, before all others; repeated rows are documents of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import compress
from operator import not_
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from .common import drop_written, shuffle_partitions, slices
from .rans import Table, decode_blocks, encode_blocks

END = 1
BLOCK_IDS = 1 << 16
CACHE_CHUNKS = 1_500_000
CLOSING = ",.;:!?"
SMALL_LETTERS = re.compile("[a-zªµºß-öø-ÿ]+").fullmatch
class ChunkEncoder:
    """The tokenizers library behind a cache of blank-separated chunks.

    Chunks that are new in a slice go to the library in few long texts, with a
    special token between them (its id marks the borders); chunks that may
    hold a special token themselves go alone. A word with one closing mark is
    the word and the mark, which the vocabulary's pre-tokenizer parts anyway.
    Latin-1 texts are lower-cased beforehand, as the vocabulary does. Words of
    small Latin-1 letters need no normalizer and no pattern: spelled in the
    library's byte letters they go through the same model with a blank between
    them, and the ids that close a word (end-of-word suffix) mark the borders."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        plain = [t for t in added.items() if t[1].special and not (t[1].normalized or t[1].lstrip or t[1].rstrip or t[1].single_word)]
        self.border = plain[-1] if plain else None
        self.marks = tuple({t.content[0] for t in added.values()})
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.words = None
        if suffix:
            self.words = Tokenizer.from_file(path)
            self.words.no_truncation(), self.words.no_padding()
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.letters = {i: spell(chr(i))[0][0] for i in range(128, 256) if SMALL_LETTERS(chr(i))}
            self.closes = np.zeros(self.library.get_vocab_size() + 1, bool)
            self.closes[[i for token, i in self.library.get_vocab().items() if token.endswith(suffix)]] = True
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.cache: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Python's blanks are the library's white space and four control characters."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in re.split(r"[\t-\r ]+", text) if c]
        if not any(c in text for c in self.marks):       # lower-casing must not make a special token
            try:
                text.encode("latin-1")                   # no combining marks, one lower case each
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.split()

    def ask(self, words: list[str]) -> None:
        """Ids of words from the library."""
        plain = [w for w in words if SMALL_LETTERS(w)] if self.words else []
        for at in range(0, len(plain), 20_000):
            part = plain[at:at + 20_000]
            ids = np.array(self.words.encode_batch_fast([" ".join(part).translate(self.letters)], add_special_tokens=False)[0].ids, self.kind)
            self._store(part, ids, np.flatnonzero(self.closes[ids]) + 1, 0)
        odd = [w for w in words if w not in self.cache and (self.border is None or any(c in w for c in self.marks))]
        for w, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False)):
            self.cache[w] = np.array(e.ids, self.kind).tobytes()
        rest = [w for w in words if w not in self.cache]
        for at in range(0, len(rest), 2000):
            part = rest[at:at + 2000]
            ids = np.array(self.library.encode_batch_fast([self.border[1].content.join(part)], add_special_tokens=False)[0].ids, self.kind)
            self._store(part, ids, np.append(np.flatnonzero(ids == self.border[0]), len(ids)), 1)

    def _store(self, words: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        size, data, start = ids.itemsize, ids.tobytes(), 0
        for w, end in zip(words, (ends * ids.itemsize).tolist(), strict=True):
            self.cache[w] = data[start:end]
            start = end + gap * size

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``kind``."""
        out = []
        for a, b in slices([len(t) for t in texts], 2 << 20):
            if len(self.cache) > CACHE_CHUNKS:
                self.cache.clear()
            cache, rows = self.cache, [self.chunks(t) for t in texts[a:b]]
            found = [list(map(cache.get, row)) for row in rows]
            gaps = [list(compress(range(len(ids)), map(not_, ids))) for ids in found]
            todo = {row[k] for row, gap in zip(rows, gaps) for k in gap}
            if todo:
                marked = [c for c in todo if c[-1] in CLOSING and c[:-1].lower().isalpha()]
                todo.difference_update(marked)
                todo.update(c for c in CLOSING if c not in cache)
                todo.update(core for c in marked if (core := c[:-1]) not in cache)
                self.ask(list(todo))
                for c in marked:
                    cache[c] = cache[c[:-1]] + cache[c[-1]]
            for row, ids, gap in zip(rows, found, gaps):
                for k in gap:
                    ids[k] = cache[row[k]]
                out.append(b"".join(ids))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the ids of each text with the end id, as bytes of the encoder's kind."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        end = np.array([END], enc.kind).tobytes()
        for pdf in batches:
            got = enc.encode_batch([t if isinstance(t, str) else "" for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [b + end for b in got]})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInPandas(run, "doc_id long, ids binary")


def symbol_counts(tokens: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                n = np.bincount(np.frombuffer(b"".join(pdf["ids"].iloc[at:at + 256]), kind))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[:len(n)] += n
        used = np.flatnonzero(total)
        yield pd.DataFrame({"symbol": used, "n": total[used]})
    return tokens.mapInPandas(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def write_corpus(docs: DataFrame, path: str, block_ids: int = BLOCK_IDS) -> str:
    """Encode ``docs`` and write the corpus; returns its folder."""
    spark = docs.sparkSession
    session.configure(spark)
    folder = session.scratch_path(spark, "token-corpus")
    kind, staged = encoder(path).kind, session.scratch_path(spark, "token-corpus-staged")
    tokenize(docs, path).write.option("compression", "zstd").parquet(staged)
    tokens = spark.read.parquet(staged)
    symbol_counts(tokens, kind).write.parquet(f"{folder}/table")
    table = spark.sparkContext.broadcast(read_table(spark, folder))             # size of the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {"start": 0, "block": 0}

        def blocks(held: list[tuple[int | None, np.ndarray]]) -> pd.DataFrame:
            rows, ids = [], []
            for a, b in slices([len(v) for _, v in held], block_ids):
                part = held[a:b]
                ids.append(np.concatenate([v for _, v in part]))
                rows.append({"block": state["block"], "start": state["start"], "n_ids": len(ids[-1]),
                             "doc_ids": [d or 0 for d, _ in part], "no_id": [d is None for d, _ in part], "lengths": [len(v) for _, v in part]})
                state["block"] += 1
                state["start"] += len(ids[-1])
            return pd.DataFrame(rows).assign(payload=encode_blocks(table.value, ids))
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0
        for pdf in batches:
            for doc_id, no_id, data in zip(pdf["doc_id"], pdf["no_id"], pdf["ids"]):
                held.append((None if no_id else int(doc_id), np.frombuffer(data, kind)))
                size += len(held[-1][1])
                if size >= 64 * block_ids:
                    yield blocks(held)
                    held, size = [], 0
        if held:
            yield blocks(held)
    n = shuffle_partitions(spark)
    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(n, "doc_id", "tie") \
        .sortWithinPartitions("doc_id", "tie") \
        .select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "ids")
    ordered.mapInPandas(run, "block long, start long, n_ids long, doc_ids array<long>, no_id array<boolean>, lengths array<long>, payload binary") \
        .withColumn("file", F.spark_partition_id()).write.parquet(f"{folder}/blocks")
    spark.read.parquet(f"{folder}/blocks").groupBy("file").agg(F.sum("n_ids").alias("n_ids")).write.parquet(f"{folder}/files")
    drop_written(tokens)
    return folder


def read_table(spark, folder: str) -> Table:
    rows = spark.read.parquet(f"{folder}/table").collect()                      # one row per used symbol
    counts = np.zeros(max([r["symbol"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r["symbol"]] = r["n"]
    return Table.of_counts(counts)


def read_corpus(spark, folder: str, digest: bool = False) -> DataFrame:
    """Decoded documents: ``doc_id, start, n_tokens`` and ``ids`` (little-endian
    unsigned 32-bit), or ``ids_crc32`` with ``digest``; every block is decoded
    and its checksum verified."""
    table = spark.sparkContext.broadcast(read_table(spark, folder))
    files = spark.read.parquet(f"{folder}/files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    blocks = spark.read.parquet(f"{folder}/blocks").join(F.broadcast(offsets), "file") \
        .select((F.col("base") + F.col("start")).alias("start"), "doc_ids", "no_id", "lengths", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at:at + 64]
                names, starts, sizes, data = [], [], [], []
                for ids, start, docs, none, lengths in zip(decode_blocks(table.value, [bytes(p) for p in part["payload"]]),
                                                           part["start"], part["doc_ids"], part["no_id"], part["lengths"]):
                    names += [None if no else d for d, no in zip(docs.tolist(), none.tolist())]
                    ends, raw = np.cumsum(lengths), ids.astype("<u4").tobytes()
                    starts.append(start + ends - lengths)
                    sizes.append(lengths)
                    own = [raw[4 * (b - n):4 * b] for b, n in zip(ends.tolist(), lengths.tolist())]
                    data += map(zlib.crc32, own) if digest else own
                yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "start": np.concatenate(starts),
                                    "n_tokens": np.concatenate(sizes), "ids_crc32" if digest else "ids": data})
    return blocks.mapInPandas(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def corpus_index(spark, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    return read_corpus(spark, folder, digest=True)
