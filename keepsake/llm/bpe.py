"""BPE encoding and decoding by contiguous rank arrays.

A word of a byte-level vocabulary is held as its part boundaries (one id per
part) beside the ranks of adjacent pairs. The smallest rank is looked for by
scanning, the boundary after it is deleted, and the ranks left and right of
the merged part are looked up anew, until no pair has a rank. Words of equal
length are rows of one contiguous array and go through these steps together;
words over ``SHORT`` bytes, where scanning would be quadratic, use a heap of
the same (rank, position) order.

Texts are cut as the vocabulary's own library cuts them: at the special token
first, then by the pre-token pattern. Words are looked up in a bounded cache
of the Python worker, so each distinct word is merged about once per worker.

Defined cases: a null text is an empty text; empty texts have no ids; repeated
rows are encoded alike; an empty table gives no rows; other columns are
ignored or kept. Decoding joins the bytes of the ids and reads them as UTF-8
with replacement characters for what is not valid.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from typing import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SHORT = 64
CACHE_WORDS = 200_000
SLICE = 1 << 20
NONE = np.int32(2**31 - 1)

# White space and the pre-token pattern of the vocabulary.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE
           + r"])|[" + SPACE + "]+")
ASCII_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBPE:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)          # by rank
        self.first = np.zeros(256, np.int32)                                        # by byte
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.cut = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.words, self.ascii_words = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.assigned: set[str] = set()                                             # at most all of Unicode
        self.path, self.library = path, None
        self.cache: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_rows(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(row numbers, ids)`` groups of the merged words; ``parts`` holds
        one word per row, all of one length."""
        out, rows = [], np.arange(len(parts))
        ranks = self.rank_of(parts[:, :-1], parts[:, 1:])
        while True:
            if parts.shape[1] == 1:
                out.append((rows, parts))
                return out
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                out.append((rows[done], parts[done]))
                live = ~done
                rows, parts, ranks, at, best = rows[live], parts[live], ranks[live], at[live], best[live]
            if not len(rows):
                return out
            every, (n, width) = np.arange(len(rows)), parts.shape
            parts[every, at] = self.merged[best]
            parts = parts[np.arange(width)[None, :] != (at + 1)[:, None]].reshape(n, width - 1)
            ranks = ranks[np.arange(width - 1)[None, :] != at[:, None]].reshape(n, width - 2)
            if width == 2:
                continue
            has = at > 0                                    # the pairs left and right of the merged part
            ranks[every[has], at[has] - 1] = self.rank_of(parts[every[has], at[has] - 1], parts[every[has], at[has]])
            has = at < width - 2
            ranks[every[has], at[has]] = self.rank_of(parts[every[has], at[has]], parts[every[has], at[has] + 1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """One long word, by a heap of (rank, position) over linked parts."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank_by = self._rank_dict()
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_by.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue                                     # one of the two has been merged since
            ids[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank_by.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([t for t, ok in zip(ids, alive) if ok], "<u4")

    def _rank_dict(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_by_pair"):
            self._by_pair = dict(zip(zip((self.keys >> 32).tolist(), (self.keys & 0xFFFFFFFF).tolist()), self.ranks.tolist()))
        return self._by_pair

    def learn(self, words: list[str]) -> None:
        """Merge words that are not in the cache yet."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if len(b) > SHORT:
                self.cache[w] = self.merge_long(b).tobytes()
            else:
                by_length.setdefault(len(b), []).append((w, b))
        for width, group in by_length.items():
            parts = self.first[np.frombuffer(b"".join(b for _, b in group), np.uint8)].reshape(-1, width)
            for rows, ids in self.merge_rows(parts):
                data, step = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, i in enumerate(rows.tolist()):
                    self.cache[group[i][0]] = data[k * step:(k + 1) * step]

    def odd(self, text: str) -> bool:
        """Whether a code point is one that this Python does not know:
        libraries may class those differently."""
        new = set(text).difference(self.assigned)
        strange = {c for c in new if unicodedata.category(c) in ("Cn", "Cs")}
        self.assigned |= new - strange
        return bool(strange)

    def split(self, text: str) -> list[str]:
        """Pre-token words of a text without special tokens."""
        if text.isascii():
            return self.ascii_words.findall(text)
        if self.odd(text):
            if self.library is None:
                from tokenizers import pre_tokenizers
                self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.words.findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts, out = [t or "" for t in texts], []
        for a, b in slices([len(t) for t in texts], SLICE):
            pieces = []
            for text in texts[a:b]:
                own: list[list[str] | int] = []
                end = 0
                for m in self.cut.finditer(text):
                    own += [self.split(text[end:m.start()]), self.special[m.group()]]
                    end = m.end()
                own.append(self.split(text[end:] if end else text))
                pieces.append(own)
            words = {w for own in pieces for part in own if isinstance(part, list) for w in part}
            new = words.difference(self.cache)
            if len(self.cache) + len(new) > CACHE_WORDS:     # start over with the words of this slice
                self.cache.clear()
                new = words
            self.learn(list(new))
            ids_of = self.cache.__getitem__
            for own in pieces:
                out.append(b"".join(b"".join(map(ids_of, part)) if isinstance(part, list) else
                                    part.to_bytes(4, "little") for part in own))
        return out

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ENCODERS: dict[str, RankArrayBPE] = {}


def encoder(path: str) -> RankArrayBPE:
    """One encoder and cache per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RankArrayBPE(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns, or ``keep``) with ``token_ids`` (array of int);
    a column of this name is replaced."""
    docs = docs.drop("token_ids")

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        got = encoder(path).encode_batch([t if isinstance(t, str) else "" for t in texts])
        return pd.Series([np.frombuffer(b, "<u4").astype(np.int32) for b in got])
    return docs.select(*[F.col(f"`{c}`") for c in (keep or docs.columns)], run(F.col("text").cast("string")).alias("token_ids"))


def decode(rows: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``rows`` (its columns, or ``keep``) with ``decoded`` from ``token_ids``
    (null ids: empty text); a column of this name is replaced."""
    rows = rows.drop("decoded")

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([enc.decode(np.asarray(x, "<u4").tobytes()) if x is not None else "" for x in ids], dtype=object)
    return rows.select(*[F.col(f"`{c}`") for c in (keep or rows.columns)], run(F.col("token_ids")).alias("decoded"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding
    the whole text and decoding the ids again, in one pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for a, b in slices([len(t) for t in texts], SLICE):
                ids = enc.encode_batch(texts[a:b])
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[a:b], "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(enc.decode(x).encode("utf-8")).hexdigest() for x in ids]})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
