"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period ``q``, of at
least ``max(least, 2 q)`` words, that no neighbouring word extends.

All texts of a batch form one sequence of word numbers in which texts share no
number. Prefix doubling sorts its suffixes; the rank arrays of the rounds
(words, pairs, fours, ...) name every block of 2^k words and answer how far
two places agree, forwards and backwards, in k lookups. Suffixes that share no
four words with another of their text drop out early: few are left in prose.

A run of period q holds, behind its start, an aligned block of b = 2^k words
(2b - 1 <= q <= 4b - 2; for q <= 14 a block of four at an even place) whose
copy stands q words on. So every dyadic block asks for its occurrences in the
window of 4b - 2 words behind it: its interval of the suffix array and a
range successor of a wavelet matrix over that array give them in order.
Occurrences at most b / 2 apart form a progression, which is taken as a whole:
inside the block's own repetition only its difference is a period; the members
of later ones, and single occurrences, give one candidate each. A candidate is
extended both ways and kept if it is long enough; of equal stretches the
smallest period stays.

Defined cases: null and empty texts have no words and no runs; repeated rows
are scanned alike; an empty table gives no rows; other columns are ignored or
kept. One text is scanned whole; memory is a few hundred bytes per word.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

LEAST = 12
#: Characters of the texts searched together.
SLICE = 3 << 20


class Suffixes:
    """Ranks of all blocks of 2^k words, the repeating suffixes in order, and
    the wavelet matrix over their places."""

    def __init__(self, seq: np.ndarray, text: np.ndarray, first: np.ndarray, end: np.ndarray):
        n = len(seq)
        _, at, count = np.unique(text * (seq.max() + 1) + seq, return_inverse=True, return_counts=True)
        rank = (np.cumsum(count) - count)[at]
        self.n, self.ranks, self.blocks = n, [self._kept(rank)], {}
        live, h, level, four = np.flatnonzero(count[at] > 1), 1, 0, np.empty(0, np.int64)
        while len(live):
            after = live + h
            second = np.where(after < end[live], rank[np.minimum(after, n - 1)], -1)
            key = rank[live] * (n + 1) + second + 1
            order = np.argsort(key)
            live, key = live[order], key[order]
            old, place = rank[live], np.arange(len(live))
            head = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], place, 0))
            base = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
            size = np.bincount(head, minlength=len(live))[head]
            rank[live] = old + head - base
            live, size, h, level = live[size > 1], size[size > 1], 2 * h, level + 1
            self.ranks.append(self._kept(rank))
            if level == 2:
                four = live
            if level >= 2:
                on = (live - first[live]) % (2 if level == 2 else h) == 0
                self.blocks[level] = (live[on], rank[live[on]], size[on])
        self.places = np.sort(four)
        suffix = four[np.argsort(rank[four])]
        self.sorted_rank = rank[suffix]
        self.bits = max(1, int(len(four)).bit_length())
        self.zeros, value = [], np.searchsorted(self.places, suffix)
        for bit in range(self.bits - 1, -1, -1):
            one = (value >> bit & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            value = np.r_[value[~one], value[one]]

    @staticmethod
    def _kept(rank: np.ndarray) -> np.ndarray:
        return np.r_[rank, -1].astype(np.int32)

    def interval(self, rank: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = np.searchsorted(self.sorted_rank, rank)
        return lo, lo + size

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest place >= ``least`` among the suffixes lo..hi, or a place far behind all."""
        x = np.searchsorted(self.places, least)
        a, b, below = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for k, zero in enumerate(self.zeros):                     # how many are below
            one = (x >> (self.bits - 1 - k) & 1).astype(bool)
            za, zb, all0 = zero[a], zero[b], zero[-1]
            below += np.where(one, zb - za, 0)
            a, b = np.where(one, all0 + a - za, za), np.where(one, all0 + b - zb, zb)
        found = below < hi - lo
        a, b, nth, value = lo[found], hi[found], below[found], np.zeros(int(found.sum()), np.int64)
        for zero in self.zeros:                                    # the one after those
            za, zb, all0 = zero[a], zero[b], zero[-1]
            one = nth >= zb - za
            nth = np.where(one, nth - (zb - za), nth)
            a, b, value = np.where(one, all0 + a - za, za), np.where(one, all0 + b - zb, zb), value << 1 | one
        out = np.full(len(lo), 8 * self.n + 64, np.int64)
        out[found] = self.places[value]
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from places i < j on agree."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[k][np.minimum(a, self.n)] == self.ranks[k][np.minimum(b, self.n)]
            same &= b < self.n
            a, b = a + (same << k), b + (same << k)
        return a - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before places i < j agree."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            u = a - (1 << k)
            same = (u >= 0) & (self.ranks[k][np.maximum(u, 0)] == self.ranks[k][np.maximum(b - (1 << k), 0)])
            a, b = a - (same << k), b - (same << k)
        return i - a


def _candidates(s: Suffixes, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) pairs of the blocks of one level."""
    block, rank, size = s.blocks[level]
    b = 1 << level
    lo, hi = s.interval(rank, size)
    last = block + (14 if level == 2 else 4 * b - 2)
    near = s.successor(lo, hi, block + 1)
    own = near - block <= b // 2
    at, far = [block[own]], [(near - block)[own]]
    step = block + 1
    step[own] = near[own] + s.ahead(block[own], near[own]) - b + 1
    live = np.flatnonzero(step <= last)
    while len(live):
        y = s.successor(lo[live], hi[live], step[live])
        live, y = live[y <= last[live]], y[y <= last[live]]
        z = s.successor(lo[live], hi[live], y + 1)
        many = z - y <= b // 2
        step[live] = y + 1
        at.append(block[live[~many]]), far.append((y - block[live])[~many])
        if many.any():                                            # a progression, up to the window's end
            who, y, gap = live[many], y[many], (z - y)[many]
            stop = y + gap + s.ahead(y, y + gap) - b
            count = (np.minimum(stop, last[who]) - y) // gap + 1
            number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at.append(np.repeat(block[who], count))
            far.append(np.repeat(y - block[who], count) + number * np.repeat(gap, count))
            step[who] = stop + 1
        live = live[step[live] <= last[live]]
    return np.concatenate(at), np.concatenate(far)


def runs_of(seq: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts of ``sizes`` words that
    follow one another in ``seq``, by start, then period. ``least`` is at least 12."""
    none = np.empty(0, np.int64)
    if not len(seq):
        return none, none, none
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)[text]
    s = Suffixes(seq.astype(np.int64), text, (np.cumsum(sizes) - sizes)[text], end)
    found = [_candidates(s, level) for level in s.blocks]
    at, q = (np.concatenate([f[k] for f in found]) if found else none for k in (0, 1))
    back = s.behind(at, at + q)
    start, length = at - back, back + q + s.ahead(at, at + q)
    good = length >= np.maximum(least, 2 * q)
    start, length, q = start[good], length[good], q[good]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(start)]
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _texts(texts: list[bytes], least: int):
    """Per text its runs and the words that are left without the repeats."""
    words = [t.split() for t in texts]                            # bytes.split: \x20 and \x09-\x0D
    sizes = np.array([len(w) for w in words], np.int64)
    numbers, _ = pd.factorize(np.array([w for own in words for w in own] + [None], object)[:-1])
    start, length, period = runs_of(numbers, sizes, least)
    begin = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begin + sizes, start, side="right")
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    drop = np.cumsum(change) > 0
    cuts = np.searchsorted(owner, np.arange(len(words) + 1))
    for i, own in enumerate(words):
        rows = slice(cuts[i], cuts[i + 1])
        if cuts[i] < cuts[i + 1]:
            kept = np.flatnonzero(~drop[begin[i]:begin[i] + sizes[i]])
            own = [own[j] for j in kept.tolist()]
        found = [{"start": a - begin[i], "length": n, "period": q}
                 for a, n, q in zip(start[rows].tolist(), length[rows].tolist(), period[rows].tolist())]
        yield found, b" ".join(own).decode()


def find_runs(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns, ``runs`` (array of ``start,
    length, period`` in words, by start, then period) and ``collapsed`` (the
    words joined by one space, without those that a run holds behind its first
    period)."""
    kind = "array<struct<start:long,length:long,period:long>>"

    @F.pandas_udf(f"runs {kind}, collapsed string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            data = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
            out = [r for a, b in slices([len(t) for t in data], SLICE) for r in _texts(data[a:b], least)]
            yield pd.DataFrame({"runs": [r for r, _ in out], "collapsed": [c for _, c in out]})
    kept = [F.col(f"`{c}`") for c in keep or ["doc_id"]]
    return docs.select(*kept, run(F.col("text").cast("string")).alias("found")).select(*kept, "found.runs", "found.collapsed")
