"""Static range asymmetric numeral system over token ids, vectorised in numpy.

One shared frequency table (sum 2**20) serves all blocks. A block of ids is
dealt over ``LANES`` interleaved 64-bit states (id i goes to lane i mod
LANES); states stay in [2**31, 2**63) and shed 32-bit words. A block is
independent: it holds its lane states, its words, the state and word position
at regular checkpoints, and the CRC-32 of its ids, so blocks, and the parts of
a block from each checkpoint on, can be decoded in parallel and verified.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
LANE_BITS = 7
LANES = 1 << LANE_BITS
CHECKPOINT = 1 << 15                    # ids between checkpoints
LOW = np.uint64(1 << 31)


@dataclass
class Table:
    """Frequencies of symbols 0..n-1 scaled to 2**BITS; used symbols get 1 at least."""
    freq: np.ndarray
    start: np.ndarray
    gap: np.ndarray                     # 2**BITS - freq
    symbol: np.ndarray                  # by slot

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> "Table":
        counts = np.asarray(counts, np.float64)
        used = counts > 0
        if not used.any():
            used = np.arange(len(counts)) == 0
            counts = used.astype(np.float64)
        room = (1 << BITS) - int(used.sum())
        share = counts / counts.sum() * room
        freq = np.where(used, 1 + np.floor(share), 0).astype(np.int64)
        spare = (1 << BITS) - int(freq.sum())          # fewer than the used symbols
        order = np.lexsort((np.arange(len(counts)), -(share - np.floor(share)), ~used))
        freq[order[:spare]] += 1
        start = np.concatenate([[0], np.cumsum(freq)[:-1]])
        kind = np.uint16 if len(counts) <= 1 << 16 else np.uint32
        return cls(freq.astype(np.uint64), start.astype(np.uint64), ((1 << BITS) - freq).astype(np.uint64),
                   np.repeat(np.arange(len(counts), dtype=kind), freq))


def encode_blocks(table: Table, blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks; blocks of equal step count are encoded side by side."""
    out: list[bytes] = [b""] * len(blocks)
    by_steps: dict[int, list[int]] = {}
    for i, ids in enumerate(blocks):
        by_steps.setdefault(-(-len(ids) // LANES), []).append(i)
    for steps, group in by_steps.items():
        for at in range(0, len(group), 32):
            part = group[at:at + 32]
            for i, payload in zip(part, _encode_side_by_side(table, [blocks[i] for i in part], steps)):
                out[i] = payload
    return out


def _encode_side_by_side(table: Table, blocks: list[np.ndarray], steps: int) -> list[bytes]:
    n, lanes = len(blocks), len(blocks) * LANES
    ids = np.full((n, steps * LANES), int(table.symbol[0]), np.uint32)    # padded with any used symbol
    for k, b in enumerate(blocks):
        ids[k, :len(b)] = b
    ids = ids.reshape(n, steps, LANES).transpose(1, 0, 2).reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    spots: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []                             # (step, states before decoding it)
    every = CHECKPOINT // LANES
    for t in range(steps - 1, -1, -1):
        s = ids[t]
        f = table.freq.take(s)
        spot = np.flatnonzero(x >= (f << np.uint64(63 - BITS)))
        shed = x.take(spot)
        words.append(shed.astype(np.uint32))                             # the low 32 bits
        spots.append(spot)
        x[spot] = shed >> np.uint64(32)
        # (x // f << BITS) + x % f + start, with one division
        x += (x // f) * table.gap.take(s) + table.start.take(s)
        if t and t % every == 0:
            marks.append((t, x.reshape(n, LANES).copy()))
    words.reverse(), spots.reverse(), marks.reverse()
    x = x.reshape(n, LANES)
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words) if words else np.empty(0, np.uint32)
    own = np.concatenate(spots) >> LANE_BITS if spots else np.empty(0, np.int64)
    step_of = np.repeat(np.arange(steps), sizes)
    order = np.argsort(own, kind="stable")
    flat, step_of = flat[order].astype("<u4"), step_of[order]
    ends = np.cumsum(np.bincount(own, minlength=n))
    out = []
    for k, b in enumerate(blocks):
        lo, hi = (ends[k - 1] if k else 0), ends[k]
        head = [struct.pack("<III", len(b), zlib.crc32(np.asarray(b, "<u4").tobytes()), len(marks)), x[k].astype("<u8").tobytes()]
        for t, state in marks:                                           # words used before step t
            used = int(np.searchsorted(step_of[lo:hi], t))
            head += [struct.pack("<II", t, used), state[k].astype("<u8").tobytes()]
        out.append(b"".join(head) + flat[lo:hi].tobytes())
    return out


def _header(payload: bytes) -> tuple[int, int, list[tuple[int, int, np.ndarray]], np.ndarray]:
    n, crc, marks = struct.unpack_from("<III", payload)
    at, points = 12 + 8 * LANES, [(0, 0, np.frombuffer(payload, "<u8", LANES, 12))]
    for _ in range(marks):
        t, used = struct.unpack_from("<II", payload, at)
        points.append((t, used, np.frombuffer(payload, "<u8", LANES, at + 8)))
        at += 8 + 8 * LANES
    return n, crc, points, np.frombuffer(payload, "<u4", offset=at)


def decode_blocks(table: Table, payloads: list[bytes]) -> list[np.ndarray]:
    """Ids of each payload; every run between checkpoints is a lane group of
    its own, and all runs of equal length go side by side. Raises ValueError
    if a checksum does not hold."""
    heads = [_header(p) for p in payloads]
    runs = []                                                            # (block, first step, steps, word position, states)
    for k, (n, _, points, _) in enumerate(heads):
        steps = -(-n // LANES)
        for (t, used, state), end in zip(points, [p[0] for p in points[1:]] + [steps]):
            runs.append((k, t, end - t, used, state))
    ids = [np.zeros(-(-h[0] // LANES) * LANES, np.uint32) for h in heads]
    by_steps: dict[int, list] = {}
    for r in runs:
        by_steps.setdefault(r[2], []).append(r)
    for steps, group in by_steps.items():
        for at in range(0, len(group), 64):
            part = group[at:at + 64]
            base = np.cumsum([0] + [len(heads[r[0]][3]) - r[3] for r in part])
            pool = np.concatenate([heads[r[0]][3][r[3]:] for r in part] + [np.zeros(1, "<u4")]).astype(np.int64)
            pos = base[:-1].copy()
            x = np.stack([r[4] for r in part]).astype(np.uint64)
            got = np.empty((steps, len(part) * LANES), np.uint32)
            x = x.reshape(-1).astype(np.int64)                           # states are below 2**63
            freq, start = table.freq.astype(np.int64), table.start.astype(np.int64)
            for t in range(steps):
                slot = x & np.int64((1 << BITS) - 1)
                s = table.symbol.take(slot)
                got[t] = s
                s = s.astype(np.int64)
                x >>= np.int64(BITS)
                x *= freq.take(s)
                x += slot
                x -= start.take(s)
                spot = np.flatnonzero(x < np.int64(LOW))
                if len(spot):
                    row = spot >> LANE_BITS
                    n = np.bincount(row, minlength=len(part))
                    first = pos - (np.cumsum(n) - n)                     # so first[row] + place is the word's position
                    word = pool.take(first.take(row) + np.arange(len(spot)), mode="clip")
                    x[spot] = (x.take(spot) << np.int64(32)) | word
                    pos += n
            got = got.reshape(steps, len(part), LANES).transpose(1, 0, 2)
            for k, r in enumerate(part):
                ids[r[0]][r[1] * LANES:(r[1] + steps) * LANES] = got[k].ravel()
    out = []
    for v, (n, crc, _, _) in zip(ids, heads):
        v = v[:n]
        if zlib.crc32(v.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a token block does not hold")
        out.append(v)
    return out
