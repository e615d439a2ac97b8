"""Archive member listing by pieces of the central directory.

Only the directory at the end of a ZIP file is read, and no task reads a large
one whole: it is cut into pieces of about ``piece`` bytes, which go to tasks of
their own. Entries have no fixed length, so a piece does not know where its
first entry begins. Each piece therefore follows the chain of entry lengths
from every place in its first bytes that looks like an entry and reports where
the chains leave it (nearly always one place, three numbers a piece). Following
these exits from the first piece on gives the exact first entry of every piece;
the standard ``zipfile`` module then reads each piece's entries.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections import Counter
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fsio
from ..session import materialize

SCHEMA = "zip_path string, member string, size long, error string"
PIECE = 4 << 20
# fixed values of the ZIP format
ENTRY, END, END64, LOCATOR64 = b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ENTRY_BYTES, END_BYTES, END64_BYTES, LOCATOR64_BYTES, LONGEST_FIELD = 46, 22, 56, 20, 65535
LONGEST_ENTRY = ENTRY_BYTES + 3 * LONGEST_FIELD        # name, extra field, comment


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def directory_range(fh) -> tuple[int, int]:
    """First byte and end of the central directory of an open ZIP file."""
    fh.seek(0, 2)
    size = fh.tell()
    at = max(0, size - END_BYTES - LONGEST_FIELD - END64_BYTES - LOCATOR64_BYTES)
    fh.seek(at)
    tail = fh.read(size - at)
    end = len(tail) - END_BYTES
    if end < 0 or tail[end:end + 4] != END or tail[-2:] != b"\0\0":        # not an end record without a comment
        end = tail.rfind(END, 0, max(0, end) + 4)
    if end < 0:
        raise zipfile.BadZipFile("File is not a zip file")
    length, = struct.unpack_from("<L", tail, end + 12)
    wide = end - LOCATOR64_BYTES - END64_BYTES
    if wide >= 0 and tail[wide:wide + 4] == END64 and tail[end - LOCATOR64_BYTES:][:4] == LOCATOR64:
        length, = struct.unpack_from("<Q", tail, wide + 40)
        end = wide
    if length > at + end:
        raise zipfile.BadZipFile("Bad offset for central directory")
    return at + end - length, at + end


def chain_exits(data: bytes, starts: list[int], stop: int) -> list[int]:
    """Where the chain of entries from each start first reaches ``stop`` or
    goes beyond it; -1 if it breaks."""
    known: dict[int, int] = {}
    out = []
    for at in starts:
        path = []
        while 0 <= at < stop and at not in known:
            path.append(at)
            if data[at:at + 4] != ENTRY or at + ENTRY_BYTES > len(data):
                at = -1
            else:
                at += ENTRY_BYTES + sum(struct.unpack_from("<3H", data, at + 28))
        at = known.get(at, at)
        known.update(dict.fromkeys(path, at))
        out.append(at)
    return out


def _cut(piece: int):
    """Rows ``zip_path, first, start, stop, end, error``: the pieces of each directory."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                try:
                    with fsio.open_input(p) as fh:
                        first, end = directory_range(fh)
                    if first < end:
                        starts = range(first, end, piece)
                        yield pd.DataFrame({"zip_path": [p] * len(starts), "first": first, "start": starts,
                                            "stop": [min(s + piece, end) for s in starts], "end": end, "error": None})
                except Exception as e:  # noqa: BLE001 - a bad archive is reported, not fatal
                    yield pd.DataFrame({"zip_path": [p], "first": 0, "start": 0, "stop": 0, "end": 0, "error": _error(e)})
    return run


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per piece the exit most chains take, and the chains that take another."""
    for b in batches:
        for r in b.itertuples():
            try:
                with fsio.open_input(r.zip_path) as fh:
                    fh.seek(r.start)
                    data = fh.read(min(r.stop + ENTRY_BYTES, r.end) - r.start)
                starts = [0]
                if r.start > r.first:
                    starts, edge = [], min(r.stop - r.start, LONGEST_ENTRY)
                    at = data.find(ENTRY, 0, edge + 3)
                    while at >= 0:
                        starts.append(at)
                        at = data.find(ENTRY, at + 1, edge + 3)
                exits = [x if x < 0 else x + r.start for x in chain_exits(data, starts, r.stop - r.start)]
                usual = Counter(exits).most_common(1)[0][0] if exits else -1
                odd = [(s + r.start, x) for s, x in zip(starts, exits) if x != usual]
                yield pd.DataFrame({"zip_path": [r.zip_path], "first": r.first, "start": r.start, "stop": r.stop, "usual": usual,
                                    "odd_start": [[s for s, _ in odd]], "odd_exit": [[x for _, x in odd]], "error": None})
            except Exception as e:  # noqa: BLE001
                yield pd.DataFrame({"zip_path": [r.zip_path], "first": r.first, "start": r.start, "stop": r.stop, "usual": -1,
                                    "odd_start": [[]], "odd_exit": [[]], "error": _error(e)})


def _follow(pieces: pd.DataFrame) -> pd.DataFrame:
    """Exact ranges of whole entries from an archive's pieces (one row each)."""
    pieces = pieces.sort_values("start")
    path, at, out = pieces["zip_path"].iloc[0], int(pieces["first"].iloc[0]), []
    end = int(pieces["stop"].max())
    for r in pieces.itertuples():
        if at >= r.stop:                     # an entry longer than the piece covers it
            continue
        leaves = dict(zip(r.odd_start, r.odd_exit)).get(at, r.usual)
        if not at < leaves <= end:
            error = r.error or "BadZipFile: Bad magic number for central directory"
            return pd.DataFrame({"zip_path": [path], "start": 0, "stop": 0, "error": error})
        out.append((path, at, int(leaves), None))
        at = int(leaves)
    return pd.DataFrame(out, columns=["zip_path", "start", "stop", "error"])


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, start, stop, error in zip(b["zip_path"], b["start"], b["stop"], b["error"]):
            try:
                if error is None:
                    with fsio.open_input(path) as fh:
                        fh.seek(start)
                        data = fh.read(stop - start)
                    data += struct.pack("<4s4H2LH", END, 0, 0, 0, 0, len(data), 0, 0)      # a directory of its own
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        found = [i for i in z.infolist() if not i.is_dir()]
                    if found:
                        yield pd.DataFrame({"zip_path": [path] * len(found), "member": [i.filename for i in found],
                                            "size": [i.file_size for i in found], "error": None})
            except Exception as e:  # noqa: BLE001
                error = _error(e)
            if error is not None:
                yield pd.DataFrame({"zip_path": [path], "member": [None], "size": [None], "error": [error]})


def archive_members(zips: DataFrame, piece: int = PIECE) -> DataFrame:
    """``zips``: ``path`` of ZIP files. Returns ``zip_path, member, size, error``.

    A file that is no archive, cannot be opened or whose directory breaks off
    is one row with ``error``; an entry that cannot be read makes its piece
    such a row. Folders are not members; an archive without entries gives no
    row; a path listed twice is listed once.
    """
    pieces = materialize(zips.select("path").distinct().mapInPandas(
        _cut(piece), "zip_path string, first long, start long, stop long, end long, error string"), "zip-pieces")
    whole = (F.col("start") == F.col("first")) & (F.col("stop") == F.col("end"))
    ranges = pieces.where(~whole).repartition("zip_path", "start").mapInPandas(
        _chains, "zip_path string, first long, start long, stop long, usual long, odd_start array<long>, odd_exit array<long>, error string") \
        .groupBy("zip_path").applyInPandas(_follow, "zip_path string, start long, stop long, error string")
    return pieces.where(whole).select("zip_path", "start", "stop", "error").unionByName(ranges) \
        .repartition("zip_path", "start").mapInPandas(_list_members, SCHEMA)
