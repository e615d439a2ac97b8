"""File IO inside tasks for any Hadoop-style URI (``file:``, ``hdfs://``,
``s3://`` ...) through ``pyarrow.fs``; plain paths are local files."""

from __future__ import annotations

import posixpath
import re

from pyarrow import fs as pafs


def resolve(uri: str):
    """``(filesystem, path)`` for a URI or a local path."""
    if uri.startswith("file:") or "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:(//)?", "", uri)
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    fs, p = resolve(uri)
    fs.create_dir(posixpath.dirname(p), recursive=True)
    with fs.open_output_stream(p) as out:
        out.write(data)


def makedirs(uri: str) -> None:
    fs, p = resolve(uri)
    fs.create_dir(p, recursive=True)


def open_input(uri: str):
    """A seekable binary file object."""
    fs, p = resolve(uri)
    return fs.open_input_file(p)


def join(uri: str, *parts: str) -> str:
    return posixpath.join(uri, *parts)


def list_dir(uri: str) -> list[tuple[str, bool, int, int]]:
    """``(path, is folder, bytes, whole-second mtime)`` of what a folder holds;
    nothing if it does not exist. Local paths come without a scheme."""
    fs, p = resolve(uri)
    scheme = "" if isinstance(fs, pafs.LocalFileSystem) else uri[:len(uri) - len(p)] if uri.endswith(p) else uri.split("://")[0] + "://"
    out = []
    for info in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)):
        folder = info.type == pafs.FileType.Directory
        out.append((scheme + info.path, folder, 0 if folder else int(info.size or 0),
                    int(info.mtime_ns // 10**9) if info.mtime_ns is not None else 0))
    return out
