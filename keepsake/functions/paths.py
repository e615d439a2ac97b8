"""Path functions as Column expressions (POSIX paths, '/' separated).

All functions take and return ``pyspark.sql.Column`` and stay inside
whole-stage codegen (built-in string/array/regex functions only).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(p) -> Column:
    """Remove leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(p), r"^\s+|\s+$", "")


def basename(p) -> Column:
    """Last path part ('' for '')."""
    return F.substring_index(_c(p), "/", -1)


def parent(p) -> Column:
    """Everything before the last '/' ('' when there is none)."""
    return F.regexp_extract(_c(p), r"^(.*)/[^/]*$", 1)


def suffix(name) -> Column:
    """File suffix with its dot, as the standard path library computes it:
    the last '.x' of a name that has at least one character before that dot
    and at least one after it; '' otherwise."""
    return F.regexp_extract(_c(name), r"(?s)^.+(\.[^.]+)$", 1)


def lower_suffix(name) -> Column:
    return F.lower(suffix(name))


def stem(name) -> Column:
    """Name without its suffix."""
    n = _c(name)
    return F.when(suffix(n) != "", F.regexp_extract(n, r"(?s)^(.+)\.[^.]+$", 1)).otherwise(n)


def year_folder(p) -> Column:
    """First path part that *starts with* ``Photos from dddd`` ('' if none)."""
    return F.regexp_extract(_c(p), r"(?:^|/)(" + K.YEAR_FOLDER_PREFIX_RE + r"[^/]*)", 1)


def is_year_folder_name(name) -> Column:
    """A folder name that is exactly ``Photos from dddd`` (after trimming)."""
    return strip_ws(name).rlike("^" + K.YEAR_FOLDER_PREFIX_RE + "$")


def nearest_year_ancestor(p) -> Column:
    """Nearest parent folder whose lower-cased name starts with
    ``photos from `` (the file name itself excluded); '' if none."""
    return F.regexp_extract(parent(_c(p)), r"(?is)^(?:.*/)?(photos from [^/]*)(?:/[^/]*)*$", 1)


def archive_part(p) -> Column:
    """The archive folder of a path: the first part matching ``[Zz]ddd``,
    else the first part starting with ``z``/``Z``; '' when none."""
    p = _c(p)
    strict = F.regexp_extract(p, r"(?:^|/)([Zz][0-9]{3})(?:/|$)", 1)
    loose = F.regexp_extract(p, r"(?:^|/)([Zz][^/]*)", 1)
    return F.when(strict != "", strict).otherwise(loose)


def windows_to_posix(p) -> Column:
    """``C:\\a\\b`` -> ``/mnt/c/a/b``: trim, all backslashes to '/', a drive
    letter followed by ':/' becomes ``/mnt/<lower drive>/``. Other values
    are returned trimmed with slashes normalised; '' stays ''."""
    s = F.regexp_replace(strip_ws(p), r"\\", "/")
    m = F.regexp_extract(s, r"^([a-zA-Z]):/(.+)", 1)
    rest = F.regexp_extract(s, r"(?s)^([a-zA-Z]):/(.+)", 2)
    return F.when(_c(p) == "", _c(p)).when(
        m != "", F.concat(F.lit("/mnt/"), F.lower(m), F.lit("/"), rest)
    ).otherwise(s)


def to_local_path(p) -> Column:
    """Drive-letter paths (2nd char ':') become ``/mnt/<drive>/...``;
    anything else is only trimmed (backslashes untouched)."""
    s = strip_ws(p)
    drive = F.substring(s, 1, 1)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^..", ""), r"\\", "/"), "^/+", "")
    return F.when(F.substring(s, 2, 1) == ":",
                  F.concat(F.lit("/mnt/"), F.lower(drive),
                           F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("/"), rest)))
                  ).otherwise(s)


def quarantine_path(p, target_root: str) -> Column:
    """Move target of a file into a quarantine root: keep the parts from the
    archive folder on, dropping ``Takeout`` / ``Google Photos`` parts.
    Null when the path has no archive part."""
    p = _c(p)
    arch = archive_part(p)
    # text after the archive folder part
    after = F.regexp_extract(p, r"(?:^|/)(?:[Zz][0-9]{3})(/.*)?$", 1)
    after_loose = F.regexp_extract(p, r"(?:^|/)(?:[Zz][^/]*)(/.*)?$", 1)
    strict = F.regexp_extract(p, r"(?:^|/)([Zz][0-9]{3})(?:/|$)", 1)
    tail = F.when(strict != "", after).otherwise(after_loose)
    parts = F.filter(F.split(tail, "/"),
                     lambda x: (x != "") & ~F.lower(x).isin(*K.QUARANTINE_DROP_PARTS))
    rel = F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(F.lit(""))
    return F.when(arch == "", F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(target_root.rstrip("/")), F.lit("/"), arch, rel))


def restore_path(p, quarantine_root: str, processing_root: str) -> Column:
    """Original location of a quarantined file: ``<root>/<archive>/Takeout/
    Google Photos/<rest>``. Null for paths outside the quarantine root or
    with fewer than two parts below it."""
    p = _c(p)
    q = quarantine_root.rstrip("/") + "/"
    rel = F.when(p.startswith(q), F.regexp_replace(p, "^" + re.escape(q), ""))
    arch = F.regexp_extract(rel, r"^([^/]+)/(.+)$", 1)
    rest = F.regexp_extract(rel, r"^([^/]+)/(.+)$", 2)
    return F.when(arch != "", F.concat_ws(
        "/", F.lit(processing_root.rstrip("/")), arch, *[F.lit(x) for x in K.RESTORE_INSERT_PARTS], rest))


def failed_target_dir(p, failed_root: str) -> Column:
    """Folder a failed file is moved to: parts from the first part starting
    with ``z``/``Z`` on (whole path if none), minus the file name."""
    p = _c(p)
    loose = F.regexp_extract(p, r"(?:^|/)((?:[Zz][^/]*)/.*)$", 1)
    rel = F.when(loose != "", loose).otherwise(F.regexp_replace(p, "^/+", ""))
    d = parent(rel)
    return F.when(d == "", F.lit(failed_root.rstrip("/"))).otherwise(
        F.concat(F.lit(failed_root.rstrip("/") + "/"), d))
