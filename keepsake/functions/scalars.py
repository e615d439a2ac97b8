"""Scalar value functions: times, JSON, flags, hashes, type detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .paths import _c


def blank(c) -> Column:
    """'' or null (after trimming)."""
    c = _c(c)
    return c.isNull() | (F.trim(c) == "")


def nonblank(c) -> Column:
    return ~blank(c)


def flag_is(c, value: str) -> Column:
    """Case/space-insensitive text flag compare (null-safe, null is '')."""
    return F.lower(F.trim(F.coalesce(_c(c), F.lit("")))) == value


def json_timestamp(doc) -> Column:
    """``photoTakenTime.timestamp`` of a sidecar JSON document as whole
    seconds; 0 for malformed JSON, a missing key or a value that is no number."""
    raw = F.get_json_object(_c(doc), K.SIDECAR_TIME_JSON_PATH)
    v = F.when(raw.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(raw).try_cast("long"))
    # a JSON number with a fraction is cut to whole seconds; a quoted one is not a number
    quoted = F.get_json_object(_c(doc), K.SIDECAR_TIME_JSON_PATH.rsplit(".", 1)[0]).rlike(r'"timestamp"\s*:\s*"')
    number = raw.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$") & ~quoted
    v = F.coalesce(v, F.when(number, raw.try_cast("double").try_cast("long")))
    return F.coalesce(v, F.lit(0).cast("long"))


def format_unix(ts) -> Column:
    """UTC ``yyyy:MM:dd HH:mm:ss`` of unix seconds; '' for 0, null and times
    outside the years 1 to 9999. Relies on the session time zone being UTC
    (see session.configure)."""
    ts = _c(ts)
    return F.when(ts.isNull() | (ts == 0) | ~ts.between(-62135596800, 253402300799), F.lit("")).otherwise(
        F.date_format(F.timestamp_seconds(ts), K.TIME_FORMAT))


def append_history(c, text) -> Column:
    """Append to a ``; ``-joined history: ``text`` alone when empty."""
    prev = F.trim(F.coalesce(_c(c), F.lit("")))
    t = text if isinstance(text, Column) else F.lit(text)
    return F.when(prev == "", t).otherwise(F.concat(prev, F.lit("; "), t))


def hamming64(a, b) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b))).cast("long")


def phash_from_hex(h) -> Column:
    """16-hex-digit perceptual hash -> signed BIGINT (two's complement);
    null for blank or malformed text."""
    h = F.trim(_c(h))
    return F.when(h.rlike("^[0-9a-fA-F]{1,16}$"),
                  F.conv(h, 16, -10).cast("long"))


def phash_to_hex(v) -> Column:
    """Signed BIGINT -> 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(_c(v))), 16, "0")


def ext_class(ext) -> Column:
    """photo / video / other for an extension (dot added, lower-cased)."""
    e = F.lower(_c(ext))
    e = F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e))
    return (F.when(e.isin(*K.REPORT_PHOTO_EXTS), "photo")
            .when(e.isin(*K.REPORT_VIDEO_EXTS), "video").otherwise("other"))


def normalised_ext(ext) -> Column:
    e = F.lower(_c(ext))
    return F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e))


def type_from_magic(header_hex, current_ext) -> Column:
    """True extension from the first 12 bytes (upper-case hex): ``.jpg`` for
    a JPEG signature, ``.mov`` for ``ftyp`` at offset 4 with ``qt`` in the
    header; null when the header agrees with the current extension or is
    not recognised."""
    h = F.upper(_c(header_hex))
    e = F.lower(_c(current_ext))
    # "qt" at any byte offset of the first 12 bytes (even hex position)
    qt = F.exists(F.sequence(F.lit(0), F.lit(10)),
                  lambda i: F.substring(h, i * 2 + 1, 4) == K.QT_HEX)
    is_jpeg = h.startswith(K.JPEG_MAGIC_HEX)
    is_mov = (F.substring(h, 9, 8) == K.FTYP_HEX) & qt
    return (F.when(is_jpeg & (e != ".jpg"), F.lit(".jpg"))
            .when(is_mov & (e != ".mov"), F.lit(".mov")))


def conversion_target(ext) -> Column:
    """Target extension of a format conversion, null when none."""
    e = F.lower(_c(ext))
    return (F.when(e.isin(*K.IMAGE_TO_JPG_EXTS), F.lit(".jpg"))
            .when(e.isin(*K.VIDEO_TO_MP4_EXTS), F.lit(".mp4")))


def unclean_name(name) -> Column:
    """True when a lower-cased media name carries a copy/edit marker."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    cond = F.lit(False)
    for m in K.UNCLEAN_NAME_MARKS:
        cond = cond | (F.instr(n, m) > 0)
    return cond
