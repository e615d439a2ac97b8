"""File-name functions: sidecar pairing keys, fuzzy keys, renames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .paths import _c, stem, suffix


def sidecar_expected_media(json_name) -> Column:
    """Media name a sidecar describes: ``base.ext.<x>(n).json`` ->
    ``base(n).ext`` (``base.ext`` without a number). Null when the name does
    not have the ``base.ext.<x>.json`` shape (a bare ``a.jpg.json`` does not)."""
    n = _c(json_name)
    base = F.regexp_extract(n, K.SIDECAR_NAME_RE, 1)
    ext = F.regexp_extract(n, K.SIDECAR_NAME_RE, 2)
    dup = F.regexp_extract(n, K.SIDECAR_NAME_RE, 3)
    return F.when(n.rlike(K.SIDECAR_NAME_RE),
                  F.when(dup != "", F.concat(base, F.lit("("), dup, F.lit(")."), ext))
                  .otherwise(F.concat(base, F.lit("."), ext)))


def bare_sidecar_media(json_name) -> Column:
    """Media name of a sidecar without a middle part: ``base.ext.json`` ->
    ``base.ext``; null for other shapes."""
    base = F.regexp_extract(_c(json_name), r"(?is)^(.+\.[^.]+)\.json$", 1)
    return F.when(base != "", base)


def _alnum(x: Column) -> Column:
    return F.regexp_replace(x, K.FUZZY_DROP_RE, "")


def fuzzy_key_sidecar(json_name) -> Column:
    """Lower-case, drop a trailing ``.json`` (with any dots before it), keep
    ASCII letters and digits."""
    return _alnum(F.regexp_replace(F.lower(_c(json_name)), K.FUZZY_JSON_SUFFIX_RE, ""))


def fuzzy_key_media(media_name) -> Column:
    """Lower-case stem, ASCII letters and digits only."""
    return _alnum(F.lower(stem(_c(media_name))))


def sidecar_suffix(json_name) -> Column:
    """Part of a sidecar name kept when its media is renamed
    (``a.jpg.supp.json`` -> ``.supp.json``); '' when the shape differs."""
    return F.regexp_extract(_c(json_name), K.SIDECAR_SUFFIX_RE, 2)


def renamed_sidecar(json_name, new_media_name) -> Column:
    """New sidecar name after its media was renamed; unchanged when the
    sidecar name has no recognisable suffix."""
    sfx = sidecar_suffix(json_name)
    return F.when(sfx != "", F.concat(_c(new_media_name), sfx)).otherwise(_c(json_name))


def tagged_conversion_name(name, new_suffix, tag) -> Column:
    """``{stem}_{tag}_conv{new_suffix}`` for a file converted or re-typed."""
    return F.concat(stem(_c(name)), F.lit("_"), _c(tag), F.lit(K.CONV_MARK), _c(new_suffix))


def numbered_name(name, n, style: str) -> Column:
    """Collision-free variant number ``n`` (n >= 1) of a name.

    style ``underscore``: ``stem_n.ext``; ``paren``: ``stem(n).ext``;
    ``restored``: ``stem_restored.ext`` for n=1 then ``stem_restored_{n-1}.ext``."""
    nm = _c(name)
    st, sx, n = stem(nm), suffix(nm), _c(n).cast("string")
    if style == "underscore":
        return F.concat(st, F.lit("_"), n, sx)
    if style == "paren":
        return F.concat(st, F.lit("("), n, F.lit(")"), sx)
    if style == "restored":
        return F.when(_c(n) == "1", F.concat(st, F.lit(K.RESTORED_MARK), sx)).otherwise(
            F.concat(st, F.lit(K.RESTORED_MARK + "_"), (_c(n).cast("long") - 1).cast("string"), sx))
    raise ValueError(style)
