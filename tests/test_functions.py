"""Differential tests: Column functions vs small pure-Python oracles."""

import random
import re
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from keepsake.functions import names as N
from keepsake.functions import paths as P
from keepsake.functions import scalars as S

EDGE_NAMES = [
    "IMG.jpg.supplemental-metadata.json", "IMG.jpg.supp(1).json", "IMG.jpg.x(1)(2).json",
    "IMG.jpg.json", "a.b.JPG.s.JSON", ".hidden", "name.", "..x", "no_ext", "a_conv.jpg",
    "a_conv_1.jpg", "a_png_conv.jpg", "Photos from 2017", "Photos from 20171",
    "photos from 2017", "___.jpg", "IMG_0001(1).JPG", "x.tar.gz", "a..b", "weird name .jpg",
]


def random_names(n, seed=7):
    rnd = random.Random(seed)
    alphabet = "aB1._-() jJ"
    out = []
    for _ in range(n):
        k = rnd.randint(1, 14)
        out.append("".join(rnd.choice(alphabet) for _ in range(k)))
    return out


def _eval(spark, names, exprs):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    return {r["n"]: r for r in df.select("n", *[e.alias(k) for k, e in exprs.items()]).collect()}


# name -> (media it belongs to, sidecar key, media key, kept sidecar suffix)
NAME_TABLE = {
    "IMG.jpg.supplemental-metadata.json": ("IMG.jpg", "imgjpgsupplementalmetadata", "imgjpgsupplementalmetadata", ".supplemental-metadata.json"),
    "IMG.jpg.supp(1).json": ("IMG(1).jpg", "imgjpgsupp1", "imgjpgsupp1", ".supp(1).json"),
    "IMG.jpg.x(1)(2).json": ("IMG(2).jpg", "imgjpgx12", "imgjpgx12", ".x(1)(2).json"),
    "IMG.jpg.json": (None, "imgjpg", "imgjpg", ""),
    "a.b.JPG.s.JSON": ("a.b.JPG", "abjpgs", "abjpgs", ""),
    ".hidden": (None, "hidden", "hidden", ""),
    "no_ext": (None, "noext", "noext", ""),
    "a_conv.jpg": (None, "aconvjpg", "aconv", ""),
    "Photos from 2017": (None, "photosfrom2017", "photosfrom2017", ""),
    "___.jpg": (None, "jpg", "", ""),
    "IMG_0001(1).JPG": (None, "img00011jpg", "img00011", ""),
    "x.tar.gz": (None, "xtargz", "xtar", ""),
    "x.tar.gz...json": (None, "xtargz", "xtargz", ".gz...json"),
    "one.two.three.json": ("one.two", "onetwothree", "onetwothree", ".three.json"),
}


def test_name_functions(spark):
    names = EDGE_NAMES + random_names(400) + list(NAME_TABLE)
    got = _eval(spark, names, {
        "suffix": P.suffix(F.col("n")), "stem": P.stem(F.col("n")),
        "exp": N.sidecar_expected_media(F.col("n")),
        "jk": N.fuzzy_key_sidecar(F.col("n")), "mk": N.fuzzy_key_media(F.col("n")),
        "sfx": N.sidecar_suffix(F.col("n")),
    })
    for n in names:
        r = got[n]
        p = PurePosixPath(n) if n not in ("", ".") and "/" not in n else None
        if p is not None and p.name == n:
            assert (r["stem"], r["suffix"]) == (p.stem, p.suffix), n
        assert n.endswith(r["sfx"]) and (r["jk"] + r["mk"] == "" or (r["jk"] + r["mk"]).isalnum()), n
    for n, want in NAME_TABLE.items():
        r = got[n]
        assert (r["exp"], r["jk"], r["mk"], r["sfx"]) == want, n


def test_year_folder_functions(spark):
    paths = ["/r/Z001/Takeout/Google Photos/Photos from 2017/a.jpg",
             "/r/Z001/Photos from 20171/x/a.jpg", "/r/photos from 2017/a.jpg",
             "/r/Photos from 2017", "/r/a/b.jpg", "/r/Photos from 2015/Photos from 2016/c.jpg"]
    got = _eval(spark, paths, {"yf": P.year_folder(F.col("n")), "near": P.nearest_year_ancestor(F.col("n")),
                               "full": P.is_year_folder_name(P.basename(P.parent(F.col("n"))))})

    def py_yf(p):
        for part in PurePosixPath(p).parts:
            if re.match(r"Photos from \d{4}", part):
                return part
        return ""

    def py_near(p):
        for par in PurePosixPath(p).parents:
            if par.name.lower().startswith("photos from "):
                return par.name
        return ""

    for p in paths:
        assert got[p]["yf"] == py_yf(p), p
        assert got[p]["near"] == py_near(p), p
        parent_name = PurePosixPath(p).parent.name
        assert got[p]["full"] == bool(re.fullmatch(r"Photos from \d{4}", parent_name.strip())), p


QUARANTINED = {
    "/data/Processing/Z001/Takeout/Google Photos/Photos from 2012/IMG_1.jpg": "/data/Processing/__UNMATCHED_MEDIA__/Z001/Photos from 2012/IMG_1.jpg",
    "/data/Processing/Z123/Takeout/x.json": "/data/Processing/__UNMATCHED_MEDIA__/Z123/x.json",
    "/data/Processing/none/a.jpg": None,
    "/data/Processing/Z002/Google Photos/Takeout/Photos from 2011/b c.png": "/data/Processing/__UNMATCHED_MEDIA__/Z002/Photos from 2011/b c.png",
}


def test_quarantine_and_restore_paths(spark):
    root = "/data/Processing"
    got = _eval(spark, list(QUARANTINED), {"q": P.quarantine_path(F.col("n"), root + "/__UNMATCHED_MEDIA__")})
    assert {p: r["q"] for p, r in got.items()} == QUARANTINED
    first = next(iter(QUARANTINED))
    back = _eval(spark, [QUARANTINED[first]], {"r": P.restore_path(F.col("n"), root + "/__UNMATCHED_MEDIA__", root)})
    assert back[QUARANTINED[first]]["r"] == first


POSIX = {
    "C:\\Users\\a b\\x.jpg": "/mnt/c/Users/a b/x.jpg", " D:\\q\\r.json ": "/mnt/d/q/r.json", "/mnt/c/x": "/mnt/c/x",
    "": "", "relative\\p": "relative/p", "c:/x/y": "/mnt/c/x/y",
}


def test_windows_to_posix(spark):
    got = _eval(spark, list(POSIX), {"w": P.windows_to_posix(F.col("n"))})
    assert {v: r["w"] for v, r in got.items()} == POSIX


def test_json_timestamp_and_format(spark):
    docs = ['{"photoTakenTime": {"timestamp": "1262304000"}}', '{"photoTakenTime": {"timestamp": 86400}}',
            '{"photoTakenTime": {"timestamp": ', '{"title": "x"}', '{"photoTakenTime": {"timestamp": "-1"}}',
            '{"photoTakenTime": {"timestamp": "abc"}}', '{"photoTakenTime": {"timestamp": 12.7}}',
            '{"photoTakenTime": {"timestamp": "12.7"}}', '{"photoTakenTime": {"timestamp": 1.5e3}}']
    got = _eval(spark, docs, {"ts": S.json_timestamp(F.col("n"))})
    exp = [1262304000, 86400, 0, 0, -1, 0, 12, 0, 1500]
    for d, e in zip(docs, exp):
        assert got[d]["ts"] == e, d
    df = spark.createDataFrame([(1262304000,), (0,), (-1,), (None,)], "t long")
    rows = df.select("t", S.format_unix(F.col("t")).alias("f")).collect()
    for r in rows:
        if not r["t"]:
            assert r["f"] == ""
        else:
            assert r["f"] == datetime.fromtimestamp(r["t"], tz=timezone.utc).strftime("%Y:%m:%d %H:%M:%S")


def test_conversion_marker_regex(spark):
    from keepsake.operators.reports import rows_matching
    df = spark.createDataFrame([("a_conv.jpg",), ("a_conv_1.jpg",), ("X_PNG_CONV.jpg",), ("plain",)], "c string")
    got = {r["c"] for r in rows_matching(df).collect()}
    pat = re.compile(r"\_conv.\b", re.IGNORECASE)
    assert got == {v for v in ["a_conv.jpg", "a_conv_1.jpg", "X_PNG_CONV.jpg", "plain"] if pat.search(v)}


def test_type_from_magic(spark):
    rows = [("FFD8FFE000104A4649460001", ".png"), ("FFD8FFE000104A4649460001", ".jpg"),
            ("000000146674797071742020", ".mp4"), ("000000146674797071742020", ".mov"),
            ("000000206674797069736F6D", ".mp4")]
    df = spark.createDataFrame(rows, "h string, e string")
    got = [r[0] for r in df.select(S.type_from_magic(F.col("h"), F.col("e"))).collect()]
    assert got == [".jpg", None, ".mov", None, None]


def test_hamming_and_hex(spark):
    vals = [0, 1, 2 ** 62 + 5, -1]
    df = spark.createDataFrame([(a, b) for a in vals for b in vals], "a long, b long")
    for r in df.select("a", "b", S.hamming64(F.col("a"), F.col("b")).alias("d"),
                       S.phash_from_hex(S.phash_to_hex(F.col("a"))).alias("rt")).collect():
        assert r["d"] == bin((r["a"] ^ r["b"]) & (2 ** 64 - 1)).count("1")
        assert r["rt"] == r["a"]
