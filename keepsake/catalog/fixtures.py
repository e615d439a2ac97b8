"""Archive-shaped inputs derived by Spark from the driver tables.

The driver tables are generic (``documents``, ``embeddings``, ``pages``);
these functions re-shape them into what the curation operators consume: a
file inventory (media + JSON sidecars), sidecar documents, the files present
"now", fingerprints, and near-copy perceptual hashes. Everything is a pure
function of the input rows, so the work grows with the tables. The same
rules are written as SQL in ``oracle.py``.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import paths as P

ROOT = "/data/Processing"
GPHOTOS = "Takeout/Google Photos"


_TABLES: dict[tuple, DataFrame] = {}


def input_key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Key of what is derived from the tables of a folder once per session:
    the session, the folder, ``name``, and the length and time of each entry
    of the folder, so that a replaced or extended table starts anew. (A table
    folder's time changes when files come or go.) A folder that cannot be
    listed itself is taken as unchanged within the session."""
    root = sf_dir.rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    try:
        found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
        state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))
    except Py4JJavaError:
        state = ()
    return spark.sparkContext.applicationId, root, name, state


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (the DataFrame is reused within a session, so the
    parquet footer is read once)."""
    key = input_key(spark, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return _TABLES[key]


def _archive(idc):
    return F.concat(F.lit("Z"), F.format_string("%03d", (idc % 3 + 1)))


def _num(idc):
    return F.floor(idc / 3).cast("long")


def _year(idc):
    return F.concat(F.lit("Photos from "), (F.lit(2010) + _num(idc) % 5).cast("string"))


def _media_ext(idc):
    m = idc % 6
    return (F.when(m == 0, ".jpg").when(m == 1, ".JPG").when(m == 2, ".png")
            .when(m == 3, ".heic").when(m == 4, ".mp4").otherwise(".avi"))


def _sidecar_ext(idc):
    m = idc % 6
    return (F.when(m <= 1, ".jpg").when(m == 2, ".png")
            .when(m == 3, ".heic").when(m == 4, ".mp4").otherwise(".avi"))


def _dir(idc):
    return F.concat_ws("/", F.lit(ROOT), _archive(idc), F.lit(GPHOTOS), _year(idc))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table of few files dealt over all cores before costly columns
    are made of them (a file of one row group is read by one task)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if len(rows.inputFiles()) < cores else rows


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One media file per document (content = the document text)."""
    d = _dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    i = F.col("doc_id")
    name = F.concat(F.lit("IMG_"), F.format_string("%05d", _num(i)),
                    F.when(i % 11 == 3, "(1)").otherwise(""), _media_ext(i))
    ext = F.lower(_media_ext(i))
    phash = F.when(ext.isin(*K.DEDUP_IMAGE_EXTS),
                   F.substring(F.sha1(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "")), 1, 16)
                   ).otherwise(F.lit(""))
    header = (F.when(i % 7 == 2, "FFD8FFE000104A4649460001")
              .when(i % 7 == 5, "000000146674797071742020")
              .when(ext == ".jpg", "FFD8FFE000104A4649460001")
              .when(ext == ".png", "89504E470D0A1A0A0000000D")
              .when(ext == ".heic", "000000186674797068656963")
              .when(ext == ".mp4", "000000206674797069736F6D")
              .otherwise("524946460000000041564920"))
    return d.select(
        i.alias("file_id"), F.lit("media").alias("origin"),
        F.concat_ws("/", _dir(i), name).alias("path"),
        F.col("n_chars").alias("size"),
        (F.lit(1600000000) + i * 60).cast("long").alias("mtime"),
        F.lit(None).cast("string").alias("content"),
        header.alias("header_hex"),
        F.sha1("text").alias("content_sha1"),
        phash.alias("phash64"),
    )


def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON sidecars for 8 of 10 documents; some bare (``a.jpg.json``), some
    malformed, some without a capture time, integer or string timestamps."""
    d = table(spark, sf_dir, "documents").select("doc_id").where(F.col("doc_id") % 10 < 8)
    i = F.col("doc_id")
    name = F.concat(
        F.lit("IMG_"), F.format_string("%05d", _num(i)), _sidecar_ext(i),
        F.when(i % 13 == 5, F.lit(".json")).otherwise(
            F.concat(F.lit(".supplemental-metadata"),
                     F.when(i % 11 == 3, "(1)").otherwise(""), F.lit(".json"))))
    ts = (F.lit(1262304000) + i * 86400).cast("string")
    content = (F.when(i % 17 == 4, F.lit('{"photoTakenTime": {"timestamp": '))
               .when(i % 19 == 7, F.concat(F.lit('{"title": "'), name, F.lit('"}')))
               .when(i % 2 == 0, F.concat(F.lit('{"photoTakenTime": {"timestamp": '), ts, F.lit("}}")))
               .otherwise(F.concat(F.lit('{"photoTakenTime": {"timestamp": "'), ts, F.lit('"}}'))))
    return d.select(
        i.alias("file_id"), F.lit("sidecar").alias("origin"),
        F.concat_ws("/", _dir(i), name).alias("path"),
        F.length(content).cast("long").alias("size"),
        (F.lit(1600000000) + i * 60 + 1).cast("long").alias("mtime"),
        content.alias("content"),
        F.lit(None).cast("string").alias("header_hex"),
        F.lit(None).cast("string").alias("content_sha1"),
        F.lit(None).cast("string").alias("phash64"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files at manifest-build time."""
    return media_files(spark, sf_dir).unionByName(sidecar_files(spark, sf_dir))


def inventory_now(inv: DataFrame) -> DataFrame:
    """Files of the inventory present later: some media and sidecars have
    gone, some media were modified (mtime moved by an hour)."""
    gone = ((F.col("origin") == "media") & (F.col("file_id") % 23 == 0)) | \
           ((F.col("origin") == "sidecar") & (F.col("file_id") % 29 == 0))
    touched = (F.col("origin") == "media") & (F.col("file_id") % 9 == 4)
    return inv.where(~gone).withColumn(
        "mtime", F.when(touched, F.col("mtime") + 3600).otherwise(F.col("mtime")))


def fingerprints(inv: DataFrame) -> DataFrame:
    """(path, content_sha1, phash64, mtime) of the inventory's media files as the
    hashing stage left them: some HEIC files failed to decode (blank hashes)."""
    failed = (P.lower_suffix(F.col("path")) == ".heic") & (F.col("file_id") % 4 == 1)
    return inv.where(F.col("origin") == "media").select(
        "path",
        F.when(failed, F.lit("")).otherwise(F.col("content_sha1")).alias("content_sha1"),
        F.when(failed, F.lit("")).otherwise(F.col("phash64")).alias("phash64"),
        "mtime")


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member listing of the downloaded archives: every file of archive
    ``Z00k`` is a member ``Takeout/Google Photos/<year>/<name>`` of
    ``/data/Zipped/Z00k.zip``."""
    inv = inventory(spark, sf_dir)
    rel = F.regexp_extract("path", r"^/data/Processing/(Z[0-9]{3})/(.*)$", 2)
    z = F.regexp_extract("path", r"^/data/Processing/(Z[0-9]{3})/(.*)$", 1)
    return inv.select(F.concat(F.lit("/data/Zipped/"), z, F.lit(".zip")).alias("zip_path"),
                      rel.alias("member"))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A download folder listing derived from ``pages``: numbered takeout
    archives, already-processed ``Z###.zip`` ones, upper-case ``.ZIP``
    suffixes, names without a number and other archive formats."""
    p = table(spark, sf_dir, "pages").select("page_id")
    i = F.col("page_id")
    num = F.format_string("%03d", i % 1000)
    stamp = F.concat(F.lit("takeout-2025"), F.format_string("%04d", i % 1200 + 101), F.lit("T000000Z"))
    name = (F.when(i % 9 == 0, F.concat(F.lit("Z"), num, F.lit(".zip")))
            .when(i % 11 == 1, F.concat(stamp, F.lit("-"), num, F.lit(".ZIP")))
            .when(i % 13 == 2, F.concat(stamp, F.lit("-"), num, F.lit(".7z")))
            .when(i % 17 == 3, F.concat(stamp, F.lit("-extra.zip")))
            .otherwise(F.concat(stamp, F.lit("-"), num, F.lit(".zip"))))
    return p.select(F.concat(F.lit("/data/Zipped/"), name).alias("path"))


def sign_fingerprint(col: str = "embedding"):
    """64-bit sign pattern of an embedding (bit i set when component i > 0)."""
    return F.expr(f"aggregate(transform({col}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), "
                  "0L, (a, b) -> a | b)")


def similarity_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hashed manifest derived from ``embeddings``: three of four vectors
    are archive files (a tenth of them videos, without a perceptual hash);
    every fourth is a quarantined near-copy of the next vector's file, its
    hash differing in 0..13 low bits, stored in that file's year folder
    (none for every fifth copy; some copies sit in a masked ``_review``
    folder). Returns ``row_id, media_path, phash64, formatted_time``."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", sign_fingerprint("embedding").alias("fp"))
    v = F.col("vec_id")
    arch = F.concat(F.lit("Z"), F.format_string("%03d", v % 3 + 1))
    year = F.concat(F.lit("Photos from "), (F.lit(2010) + F.col("label")).cast("string"))
    is_video = v % 10 == 7
    cand = e.where(v % 4 != 0).select(
        v.alias("row_id"),
        F.concat_ws("/", F.lit(ROOT), arch, F.lit(GPHOTOS), year,
                    F.concat(F.lit("IMG_V"), F.format_string("%05d", v),
                             F.when(is_video, ".mp4").otherwise(".jpg"))).alias("media_path"),
        F.when(is_video, F.lit("")).otherwise(F.lpad(F.lower(F.hex("fp")), 16, "0")).alias("phash64"),
        F.date_format(F.timestamp_seconds(F.lit(1262304000) + v * 3600), K.TIME_FORMAT).alias("formatted_time"))
    src = e.select((v - 1).alias("vec_id"), F.col("label").alias("src_label"), F.col("fp").alias("src_fp"))
    q = e.where(v % 4 == 0).join(src, "vec_id")
    qhash = F.col("src_fp").bitwiseXOR(F.expr("shiftleft(1L, cast(pmod(floor(vec_id / 4), 14) AS INT)) - 1"))
    qyear = F.concat(F.lit("Photos from "), (F.lit(2010) + F.col("src_label")).cast("string"))
    folder = (F.when(v % 20 == 0, F.concat_ws("/", F.lit(ROOT + "/" + K.UNMATCHED_MEDIA_DIR), arch))
              .when(v % 36 == 8, F.concat_ws("/", F.lit(ROOT + "/" + K.UNMATCHED_MEDIA_DIR), arch, F.lit("_review"), qyear))
              .otherwise(F.concat_ws("/", F.lit(ROOT + "/" + K.UNMATCHED_MEDIA_DIR), arch, qyear)))
    quar = q.select(
        v.alias("row_id"),
        F.concat_ws("/", folder, F.concat(F.lit("IMG_U"), F.format_string("%05d", v), F.lit(".jpg"))).alias("media_path"),
        F.lpad(F.lower(F.hex(qhash)), 16, "0").alias("phash64"),
        F.lit("").alias("formatted_time"))
    return cand.unionByName(quar)
