"""Merkle fixity audit of web archives in two replicas.

Records of a WARC file are laid out one after another; the index holds each
record's offset range. A leaf is the SHA-256 of the bytes a replica has for
one record, with its offset range, and ``fanout`` consecutive nodes (ordered
by offset) make a parent: the SHA-256 over their ranges and hashes. The audit
compares the roots of each file and descends only below nodes that differ,
level by level, down to the records; files with equal roots are never opened
further. Trees are tables (file, level, node), built by aggregations of at
most ``fanout`` rows. Laying the records out in files is one range shuffle of
the pages; after that record bytes are hashed where they are read, and the
audit shuffles only hashes, lengths and positions.

Records are keyed by (file, position). Defined cases: a null payload is an
empty record; a record that only one replica has is ``missing`` (not in the
copy) or ``extra``; a file that only one replica has differs as a whole; a
null page_id is a page, before all others; repeated rows are records of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import dense_index
from .common import written

FANOUT = 16
PER_FILE = 1000


# Header lines of a record. Pages carry no time, so the date is the epoch.
HEADS = ("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:", ">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: ",
         "\r\nContent-Type: text/html\r\nContent-Length: ", "\r\n\r\n")


def record(number: Column, url: Column, body: Column) -> Column:
    """The bytes of one resource record (header block, blank line, payload);
    the record's id follows from its number, URL and payload."""
    url, body = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(body, F.lit("").cast("binary"))
    digest = F.md5(F.concat_ws("|", number.cast("string"), url, F.sha2(body, 256)).cast("binary"))
    uuid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.concat(F.lit(HEADS[0]), uuid, F.lit(HEADS[1]), url, F.lit(HEADS[2]), F.octet_length(body).cast("string"), F.lit(HEADS[3]))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def warc_records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Records dealt over files of ``per_file``, in the order of page_id (null
    first), url and payload hash: ``file, pos, page_id, bytes``. The order is
    written once; equal rows are interchangeable."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").cast("binary").alias("body"))
    rows = rows.withColumn("tie", F.sha2("body", 256)).withColumn("row", F.monotonically_increasing_id())
    rows = dense_index(rows, ["page_id", "url", "tie", "row"], name="n", start=0)
    return rows.select(F.floor(F.col("n") / per_file).alias("file"), (F.col("n") % per_file).alias("pos"), "page_id",
                       record(F.col("n"), F.col("url"), F.col("body")).alias("bytes"))


def record_index(records: DataFrame) -> DataFrame:
    """``file, pos, page_id, offset, length, hash`` of the records, in one pass over their bytes."""
    sizes = written(records.select("file", "pos", "page_id", F.octet_length("bytes").cast("long").alias("length"),
                                   F.sha2("bytes", 256).alias("hash")), "fixity-sizes")
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)   # per_file narrow rows
    return written(sizes.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")), "fixity-index")


def record_hashes(index: DataFrame, replica: DataFrame) -> DataFrame:
    """Leaves of a replica (``file, pos, bytes``): its hashes with the index's ranges."""
    hashes = replica.select("file", "pos", F.sha2("bytes", 256).alias("copy"))
    return hashes.join(index.drop("hash", "page_id"), ["file", "pos"], "left").withColumnRenamed("copy", "hash")


def tree(leaves: DataFrame, fanout: int = FANOUT, per_file: int = PER_FILE) -> list[DataFrame]:
    """Levels of the trees of all files, leaves first; the height is that of a
    file of ``per_file`` records: ``file, node, first, last, hash`` with
    ``first`` / ``last`` the offset range and ``hash`` lowercase hex."""
    levels = [written(leaves.select("file", F.col("pos").alias("node"), F.col("offset").alias("first"),
                                    (F.col("offset") + F.col("length")).alias("last"), "hash"), "fixity-leaves")]
    width = per_file
    while width > 1:
        child = F.struct("node", "first", "last", "hash")
        up = levels[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("parent")) \
            .agg(F.array_sort(F.collect_list(child)).alias("c"))          # at most fanout rows
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["first"], x["last"], x["hash"])), "|")
        levels.append(written(up.select("file", F.col("parent").cast("long").alias("node"),
                                        F.array_min("c.first").alias("first"), F.array_max("c.last").alias("last"),
                                        F.sha2(text.cast("binary"), 256).alias("hash")), "fixity-level"))
        width = -(-width // fanout)
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Leaves below differing roots whose hash or range differs: ``file, node,
    ours_hash, theirs_hash, status`` (corrupt, missing, extra)."""
    open_ = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        if open_ is not None:             # children of the differing nodes only
            wanted = open_.select("file", F.explode(F.sequence(F.col("node") * fanout, F.col("node") * fanout + fanout - 1)).alias("node"))
            a, b = a.join(wanted, ["file", "node"], "left_semi"), b.join(wanted, ["file", "node"], "left_semi")
        a = a.select("file", "node", F.struct("first", "last", "hash").alias("a"))
        b = b.select("file", "node", F.struct("first", "last", "hash").alias("b"))
        open_ = written(a.join(b, ["file", "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))), "fixity-open")
    return open_.select("file", "node", F.col("a.hash").alias("ours_hash"), F.col("b.hash").alias("theirs_hash"),
                        F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt").alias("status"))


def fixity_report(index: DataFrame, replica: DataFrame, fanout: int = FANOUT, per_file: int = PER_FILE) -> DataFrame:
    """One row per record of the index or of the other replica (``file, pos,
    bytes``): ``file, pos, page_id, offset, length, sha256, replica_sha256,
    root, replica_root, status``; ``index`` comes from :func:`record_index`."""
    mine = tree(index, fanout, per_file)
    copy = tree(record_hashes(index, replica), fanout, per_file)
    bad = audit(mine, copy, fanout).select("file", F.col("node").alias("pos"), "status", "theirs_hash")
    place = ["file", "pos", "page_id", "offset", "length"]
    have = index.select(*place, F.col("hash").alias("sha256")).join(bad, ["file", "pos"], "left")
    none = {"page_id": "long", "offset": "long", "length": "long", "sha256": "string"}
    extra = bad.where("status = 'extra'").withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    out = have.unionByName(extra).withColumn("status", F.coalesce("status", F.lit("ok")))
    out = out.withColumn("replica_sha256", F.when(F.col("status") == "ok", F.col("sha256")).otherwise(F.col("theirs_hash")))
    tops = [levels[-1].select("file", F.col("hash").alias(name)) for levels, name in ((mine, "root"), (copy, "replica_root"))]
    return out.join(tops[0], "file", "left").join(tops[1], "file", "left") \
        .select(*place, "sha256", "replica_sha256", "root", "replica_root", "status")
