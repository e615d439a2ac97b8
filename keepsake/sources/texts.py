"""Text outputs of external tools, parsed with built-in functions.

Tag dumps: one or more files, each holding sections that start with a
``======== <file>`` line followed by ``Tag Name : value`` lines (the
multi-file output of a metadata tool), read line by line (see
:func:`tag_dump_sections`).

Tool log: a progress line ends with ``[n/m]``; summary lines contain one of
the summary words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .files import decode_uri_path

SECTION_MARK = "======== "


def tag_dump_sections(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """``file, pos, line`` for every tag line of every section.

    Lines are read as plain text (files are split into blocks like any text
    input, so a dump file of any size is read by many tasks). Each line keeps
    its file, its block start and its read order; the current section header
    is carried forward inside the block (one block per window partition, at
    most the split size), and lines at the top of a block that continues a
    section take the last header of the file's earlier blocks.
    """
    from pyspark.sql import Window
    df = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=glob)
    df = df.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"),
                   F.col("_metadata.file_block_start").alias("_b"),
                   F.monotonically_increasing_id().alias("_id"))
    header = F.when(F.col("line").startswith(SECTION_MARK),
                    F.trim(F.expr(f"substr(line, {len(SECTION_MARK) + 1})")))
    df = df.withColumn("_h", header)
    in_block = Window.partitionBy("_f", "_b").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_cur", F.last("_h", ignorenulls=True).over(in_block))
    # last header of every block, then the last one of all earlier blocks of the file
    blocks = df.groupBy("_f", "_b").agg(F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col("_id"))).alias("_last"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_f", "_b", F.last("_last", ignorenulls=True).over(before).alias("_prev"))
    df = df.join(blocks, ["_f", "_b"], "left")
    return (df.where(F.col("_h").isNull())
            .select(F.coalesce("_cur", "_prev").alias("file"), F.struct("_b", "_id").alias("pos"), "line")
            .where(F.col("file").isNotNull()))


def pivot_tags(lines: DataFrame, keys=tuple(K.TAG_DUMP_KEYS)) -> DataFrame:
    """Per file, the value of each wanted tag: a line whose trimmed text
    starts with the tag name sets it to the text after the first ':'; a
    later line wins. Returns ``file`` + one column per key (null if absent)."""
    l = lines.withColumn("_t", F.trim("line"))
    aggs = []
    for k in keys:
        val = F.trim(F.element_at(F.split("_t", ":", 2), 2))
        hit = F.col("_t").startswith(k) & F.col("_t").contains(":")
        aggs.append(F.max_by(F.when(hit, val), F.when(hit, F.col("pos"))).alias(
            k.lower().replace("/", "_").replace(" ", "_")))
    return l.groupBy("file").agg(*aggs)


def read_tool_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a tool log with their position: ``path, line``."""
    df = spark.read.text(path)
    return df.select(decode_uri_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("line"))


def tool_log_summary(lines: DataFrame) -> DataFrame:
    """Per log: last progress ``current``/``total`` and the summary lines.
    Returns ``path, kind, line, current, total`` (kind = progress / summary)."""
    t = F.trim("line")
    cur = F.regexp_extract(t, K.TOOL_PROGRESS_RE, 1)
    tot = F.regexp_extract(t, K.TOOL_PROGRESS_RE, 2)
    prog = (lines.where(cur != "")
            .groupBy("path").agg(F.max(cur.cast("long")).alias("current"), F.max(tot.cast("long")).alias("total"))
            .select("path", F.lit("progress").alias("kind"), F.lit(None).cast("string").alias("line"),
                    "current", "total"))
    word = F.lit(False)
    for w in K.TOOL_SUMMARY_WORDS:
        word = word | t.contains(w)
    summ = lines.where((cur == "") & word).select(
        "path", F.lit("summary").alias("kind"), t.alias("line"),
        F.lit(None).cast("long").alias("current"), F.lit(None).cast("long").alias("total"))
    return prog.unionByName(summ)
