"""Dense, order-defined row numbers without a single-partition window.

``row_number() over (order by ...)`` with no partition moves every row
into one task. Here the rows are range-partitioned on the order keys and
sorted inside each partition; each partition counts its rows, the
per-partition counts (one row per partition, a bounded table) are turned
into offsets, and every row gets ``offset + position in partition``. The
order keys must make the order total (unique), so recomputation after a
lost executor yields the same numbers.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, order: Sequence[Column | str], name: str = "row_id",
                start: int = 1, num_partitions: int | None = None,
                materialize: bool = False) -> DataFrame:
    """Add ``name`` = position of each row in ``order`` (starting at ``start``).

    The range partitioning is evaluated exactly once: rows, their partition
    id and their position inside the partition are written as a table under
    the checkpoint folder, and the per-partition offsets are computed from
    that table. (Two evaluations of a range shuffle may choose different
    bounds -- the partitioner re-samples skewed inputs with a seed taken
    from the RDD id -- so counts and positions must come from the same
    evaluation.) ``materialize`` also writes the input first, so the
    bound sampling and the shuffle do not both recompute an expensive input.
    """
    from ..session import materialize as _write
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if materialize:
        df = _write(df, "dense-index-input")
    ranged = (df.repartitionByRange(n, *order)
              .sortWithinPartitions(*order)
              .withColumn("_ks_pid", F.spark_partition_id())
              .withColumn("_ks_mid", F.monotonically_increasing_id()))
    # position inside the partition: the id's low 33 bits
    ranged = ranged.withColumn("_ks_pos", F.col("_ks_mid") - F.shiftleft(F.col("_ks_pid").cast("long"), 33))
    ranged = _write(ranged.drop("_ks_mid"), "dense-index-ranged")
    counts = ranged.groupBy("_ks_pid").agg(F.count(F.lit(1)).alias("_ks_n"))
    # one row per partition: a window over it is a bounded, tiny job
    w = Window.orderBy("_ks_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_ks_pid", F.coalesce(F.sum("_ks_n").over(w), F.lit(0)).alias("_ks_off"))
    out = ranged.join(F.broadcast(offsets), "_ks_pid")
    return out.withColumn(name, (F.col("_ks_off") + F.col("_ks_pos") + F.lit(start)).cast("long")) \
        .drop("_ks_pid", "_ks_pos", "_ks_off")


def group_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
               name: str = "rk", hot_rows: int = 2_000_000) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` that never
    sends a hot group whole to one task.

    A partial aggregation counts rows per key; keys with more than
    ``hot_rows`` rows (at most ``total / hot_rows`` of them, so the list is
    size-bounded) are numbered by :func:`_spread_rank`, which spreads one
    group over many range partitions. All other keys use the plain window.
    Keys must be non-null.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    hot = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > hot_rows).select(*keys))
    hot_keys = hot.collect()          # bounded: total rows / hot_rows keys
    w = Window.partitionBy(*keys).orderBy(*order)
    if not hot_keys:
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    hot_df = df.sparkSession.createDataFrame(hot_keys, hot.schema)
    normal = df.join(F.broadcast(hot_df), keys, "left_anti") \
        .withColumn(name, F.row_number().over(w).cast("long"))
    spread = _spread_rank(df.join(F.broadcast(hot_df), keys, "left_semi"), keys, order, name)
    return normal.unionByName(spread)


def _spread_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                 name: str) -> DataFrame:
    """Rank inside groups via a global range-partitioned numbering minus
    each group's first number (found by a partial aggregation)."""
    idx = dense_index(df, [*[F.col(k) for k in keys], *order], name="_gr_pos", start=0)
    starts = idx.groupBy(*keys).agg(F.min("_gr_pos").alias("_gr_start"))
    return (idx.join(F.broadcast(starts), list(keys))
            .withColumn(name, (F.col("_gr_pos") - F.col("_gr_start") + 1).cast("long"))
            .drop("_gr_pos", "_gr_start"))
