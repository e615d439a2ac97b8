"""Incremental archive intake as a file stream.

New downloads are picked up by a ``binaryFile`` stream over the download
folder; the stream's checkpoint is the "already processed" tracker, so a
re-run (``trigger(availableNow=True)``) plans only archives it has not seen.
Each micro-batch reads its own new files and the state of the batches before
it: the names seen and the standard names promised, one narrow row each, kept
in a table of one ``batch_id=N`` folder a batch. It plans its archives against
that and writes plan and state to its own folders, which a replayed batch
overwrites with equal rows (it reads only lower batch numbers). Of several
archives of one number the first batch takes the standard name, within a batch
the first in name order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.actions import archive_intake_plan
from ..session import materialize
from ..sources.files import BINARY_SCHEMA, _local


def start_intake(spark: SparkSession, downloads_dir: str, plan_dir: str, checkpoint: str,
                 processing_root: str):
    """Start the stream (available-now trigger); returns the query handle."""
    new_files = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
                 .option("maxFilesPerTrigger", 10000)
                 .load(downloads_dir).select(_local(F.col("path")).alias("path")))

    plans, names = plan_dir.rstrip("/"), checkpoint.rstrip("/") + "-names"

    def plan_batch(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "intake-batch")
        seen = spark.createDataFrame([], "path string") if batch_id == 0 else \
            spark.read.schema("path string, batch_id long").parquet(names).where(F.col("batch_id") < batch_id).select("path")
        plan = materialize(archive_intake_plan(batch, processing_root, taken=seen), "intake-plan")
        promised = plan.where(F.col("op") == "rename").select(F.col("dst").alias("path"))
        batch.unionByName(promised).write.mode("overwrite").parquet(f"{names}/batch_id={batch_id}")
        # foreachBatch is at-least-once
        plan.write.mode("overwrite").parquet(f"{plans}/batch_id={batch_id}")

    return (new_files.writeStream.foreachBatch(plan_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_intake(spark: SparkSession, downloads_dir: str, plan_dir: str, checkpoint: str,
               processing_root: str) -> None:
    q = start_intake(spark, downloads_dir, plan_dir, checkpoint, processing_root)
    q.awaitTermination()
