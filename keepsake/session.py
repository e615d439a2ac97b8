"""Session helpers: the settings every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators depend on for correct results (not tuning):
#  - UTC session time zone: formatted capture times are UTC wall clock.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Runtime re-planning: coalesce small shuffle partitions, split skewed joins.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Whole texts, images and member lists go to Python workers: few rows a batch.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``keepsake`` importable in Python workers (the Pandas-UDF
    operators run there): the package is zipped once per application,
    written under the checkpoint folder and added with ``addPyFile``."""
    import io
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    from .sources import fsio
    uri = scratch_path(spark, "pyfiles") + "/keepsake.zip"
    fsio.write_bytes(uri, buf.getvalue())
    sc.addPyFile(uri)
    _SHIPPED.add(sc.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings operators rely on (idempotent) and ship
    the package to the Python workers."""
    for k, v in {**REQUIRED_CONF, **ADAPTIVE_CONF, **BATCH_CONF}.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session; only when it is unset
    (local tests) a fresh temporary folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        d = tempfile.mkdtemp(prefix="keepsake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{os.urandom(6).hex()}")


def local_session(cores: int = 8, shuffle_partitions: int = 8,
                  app: str = "keepsake") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**REQUIRED_CONF, **ADAPTIVE_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def materialize(df, name: str = "table"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: the written table cuts lineage, so multi-pass operators and lost
    executors re-read it instead of recomputing the inputs."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
