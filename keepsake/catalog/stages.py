"""Stage tables: each pipeline stage's output written once as parquet.

The curation pipeline hands a manifest from stage to stage. Stage outputs
are written under the cluster's checkpoint folder (``spark.checkpoint.dir``)
and read back, which cuts lineage (a lost executor recomputes from the
written table, not from the raw inputs) and lets several queries start from
the same stage without recomputing it.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import session
from .fixtures import input_key

_WRITTEN: dict[tuple, str] = {}


def stage(spark: SparkSession, sf_dir: str, name: str,
          build: Callable[[], DataFrame]) -> DataFrame:
    key = input_key(spark, sf_dir, name)
    path = _WRITTEN.get(key)
    if path is None:
        path = session.scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)
