"""Vector helpers: which vectors are usable, and packed batches for numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not empty, all components finite numbers, not the zero vector."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame) -> DataFrame:
    """``vec_id, label, v, ok, dim`` of an embeddings table (label optional);
    ``v`` is null unless usable."""
    label = F.col("label").cast("long") if "label" in df.columns else F.lit(None).cast("long")
    kind = df.schema["embedding"].dataType
    exact = "array<double>" if kind.simpleString() not in ("array<float>", "array<double>") else kind.simpleString()
    e = F.col("embedding").cast(exact)
    out = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), e.alias("v"), usable(e).alias("ok"))
    return out.withColumn("v", F.when(F.col("ok"), F.col("v"))).withColumn("dim", F.size("v"))


def matrix(column: pd.Series) -> np.ndarray:
    """Arrays of equal length as a matrix of doubles."""
    return np.array(column.tolist(), np.float64) if len(column) else np.empty((0, 0))


def unpack(column: pd.Series, dim: int) -> np.ndarray:
    """Vectors stored as little-endian doubles."""
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, dim)
