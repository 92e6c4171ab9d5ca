"""Vector columns: which rows hold usable vectors, and their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def packed(df: DataFrame, *keys: str) -> DataFrame:
    """``vec_id``, ``vector`` (its float64 components as bytes) and ``keys``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    source = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), *keys)
    names = ["vec_id", "vector", *keys]

    def run(vec_id: pa.Array, embedding: pa.Array, *rest: pa.Array) -> dict:
        flat = embedding.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(embedding.value_lengths().to_numpy(zero_copy_only=False))
        return dict(zip(names, [vec_id, [p.tobytes() for p in np.split(flat, ends)[: len(ends)]], *rest]))

    return map_arrow(source, run, ", ".join(["vec_id long", "vector binary", *(f"{k} {kinds[k]}" for k in keys)]))


def matrix(vectors) -> np.ndarray:
    vectors = list(vectors)
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
