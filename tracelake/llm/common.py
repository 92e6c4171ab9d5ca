"""Pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage results.

    It comes from ``spark.checkpoint.dir``; where that is unset a folder of our
    own is used on one machine, and on a cluster, where executors would not share
    it, an error is raised.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset; on a cluster it names a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tracelake-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Python workers get few rows and bytes at a time, for texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def map_arrow(df: DataFrame, function: Callable[..., dict], schema: str) -> DataFrame:
    """``function(*columns)`` on each Arrow batch gives the columns of ``schema``.

    Arrow arrays pass ids unchanged, nulls among them too.  A function with an
    attribute ``start`` is first replaced by ``function.start()`` in each task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = function.start() if hasattr(function, "start") else function
        for batch in batches:
            out = f(*batch.columns)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := out[x.name], pa.Array) else pa.array(c, x.type) for x in fields], schema=fields
            )

    return df.mapInArrow(run, schema)


def fresh(stem: str, n: int, taken: list[str]) -> list[str]:
    """``n`` column names that are not taken, whatever their case."""
    used = {c.lower() for c in taken}
    found = (name for i in range(len(used) + n) if (name := f"{stem}_{i}") not in used)
    return [next(found) for _ in range(n)]


def append_arrow(df: DataFrame, inputs: list[str], function: Callable[..., dict], schema: str) -> DataFrame:
    """All columns of ``df``, unchanged, and those of ``schema`` that
    ``function(*inputs)`` gives; columns of the same names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    fields = to_arrow_schema(added)
    df = df.drop(*(f.name for f in added))
    # Columns the function needs go to the end under names of their own.
    own = fresh("input", len(inputs), df.columns)
    sent = df.select("*", *(F.col(c).alias(o) for c, o in zip(inputs, own)))
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = function.start() if hasattr(function, "start") else function
        for batch in batches:
            out = f(*batch.columns[n:])
            arrays = [c if isinstance(c := out[x.name], pa.Array) else pa.array(c, x.type) for x in fields]
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + arrays, schema=pa.schema([*list(batch.schema)[:n], *fields]))

    return sent.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as bigint columns ``a`` and ``b``.

    Returns one row (``v``, ``root``) per vertex that has an edge to another
    vertex; two vertices are connected exactly when their roots are equal.

    Each round contracts every vertex into the neighbour (or itself) that has
    the least random priority of that round, so the edge list shrinks by a
    constant factor in expectation whatever its shape, chains included.  All
    steps are joins and combinable aggregates; a hub is never gathered.
    """
    edges = materialize(_proper(edges))
    mapping = None
    turn = 0
    while not edges.isEmpty():
        rank = F.struct(F.xxhash64("b", F.lit(turn)).alias("r"), F.col("b").alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("r"), F.col("a").alias("v"))
        parent = (
            both.groupBy("a").agg(F.min(rank).alias("best"))
            .select(F.col("a").alias("v"), F.least("best", own)["v"].alias("p"))
        )
        parent = materialize(parent)
        left = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = materialize(
            _proper(edges.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
        )
        if mapping is None:
            mapping = parent.select("v", F.col("p").alias("root"))
        else:
            step = parent.select(F.col("v").alias("root"), "p")
            mapping = materialize(
                mapping.join(step, "root", "left").select("v", F.coalesce("p", "root").alias("root"))
            )
        turn += 1
    if mapping is None:
        mapping = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return mapping


def _proper(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
