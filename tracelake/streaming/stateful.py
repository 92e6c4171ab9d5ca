"""Per-frame operators that carry state between micro-batches.

State is keyed by the channel or recording: the samples a hit still blocks, the
last values of a sliding window, or a Kalman filter's estimate.  Within a batch
rows are put in order; between batches the source is expected to be in order by
key, as a recording is.  The causal forms alone can stream: a zero-phase filter
needs the end of the signal.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.functions import kernels
from tracelake.operators.decode import Filter, Model


def _keyed(df: DataFrame, by: str, step: Callable, out: str, state: str) -> DataFrame:
    return df.groupBy(by).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def spikes(df: DataFrame, by: str, order: str, value: str, threshold: float, refractory: int = kernels.REFRACTORY) -> DataFrame:
    """Hits of each channel; a hit near the end of a batch still blocks the
    first samples of the next."""
    types = dict(df.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wait, seen = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)
        x = rows[value].to_numpy(float)
        hits, left = kernels.spikes(x, threshold, wait, refractory)
        state.update((int(left) if len(hits) else max(0, wait - len(x)), seen + len(x)))
        yield rows.loc[hits, [by, order, value]].assign(idx=hits + 1 + seen)

    return _keyed(df.select(by, order, value), by, step, f"{by} {types[by]}, {order} {types[order]}, {value} double, idx long", "wait long, seen long")


def trailing_mean_abs(df: DataFrame, by: str, order: str, value: str, length: int, out: str = "mav") -> DataFrame:
    """Mean magnitude of the last ``length`` samples, over batches too."""
    types = dict(df.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [0.0] * (length - 1), float)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)
        x = np.r_[held, np.abs(rows[value].to_numpy(float))]
        sums = np.convolve(x, np.ones(length), "valid") / length
        state.update((x[len(x) - length + 1 :].tolist() if length > 1 else [],))
        yield rows[[by, order]].assign(**{out: sums})

    return _keyed(df.select(by, order, value), by, step, f"{by} {types[by]}, {order} {types[order]}, {out} double", "held array<double>")


def kalman(df: DataFrame, by: str, order: str, features: str, model: Model, gain: float = 1.0) -> DataFrame:
    types = dict(df.dtypes)
    size = len(model.a)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = Filter(model, gain)
        if state.exists:
            x, p = state.get
            f = Filter(model, gain, np.array(x, float), np.array(p, float).reshape(size, size), True)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)
        found = [f.step(np.asarray(z, float)).tolist() for z in rows[features]]
        state.update((f.x.tolist(), f.p.ravel().tolist()))
        yield rows[[by, order]].assign(predicted=found)

    return _keyed(df.select(by, order, features), by, step, f"{by} {types[by]}, {order} {types[order]}, predicted array<double>", "x array<double>, p array<double>")


def sliding(df: DataFrame, ts: str, value: str, by: str, length: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Counts and means in sliding event-time windows; rows later than the
    watermark are dropped."""
    return (
        df.withWatermark(ts, late).groupBy(F.window(ts, length, slide), by)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(value)).alias("mean_abs"))
        .select(by, F.col("window.start").alias("start"), "n", "mean_abs")
    )


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it names a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracelake-stream-")
    return f"{folder}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the source holds now, through the streaming engine; the result
    is read from the files its sink wrote."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    schema = stream.schema

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{folder}/out/{'all' if mode != 'append' else epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")
