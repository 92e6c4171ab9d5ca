"""Framed features over channels of ordered samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import kernels


def trailing_mean_abs(df: DataFrame, by: str, order: Sequence[str], value: str, length: int, out: str) -> DataFrame:
    """Mean magnitude of the last ``length`` samples, zeros before the first."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(length - 1), 0)
    return df.withColumn(out, F.sum(F.abs(value)).over(w) / length)


def trailing_mean(df: DataFrame, by: str, order: Sequence[str], value: str, length: int, out: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(length - 1), 0)
    return df.withColumn(out, F.sum(value).over(w) / length)


def numbered(df: DataFrame, by: str, order: Sequence[str], out: str = "idx") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def decimate(df: DataFrame, index: str, step: int) -> DataFrame:
    """Every ``step``-th sample, the first kept; no filter against aliases."""
    return df.where((F.col(index) - 1) % step == 0)


def tick_steps(df: DataFrame, by: str, t: Column, order: Sequence[str], cap: int = 1110) -> DataFrame:
    """One-based tick index, and the step to the next tick (0 for the last),
    at most ``cap``."""
    w = Window.partitionBy(by)
    at = df.withColumn("tick", F.ceil(t - F.min(t).over(w)) + 1)
    step = F.coalesce(F.lead("tick").over(w.orderBy(*order)) - F.col("tick"), F.lit(0))
    return at.withColumn("step", F.least(step, F.lit(cap)))


def per_channel(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, kernel, schema: str) -> DataFrame:
    """``kernel(rows, samples)`` on each whole channel in order.

    Channels are dealt and sorted by Spark and stream through the workers, which
    hold one channel at a time; short channels share batches, so that their
    number costs little."""
    keys = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def finish() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            return kernel(rows, rows[value].to_numpy(float))

        for pdf in batches:
            if pdf.empty:
                continue
            fresh = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            fresh[0] = bool(held) and bool((pdf[keys].iloc[0] != held[-1][keys].iloc[-1]).any())
            cuts = [0, *np.flatnonzero(fresh), len(pdf)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                if (lo or fresh[0]) and held:
                    out.append(finish())
                    held = []
                if hi > lo:
                    held.append(pdf.iloc[lo:hi])
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield finish()

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)


def detect_spikes(df: DataFrame, by: str, order: str, value: str, threshold: float, refractory: int = kernels.REFRACTORY) -> DataFrame:
    """Hits of each channel: by, order, value, and the sample's index."""
    types = dict(df.dtypes)

    def kernel(pdf: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        hits, _ = kernels.spikes(x, threshold, refractory=refractory)
        return pdf.loc[hits, [by, order, value]].assign(idx=hits + 1)

    return per_channel(df.select(by, order, value), [by], [order], value, kernel, f"{by} {types[by]}, {order} {types[order]}, {value} double, idx long")


def filtered(df: DataFrame, by: str, order: str, value: str, b: np.ndarray, a: np.ndarray, zero_phase: bool, out: str = "filtered") -> DataFrame:
    """Each channel filtered; with ``zero_phase`` forth and back.  Channels too
    short for that are left out."""
    types = dict(df.dtypes)
    edge = 3 * (max(len(a), len(b)) - 1)

    def kernel(pdf: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        if zero_phase and len(x) <= edge:
            return pdf.iloc[:0][[by, order]].assign(**{out: np.zeros(0)})
        return pdf[[by, order]].assign(**{out: kernels.filtfilt(b, a, x) if zero_phase else kernels.iir(b, a, x)[0]})

    return per_channel(df.select(by, order, value), [by], [order], value, kernel, f"{by} {types[by]}, {order} {types[order]}, {out} double")


def thresholds(df: DataFrame, by: str, value: str, factor: float = -5.0) -> DataFrame:
    """Threshold by channel: the sample deviation times ``factor``."""
    return df.groupBy(by).agg((F.stddev_samp(value) * factor).alias("threshold"))


def robust_noise(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg((F.median(F.abs(value)) / 0.6745).alias("noise"))


def firing_rate(hits: DataFrame, frames: DataFrame, by: str, frame: str, hit_frame: str, width: float, length: int, base: DataFrame | None = None) -> DataFrame:
    """Hits per frame over the frame's width, the trailing mean of ``length``
    frames, less the channel's baseline mean (columns ``by``, ``base``)."""
    counts = hits.groupBy(F.col(by), F.col(hit_frame).alias(frame)).agg(F.count(F.lit(1)).alias("n_hits"))
    rated = frames.join(counts, [by, frame], "left").withColumn("rate", F.coalesce("n_hits", F.lit(0)) / width)
    rated = trailing_mean(rated, by, [frame], "rate", length, "feature")
    if base is None:
        base = rated.groupBy(by).agg(F.avg("feature").alias("base"))
    return rated.join(base, by).withColumn("feature", F.col("feature") - F.col("base")).drop("base", "n_hits")


def dwt_energies(df: DataFrame, by: str, order: str, value: str, limits: DataFrame, frame: int = 8192, step: int = 990, wavelet: str = "db4") -> DataFrame:
    """Energy by level in trailing frames that end at every ``step``-th sample;
    ``limits`` (by, thresholds array<double>)."""
    types = dict(df.dtypes)

    def run(key: tuple, rows: pd.DataFrame, limit: pd.DataFrame) -> pd.DataFrame:
        t = np.asarray(limit["thresholds"].iloc[0], float) if len(limit) else np.zeros(0)
        x = rows.sort_values(order)[value].to_numpy(float)
        return by_level([by], key, kernels.dwt_energies(x, np.arange(1, len(x) + 1, step), frame, t, wavelet) if len(t) else np.zeros((0, 0)), "energy")

    return (
        df.select(by, order, value).groupBy(by).cogroup(limits.groupBy(by))
        .applyInPandas(run, f"{by} {types[by]}, frame int, level int, energy double")
    )


def by_level(names: Sequence[str], key: Sequence, table: np.ndarray, out: str) -> pd.DataFrame:
    """Rows (key, frame, level, value) of a table [frame, level], from 1."""
    n, levels = table.shape
    frame, level = np.meshgrid(np.arange(1, n + 1, dtype=np.int32), np.arange(1, levels + 1, dtype=np.int32), indexing="ij")
    return pd.DataFrame({**{c: pd.Series([k] * table.size, dtype=object if not table.size else None) for c, k in zip(names, key)}, "frame": frame.ravel(), "level": level.ravel(), out: table.ravel()})


def dwt_limits(df: DataFrame, by: str, order: str, value: str, levels: int = 10, wavelet: str = "db4") -> DataFrame:
    types = dict(df.dtypes)

    def kernel(pdf: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({by: pdf[by].iloc[:1], "thresholds": [kernels.dwt_thresholds(x, wavelet, levels).tolist()]})

    return per_channel(df.select(by, order, value), [by], [order], value, kernel, f"{by} {types[by]}, thresholds array<double>")
