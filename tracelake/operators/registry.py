"""Feature sets by name; others can be added.  Decoders by name are in ``decode``.

A feature set takes the samples of a recording (keys, idx from 1, value), the
ticks of its decode frames (tick: the one-based sample at which a frame ends its
wait, in order) and, where it has one, a baseline recording with ticks of its
own.  Keys are the channel and, for many recordings at once, ``recordings``, the
columns by which ticks belong to them.

The unit of work is a channel of a recording, for the zero-phase filter needs it
as a whole; ticks travel as one array a recording (30 numbers a second), and of
a baseline only a channel's few numbers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import kernels


@dataclass
class Recording:
    """What a feature set works on."""

    samples: DataFrame
    ticks: DataFrame
    baseline: DataFrame | None = None
    baseline_ticks: DataFrame | None = None
    recordings: Sequence[str] = ()
    channel: str = "chan"
    params: Mapping[str, Any] = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return [*self.recordings, self.channel]

    def get(self, name: str, default: Any) -> Any:
        return type(default)(self.params.get(name, default))


FEATURE_SETS: dict[str, Callable[[Recording], DataFrame]] = {}


def feature_set(name: str) -> Callable:
    def add(f: Callable[[Recording], DataFrame]) -> Callable[[Recording], DataFrame]:
        FEATURE_SETS[name] = f
        return f

    return add


def extract(name: str, recording: Recording) -> DataFrame:
    """Features (keys, frame from 1, ..., feature) of a recording.

    With the parameter ``timed`` a column ``seconds`` tells how long a frame's
    part of its channel took."""
    if name not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {name}; there are {', '.join(sorted(FEATURE_SETS))}")
    return FEATURE_SETS[name](recording)


def wide(features: DataFrame, keys: Sequence[str], channel: str = "chan") -> DataFrame:
    """One row a frame with the array of all its features, channel by channel and
    within one level by level."""
    order = [channel, *(c for c in ("level",) if c in features.columns)]
    put = F.sort_array(F.collect_list(F.struct(*order, "feature")))
    return features.groupBy(*keys, "frame").agg(F.transform(put, lambda s: s["feature"]).alias("features"))


def _by_channel(r: Recording, samples: DataFrame, ticks: DataFrame, base: DataFrame | None, kernel: Callable, level: bool) -> DataFrame:
    """``kernel(x, ticks, base)`` of each channel: a row by frame, or by frame and level."""
    keys, of = r.keys, list(r.recordings)
    types = dict(samples.dtypes)
    marks = ticks.groupBy(*of).agg(F.sort_array(F.collect_list(F.col("tick").cast("long"))).alias("ticks"))
    # Under names of their own, for both sides come of the same samples.
    channels = samples.select(*(F.col(k).alias(k) for k in keys)).distinct()
    side = channels.join(marks, of) if of else channels.crossJoin(F.broadcast(marks))
    side = side.join(base, keys, "left") if base is not None else side.withColumn("base", F.array().cast("array<double>"))
    timed = bool(r.params.get("timed", False))
    names = ["frame", *(["level"] if level else []), "feature", *(["seconds"] if timed else [])]
    kinds = {"frame": "int", "level": "int", "feature": "double", "seconds": "double"}

    def run(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        table = np.zeros((0, 1))
        if len(rows) and len(own):
            given = own["base"].iloc[0]
            x = rows.sort_values("idx")["value"].to_numpy(float)
            table = kernel(x, np.asarray(own["ticks"].iloc[0], np.int64), np.asarray([] if given is None else given, float))
            table = table.reshape(len(table), -1)
        n, m = table.shape
        out = {k: [v] * n * m for k, v in zip(keys, key)}
        out["frame"] = np.repeat(np.arange(1, n + 1, dtype=np.int32), m)
        out["level"] = np.tile(np.arange(1, m + 1, dtype=np.int32), n)
        out["feature"] = table.ravel()
        out["seconds"] = (time.perf_counter() - began) / max(n, 1)
        return pd.DataFrame(out, columns=[*keys, *names])

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{c} {kinds[c]}" for c in names)])
    return samples.select(*keys, "idx", "value").groupBy(*keys).cogroup(side.groupBy(*keys)).applyInPandas(run, schema)


def _numbers(r: Recording, kernel: Callable) -> DataFrame | None:
    """``base``: a channel's numbers from the baseline; null where there is none."""
    if r.baseline is None:
        return None
    own = r.baseline_ticks if r.baseline_ticks is not None else r.ticks
    cells = _by_channel(Recording(r.baseline, own, recordings=r.recordings, channel=r.channel), r.baseline, own, None, kernel, True)
    return cells.groupBy(*r.keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "feature"))), lambda s: s["feature"]).alias("base"))


def _high_passed(x: np.ndarray) -> np.ndarray:
    """The filtered channel; one too short for the filter has no samples."""
    return kernels.filtfilt(*kernels.HIGH_PASS, x) if len(x) > 12 else x[:0]


def _with_last(features: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Less the baseline; the last frame has no samples after it and is 0."""
    return np.r_[features - (base[0] if len(base) else 0.0), 0.0]


@feature_set("NFR")
def firing_rate(r: Recording) -> DataFrame:
    """Threshold crossings a second, the mean of nine frames, less the mean of the
    baseline.  Thresholds are deviations of the filtered channel; those of the
    baseline are of the raw one."""
    k, frames, cap, refractory = r.get("threshold", -5.0), r.get("frames", 9), r.get("cap", 1110), r.get("refractory", kernels.REFRACTORY)

    def features(x: np.ndarray, ticks: np.ndarray, raw: np.ndarray | None = None) -> np.ndarray:
        limit = k * np.std(x if raw is None else raw, ddof=1) if len(x) > 1 else 0.0
        return kernels.rates(x, ticks, limit, frames=frames, refractory=refractory, cap=cap)

    def mean(x: np.ndarray, ticks: np.ndarray, _: np.ndarray) -> np.ndarray:
        found = features(_high_passed(x), ticks, x)
        return np.array([[found.mean() if len(found) else 0.0]])

    base = _numbers(r, mean)
    return _by_channel(r, r.samples, r.ticks, base, lambda x, t, b: _with_last(features(_high_passed(x), t), b), False)


@feature_set("MAV")
def mean_abs(r: Recording) -> DataFrame:
    """Mean magnitude of the filtered channel less that of the baseline.  Mode
    ``reference`` (default): a ring of cells that grows to the longest chunk seen,
    so that the newest chunk and the oldest left-over cells are averaged.  Mode
    ``window``: the last ``window_samples`` samples before each tick."""
    cap, mode, span = r.get("cap", 1110), r.get("mode", "reference"), r.get("window_samples", 9000)
    cells = int(r.get("window_seconds", 0.3) // 0.033)
    if mode not in ("reference", "window"):
        raise ValueError(f"unknown mode {mode}")

    def features(x: np.ndarray, ticks: np.ndarray) -> np.ndarray:
        if mode == "reference":
            return kernels.ring_magnitudes(x, ticks, cells, cap)
        total = np.cumsum(np.r_[0.0, np.abs(x)])
        ends = np.clip(ticks[1:] - 1, 0, len(x))
        return (total[ends] - total[np.maximum(ends - span, 0)]) / span

    def mean(x: np.ndarray, ticks: np.ndarray, _: np.ndarray) -> np.ndarray:
        found = features(_high_passed(x), ticks)
        return np.array([[found.mean() if len(found) else 0.0]])

    base = _numbers(r, mean)
    return _by_channel(r, r.samples, r.ticks, base, lambda x, t, b: _with_last(features(_high_passed(x), t), b), False)


@feature_set("SBP")
def band_power(r: Recording) -> DataFrame:
    """Band-passed, every 15th sample, mean magnitude of the last 100 at every
    66th; as many frames as there are ticks, the last one repeated or cut off."""
    step, length, every = r.get("step", 15), r.get("length", 100), r.get("every", 66)

    def features(x: np.ndarray, ticks: np.ndarray, _: np.ndarray) -> np.ndarray:
        kept = np.abs(kernels.filtfilt(*kernels.BAND_PASS, x))[::step] if len(x) > 6 else np.zeros(0)
        total = np.cumsum(np.r_[0.0, kept])
        ends = np.arange(1, len(kept) + 1, every)
        found = (total[ends] - total[np.maximum(ends - length, 0)]) / length
        if not len(found):
            return np.zeros(0)
        return np.r_[found, np.repeat(found[-1], max(0, len(ticks) - len(found)))][: len(ticks)]

    return _by_channel(r, r.samples, r.ticks, None, features, False)


@feature_set("SBP-CAR")
def referenced_band_power(r: Recording) -> DataFrame:
    """The mean of all channels is taken out of each sample first."""
    mean = r.samples.groupBy(*r.recordings, "idx").agg(F.avg("value").alias("__mean"))
    less = r.samples.join(mean, [*r.recordings, "idx"]).withColumn("value", F.col("value") - F.col("__mean")).drop("__mean")
    return band_power(Recording(less, r.ticks, recordings=r.recordings, channel=r.channel, params=r.params))


def _wavelet(wavelet: str, levels: int) -> Callable[[Recording], DataFrame]:
    def energies(r: Recording) -> DataFrame:
        """Energy by level of the trailing frame at each tick (the last sample for
        ticks beyond it); thresholds are the baseline's, or the channel's own
        where no baseline is given."""
        n, length = r.get("levels", levels), r.get("frame", 8192)
        limits = lambda x: kernels.dwt_thresholds(x, wavelet, n)
        base = _numbers(r, lambda x, t, b: limits(x)[None, :])

        def features(x: np.ndarray, ticks: np.ndarray, b: np.ndarray) -> np.ndarray:
            return kernels.dwt_energies(x, np.minimum(ticks, len(x)), length, b if len(b) else limits(x), wavelet)

        return _by_channel(r, r.samples, r.ticks, base, features, True)

    return energies


feature_set("DWT-DB4")(_wavelet("db4", 10))
feature_set("DWT-DB1")(_wavelet("db1", 13))


def load(samples: DataFrame, decode_frames: DataFrame, baseline_frames: DataFrame, offset: int, time_column: str = "nip_time", channels: int = 192) -> Recording:
    """A recording from one stream of samples (chan, t, value; t the sample's
    time) and the frame times of its training and baseline files.

    Both parts are the samples between the first and the last frame's time plus
    the clock ``offset``, of the first ``channels`` channels, numbered from 1 in
    each; ticks are the frames' times relative to the first, rounded up."""

    def part(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
        bounds = frames.agg(F.min(time_column).alias("__a"), F.max(time_column).alias("__b"))
        near = samples.where(F.col("chan") < channels).crossJoin(F.broadcast(bounds))
        inside = near.where(F.col("t").between(F.col("__a") + offset, F.col("__b") + offset))
        own = inside.select("chan", (F.floor(F.col("t") - F.col("__a") - offset) + 1).cast("long").alias("idx"), "value")
        ticks = frames.crossJoin(F.broadcast(bounds)).select((F.ceil(F.col(time_column) - F.col("__a")) + 1).cast("long").alias("tick"))
        return own, ticks

    (data, ticks), (base, base_ticks) = part(decode_frames), part(baseline_frames)
    return Recording(data, ticks, base, base_ticks)


def samples_of(recordings: DataFrame) -> DataFrame:
    """Samples (chan, t, value) of rows of arrays (chan, t0, samples)."""
    at = recordings.select("chan", "t0", F.posexplode("samples").alias("i", "value"))
    return at.select("chan", (F.col("t0") + F.col("i")).alias("t"), F.col("value").cast("double").alias("value"))


def ticks_of(frames: DataFrame, by: str, t: str) -> DataFrame:
    """Ticks of frames with their time in samples, by recording."""
    first = F.min(t).over(Window.partitionBy(by))
    return frames.select(by, (F.ceil(F.col(t) - first) + 1).cast("long").alias("tick"))
