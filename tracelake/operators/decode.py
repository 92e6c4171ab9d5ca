"""Kalman decoding of kinematics from features, by two models.

Training needs sums over the frames only; they are taken in one distributed
pass, and the small matrices are solved on the driver.  Decoding is a fold over
the frames of a recording, one recording in each group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import kernels
from tracelake.operators.select import gram


@dataclass(frozen=True)
class Model:
    a: np.ndarray
    w: np.ndarray
    h: np.ndarray
    q: np.ndarray
    stride: int = 1


def train(frames: DataFrame, by: str, order: str, state: str, features: str, n_state: int) -> Model:
    """First-order model: x' = A x + w, z = H x + q, without removal of means."""
    w = Window.partitionBy(by).orderBy(order)
    joined = F.concat(F.col(state).cast("array<double>"), F.col(features).cast("array<double>"))
    now, _, m = gram(frames.select(joined.alias("v")), "v")
    pairs = frames.withColumn("__next", F.lead(state).over(w)).where("__next is not null")
    both = F.concat(F.col(state).cast("array<double>"), F.col("__next").cast("array<double>"))
    steps, _, _ = gram(pairs.select(both.alias("v")), "v")
    n = n_state
    x1x1, x1x2, x2x2 = steps[:n, :n], steps[:n, n:], steps[n:, n:]
    a = x1x2.T @ kernels.pinv(x1x1)
    noise = (x2x2 - a @ x1x2) / (m - 1)
    xx, xz, zz = now[:n, :n], now[:n, n:], now[n:, n:]
    h = xz.T @ kernels.pinv(xx)
    return Model(a, noise, h, (zz - h @ xz) / m)


def motion(positions: np.ndarray, period: float = 1 / 30) -> np.ndarray:
    """Position, speed and acceleration [frame, 3 x degree of freedom], by degree
    of freedom interleaved: smoothed positions, their smoothed differences, and
    the differences of these, each times the period; zeros at the end."""
    n, dofs = positions.shape
    state = np.zeros((n, 3 * dofs))
    for d in range(dofs):
        p = kernels.savitzky_golay(positions[:, d])
        v = kernels.savitzky_golay(np.diff(p) * period)
        state[:, 3 * d], state[: n - 1, 3 * d + 1], state[: n - 2, 3 * d + 2] = p, v, np.diff(v) * period
    return state


def motions(frames: DataFrame, by: str, order: str, state: str, period: float = 1 / 30) -> DataFrame:
    """``frames`` with ``motion``, one recording in each group (a recording holds
    30 frames a second); recordings of fewer than 10 frames are left out."""
    schema = frames.select("*", F.array(F.lit(0.0)).alias("motion")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        if len(pdf) < 10:
            return pdf.iloc[:0].assign(motion=pd.Series(dtype=object))
        return pdf.assign(motion=list(motion(np.stack(pdf[state].to_numpy()).astype(float), period)))

    return frames.groupBy(by).applyInPandas(run, schema)


def train_third(frames: DataFrame, by: str, order: str, state: str, features: str, n_state: int, period: float = 1 / 30) -> Model:
    """Third-order model: a position gains its speed, a speed its acceleration,
    each times the period; the acceleration is the least-squares fit from the
    whole state before.  Sums are taken in Spark, as in ``train``."""
    n = 3 * n_state
    moving = motions(frames.select(by, order, state, features), by, order, state, period)
    now, _, m = gram(moving.select(F.concat("motion", F.col(features).cast("array<double>")).alias("v")), "v")
    w = Window.partitionBy(by).orderBy(order)
    pairs = moving.withColumn("__next", F.lead("motion").over(w)).where("__next is not null")
    steps, _, _ = gram(pairs.select(F.concat("motion", "__next").alias("v")), "v")
    x1x1, x1x2, x2x2 = steps[:n, :n], steps[:n, n:], steps[n:, n:]
    a = np.eye(n) + np.diag(np.full(n - 1, period), 1)
    a[2::3] = x1x2[:, 2::3].T @ kernels.pinv(x1x1)
    noise = (x2x2 - a @ x1x2) / (m - 1)
    xx, xz, zz = now[:n, :n], now[:n, n:], now[n:, n:]
    h = xz.T @ kernels.pinv(xx)
    return Model(a, (noise + noise.T) / 2, h, (zz - h @ xz) / m, stride=3)


#: Ways to train a decoder by name; others can be added.
DECODERS = {"standard": train, "third-order": train_third}


def train_decoder(name: str, frames: DataFrame, by: str, order: str, state: str, features: str, n_state: int) -> Model:
    if name not in DECODERS:
        raise ValueError(f"unknown decoder {name}; there are {', '.join(sorted(DECODERS))}")
    return DECODERS[name](frames, by, order, state, features, n_state)


class Filter:
    """State and covariance between frames; the first frame only sets out."""

    def __init__(self, model: Model, gain: np.ndarray | float = 1.0, x: np.ndarray | None = None, p: np.ndarray | None = None, seen: bool = False) -> None:
        size = len(model.a)
        self.model, self.seen = model, seen
        self.bound = 1 / np.asarray(gain, float)
        self.x = np.zeros(size) if x is None else x
        self.p = np.zeros((size, size)) if p is None else p

    def step(self, z: np.ndarray) -> np.ndarray:
        m = self.model
        if not self.seen:
            self.seen = True
            return np.zeros(len(self.x) // m.stride)
        x, p = m.a @ self.x, m.a @ self.p @ m.a.T + m.w
        k = p @ m.h.T @ kernels.pinv(m.h @ p @ m.h.T + m.q)
        x = x + k @ (z - m.h @ x)
        self.p = (np.eye(len(x)) - k @ m.h) @ p
        x[:: m.stride] = np.clip(x[:: m.stride], -self.bound, self.bound)
        self.x = x
        return x[:: m.stride].copy()


def decode(frames: DataFrame, by: str, order: str, features: str, model: Model, gain: float = 1.0) -> DataFrame:
    """by, order, predicted array<double>."""
    types = dict(frames.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        f = Filter(model, gain)
        return pdf[[by, order]].assign(predicted=[f.step(np.asarray(z, float)).tolist() for z in pdf[features]])

    return frames.select(by, order, features).groupBy(by).applyInPandas(run, f"{by} {types[by]}, {order} {types[order]}, predicted array<double>")
