"""Choosing channels: by correlation, by information criteria, by Gram-Schmidt."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.columns import safe_corr
from tracelake.operators.metrics import packed_moments


def sign_split(df: DataFrame, keys: Sequence[str], dof: str, value: str) -> DataFrame:
    """Each degree of freedom as its positive part and its negative magnitude;
    parts that are zero throughout are left out."""
    parts = F.array(
        F.struct(F.lit("pos").alias("side"), F.greatest(F.col(value), F.lit(0.0)).alias("part")),
        F.struct(F.lit("neg").alias("side"), F.greatest(-F.col(value), F.lit(0.0)).alias("part")),
    )
    rows = df.withColumn("__p", F.explode(parts)).select(*keys, dof, F.col("__p.side").alias("side"), F.col("__p.part").alias("part"))
    alive = rows.groupBy(dof, "side").agg(F.max("part").alias("most")).where("most > 0").select(dof, "side")
    return rows.join(alive, [dof, "side"])


def rank_channels(pairs: DataFrame, dof: Sequence[str], channel: str, corr: Column, threshold: float, most: int) -> DataFrame:
    """Channels by degree of freedom in order of |corr|, kept at the threshold,
    then one after the other without those chosen before, ``most`` at most."""
    sized = pairs.withColumn("size", F.abs(corr)).where(F.col("size") >= threshold)
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy(*dof).orderBy(F.col("size").desc(), channel)))
    first = ranked.groupBy(channel).agg(F.min(F.struct(*dof, "rank")).alias("place"))
    return first.orderBy("place").limit(most).select(channel, *(F.col(f"place.{d}").alias(d) for d in dof), "place.rank")


def channel_correlations(samples: DataFrame, dof: Sequence[str], channel: str, part: str, feature: str) -> DataFrame:
    return samples.groupBy(*dof, channel).agg(safe_corr(F.col(part), F.col(feature)).alias("corr"))


def gram(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(product sums, sums, n) of a vector column; as large as the vector is
    wide, whatever the number of rows."""
    lines = packed_moments(df, vector).collect()
    if not lines:
        raise ValueError("no rows to sum up")
    m = np.zeros((len(lines), len(lines)))
    for line in lines:
        m[line.i] = line.row
    return m[1:, 1:], m[0, 1:], float(m[0, 0])


def gram_schmidt(df: DataFrame, vector: str, n_targets: int, most: int = 48, threshold: float = 0.3) -> DataFrame:
    """Forward selection of features (the components after the targets): each
    step takes the one with the greatest |corr| to what is left of any target,
    then takes its share out of targets and features.  The steps need the
    centred products alone, so rows are read once."""
    products, sums, n = gram(df, vector)
    c = products - np.outer(sums, sums) / n
    norm = np.sqrt(np.maximum(np.diag(c), 1e-300))
    r = np.abs(c / np.outer(norm, norm))
    free = [j for j in range(n_targets, len(c)) if r[:n_targets, j].max(initial=0) >= threshold]
    chosen = []
    while free and len(chosen) < most:
        d = np.maximum(np.diag(c), 0)
        size = np.sqrt(np.outer(d[:n_targets], d[free]))
        score = np.abs(c[:n_targets][:, free]) / np.where(size > 1e-9, size, np.inf)
        best = int(np.argmax(score.max(axis=0)))
        j, value = free.pop(best), float(score[:, best].max())
        if value <= 1e-9:
            break
        chosen.append((len(chosen) + 1, j - n_targets, value))
        c = c - np.outer(c[:, j], c[j]) / c[j, j]
    return df.sparkSession.createDataFrame(chosen, "step int, channel int, corr double")


def information_scan(df: DataFrame, vector: str, target: int, order: Sequence[int], criterion: str = "aic", patience: int = 5) -> DataFrame:
    """Criterion of the least-squares model on each growing prefix of ``order``;
    the scan ends after ``patience`` increases in a row."""
    products, sums, n = gram(df, vector)
    c = products - np.outer(sums, sums) / n
    out, rises, last = [], 0, np.inf
    for k in range(1, len(order) + 1):
        own = list(order[:k])
        w = np.linalg.pinv(c[np.ix_(own, own)]) @ c[own, target]
        rss = float(max(c[target, target] - w @ c[own, target], 1e-300))
        value = {"aic": 2 * k + n * np.log(rss), "aicc": 2 * k + n * np.log(rss) + 2 * k * (k + 1) / max(n - k - 1, 1), "bic": k * np.log(n) + n * np.log(rss)}.get(criterion, -k)
        rises = rises + 1 if value > last else 0
        last = value
        out.append((k, own[-1], rss, float(value)))
        if rises >= patience:
            break
    return df.sparkSession.createDataFrame(out, "n_channels int, channel int, rss double, value double")
