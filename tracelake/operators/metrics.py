"""Redundancy, relevance, errors and sufficient statistics of feature frames.

Frames are rows with array columns.  Sums over pairs of features are taken in
one pass: each task adds up its part of the products in numpy, and only the
partial sums (as many numbers as there are pairs of features) are combined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.columns import safe_corr


def packed_moments(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """by, i, row: line i of the product sums of (1, vector).  Each task sends one
    packed line for each component, and the lines are added up by number, so
    neither a task nor the driver holds more than one matrix."""
    types = dict(df.dtypes)
    keys = list(by)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "i int, row array<double>"])

    def lines(key: tuple, m: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] * len(m) for k, v in zip(keys, key)}, "i": np.arange(len(m), dtype=np.int32), "row": list(m)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False).indices.items() if keys else [((), np.arange(len(pdf)))]
            for key, at in groups:
                if not len(at):
                    continue
                x = np.stack(pdf[vector].iloc[at].to_numpy()).astype(float)
                if np.isnan(x).any():
                    raise ValueError("not-a-number among the features")
                one = np.hstack([np.ones((len(x), 1)), x])
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held.get(key, 0) + one.T @ one
        for key, m in held.items():
            yield lines(key, m)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, row in zip(zip(*(pdf[k] for k in [*keys, "i"])), pdf["row"]):
                sums[key] = sums.get(key, 0) + np.asarray(row, float)
        if sums:
            yield pd.DataFrame([(*key, row) for key, row in sums.items()], columns=[*keys, "i", "row"])

    parts = df.select(*keys, vector).mapInPandas(run, schema)
    return parts.repartition(*keys, "i").mapInPandas(add, schema)


def moments(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """by, i, j, n, sums and product sums of a vector column (i, j from 0)."""
    keys = list(by)
    lines = packed_moments(df, vector, by)
    head = lines.where("i = 0").select(*keys, F.col("row").alias("head"))
    rows = lines.where("i > 0")
    joined = rows.join(head, keys) if keys else rows.crossJoin(F.broadcast(head))
    cells = joined.select(*keys, (F.col("i") - 1).cast("long").alias("i"), "head", F.col("row")[0].alias("si"), F.posexplode(F.slice("row", 2, F.size("row") - 1)).alias("j", "sij"))
    return cells.select(*keys, "i", F.col("j").cast("long").alias("j"), F.col("head")[0].alias("n"), "si", F.get("head", F.col("j") + 1).alias("sj"), "sij")


def correlations(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """by, i, j, corr (0 where a side is constant)."""
    m = moments(df, vector, by)
    var = m.where("i = j").select(*by, F.col("i").alias("k"), (F.col("sij") / F.col("n") - (F.col("si") / F.col("n")) ** 2).alias("v"))
    left, right = var.select(*by, F.col("k").alias("i"), F.col("v").alias("vi")), var.select(*by, F.col("k").alias("j"), F.col("v").alias("vj"))
    cov = F.col("sij") / F.col("n") - F.col("si") * F.col("sj") / F.col("n") ** 2
    # Rounding may leave a constant side a variance of a few units in the last place.
    flat = (F.col("vi") <= 1e-14) | (F.col("vj") <= 1e-14)
    return m.join(left, [*by, "i"]).join(right, [*by, "j"]).select(
        *by, "i", "j", F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(cov, F.sqrt(F.greatest(F.col("vi") * F.col("vj"), F.lit(0.0)))), F.lit(0.0))).alias("corr")
    )


def redundancy(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean magnitude of the correlations of all pairs, each with itself too."""
    return correlations(df, vector, by).groupBy(*by).agg((F.sum(F.abs("corr")) / F.count(F.lit(1))).alias("redundancy"))


def relevance(df: DataFrame, vector: str, n_targets: int, by: Sequence[str] = ()) -> DataFrame:
    """By target (the first ``n_targets`` components): mean magnitude of its
    correlations with the features (the other components)."""
    pairs = correlations(df, vector, by).where((F.col("i") < n_targets) & (F.col("j") >= n_targets))
    return pairs.groupBy(*by, F.col("i").alias("target")).agg((F.sum(F.abs("corr")) / F.count(F.lit(1))).alias("relevance"))


def variance_explained(df: DataFrame, vector: Column, k: int = 20) -> DataFrame:
    """Percent of the variance in each of the first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    fitted = PCA(k=k, inputCol="v", outputCol="p").fit(df.select(array_to_vector(vector.cast("array<double>")).alias("v")))
    rows = [(i + 1, float(x) * 100) for i, x in enumerate(fitted.explainedVariance)]
    return df.sparkSession.createDataFrame(rows, "component int, percent double")


def diagonal_corr(df: DataFrame, by: Sequence[str], true: str, predicted: str) -> DataFrame:
    return df.groupBy(*by).agg(safe_corr(F.col(true), F.col(predicted)).alias("corr"))


def movement_errors(df: DataFrame, window: Sequence[str], dof: str, true: str, predicted: str) -> DataFrame:
    """RMSE by window and degree of freedom; ``intended`` where the true values
    of the window do not sum to zero, else the error is cross-talk."""
    return df.groupBy(*window, dof).agg(
        F.sqrt(F.avg(F.pow(F.col(true) - F.col(predicted), 2))).alias("rmse"), (F.sum(true) != 0).alias("intended")
    )


def evaluate(df: DataFrame, features: str, targets: str, n_targets: int, components: int = 20) -> DataFrame:
    """measure, place, value of a feature set: the variance in its first principal
    components (``pca_vaf``), its redundancy (``corr_xx``) and its relevance to each
    target (``corr_xy``).  Mutual information is not measured: the constants that
    stand for it (1, and the number of each of twelve targets) are given as such."""
    both = df.select(F.concat(F.col(targets).cast("array<double>"), F.col(features).cast("array<double>")).alias("v"), F.col(features).cast("array<double>").alias("f"))
    vaf = variance_explained(both, F.col("f"), components).select(F.lit("pca_vaf").alias("measure"), F.col("component").alias("place"), F.col("percent").alias("value"))
    xx = redundancy(both, "f").select(F.lit("corr_xx").alias("measure"), F.lit(1).alias("place"), F.col("redundancy").alias("value"))
    xy = relevance(both, "v", n_targets).select(F.lit("corr_xy").alias("measure"), (F.col("target") + 1).cast("int").alias("place"), F.col("relevance").alias("value"))
    fixed = df.sparkSession.createDataFrame([("mutual_info_xx", 1, 1.0)] + [("mutual_info_xy", i, float(i)) for i in range(1, 13)], "measure string, place int, value double")
    return vaf.unionByName(xx).unionByName(xy).unionByName(fixed)
