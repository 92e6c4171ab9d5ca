"""Session metadata: classification, counts and sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.columns import is_subset


def categories(df: DataFrame, have: Column, rules: Mapping[str, Column], other: str = "OTHER") -> DataFrame:
    """A row for each category whose rule holds (there may be several), or
    ``other``."""
    hits = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return df.withColumn("__have", have).withColumn("category", F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(other))))).drop("__have")


def needs(*members: str | int) -> Column:
    """All of the members are there."""
    return is_subset(F.array(*map(F.lit, members)), F.col("__have"))


def any_of(*members: str | int) -> Column:
    return F.arrays_overlap(F.col("__have"), F.array(*map(F.lit, members)))


#: The degrees of freedom that hands and wrists need.
TASKA = ("d1", "d2", "d3", "d4", "d5", "d6", "d10", "d12")
DEKA = ("d1", "d2", "d3", "d6", "d10", "d12")
DEKA_5 = ("d1", "d2", "d3", "d10", "d12")
FINGERS = ("d1", "d2", "d3", "d4", "d5", "d6")


def dof_categories(annotations: DataFrame, mode: str, deka: Sequence[str] = DEKA) -> DataFrame:
    """job and category by the movements that count for it (there may be several).

    ``annotations`` (job_id, kinematic, type, n_gestures).  What counts: every
    movement (``all``), those with two gestures (``bidirectional``; the wrist
    is then looked up among all movements), or independent ones with two or
    more (``independent``)."""
    counted = {
        "all": F.lit(True), "bidirectional": F.col("n_gestures") == 2,
        "independent": (F.col("type") == "independent") & (F.col("n_gestures") >= 2),
    }[mode]
    sets = annotations.groupBy("job_id").agg(F.collect_set(F.when(counted, F.col("kinematic"))).alias("used"), F.collect_set("kinematic").alias("every"))
    wrist = lambda d: F.array_contains("used" if mode == "independent" else "every", d)
    finger = any_of(*FINGERS)
    rules = {
        "8DOF-TASKA": needs(*TASKA), "6DOF-DEKA": needs(*deka), "3DOF-ETDRF": finger & wrist("d10") & wrist("d12"),
        "2DOF-ETDR": finger & wrist("d12"), "1DOF-ETD": finger,
    }
    return categories(sets, F.col("used"), rules).select("job_id", "category")


def direction_counts(entries: DataFrame, kind: str, n_gestures: str, trials: str) -> DataFrame:
    """Counts and trial sums of each kind, in one and in two directions."""
    one = F.col(n_gestures) < 2
    return entries.where(F.col(kind).isNotNull()).groupBy(kind).agg(
        F.count_if(one).alias("uni"), F.count_if(~one).alias("bi"),
        F.coalesce(F.sum(F.when(one, F.col(trials))), F.lit(0)).alias("uni_trials"), F.coalesce(F.sum(F.when(~one, F.col(trials))), F.lit(0)).alias("bi_trials"),
    )


def counts(df: DataFrame, group: str, category: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("count")).withColumn("category", F.lit(category))


def size_stats(sizes: DataFrame, column: str) -> DataFrame:
    return sizes.agg(
        F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.median(column).alias("median"),
        F.percentile(column, 0.05).alias("p05"), F.percentile(column, 0.95).alias("p95"), F.max(column).alias("most"),
    )


def histogram(df: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """Counts in bins of equal width, the greatest value in the last."""
    span = df.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col(column) - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo")), F.lit(0.0))), F.lit(bins - 1)) + 1
    return df.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
