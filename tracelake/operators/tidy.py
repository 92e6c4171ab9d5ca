"""Shaping feature tables for charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.columns import feature_parts, minmax_sqrt, stack_offset


def binned(df: DataFrame, t: str, values: Sequence[str], bins: int = 660, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each value by time bin; the width is the range over ``bins``, 1 at least."""
    span = df.groupBy(*by).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    wide = df.join(F.broadcast(span), list(by)) if by else df.crossJoin(F.broadcast(span))
    width = F.greatest((F.col("__hi") - F.col("__lo")) / bins, F.lit(1.0))
    return wide.withColumn("bin", F.floor(F.col(t) / width)).groupBy(*by, "bin").agg(F.avg(t).alias(t), *(F.avg(v).alias(v) for v in values))


def long_form(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, feature_id, value, feature_type."""
    rows = df.unpivot(list(keys), list(values), "feature_id", "value")
    return rows.withColumn("feature_type", feature_parts(F.col("feature_id"))[0])


def normalised(df: DataFrame, by: Sequence[str] = ("feature_id",)) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn("value", minmax_sqrt(F.col("value"), F.min("value").over(w), F.max("value").over(w)))


def tidy(df: DataFrame, t: str, kinematics: Sequence[str], features: Sequence[str], bins: int = 660) -> DataFrame:
    """Binned long table; features are normalised, kinematics are not."""
    rows = long_form(binned(df, t, [*kinematics, *features], bins), [t], [*kinematics, *features])
    kept = rows.where(F.col("feature_type") == "kinematics")
    return kept.unionByName(normalised(rows.where(F.col("feature_type") != "kinematics")))


def lines(tidied: DataFrame, gap: float = 1.75) -> DataFrame:
    """Kinematics stacked one above the other."""
    rows = tidied.where(F.col("feature_type") == "kinematics").withColumn("dof", feature_parts(F.col("feature_id"))[1])
    return rows.withColumn("stacked", stack_offset(F.col("value"), F.col("dof"), gap))


def raster(tidied: DataFrame, channels: Sequence[str] = ()) -> DataFrame:
    rows = tidied.where(F.col("feature_type") != "kinematics")
    return rows.where(F.col("feature_id").isin(*channels)) if channels else rows


def sampled(channels: DataFrame, column: str, n: int = 192, seed: int = 42) -> DataFrame:
    """n distinct values, the same in every run."""
    return channels.select(column).distinct().orderBy(F.md5(F.concat_ws("|", F.col(column).cast("string"), F.lit(str(seed)))), column).limit(n)


def wide_rows(df: DataFrame, keys: Sequence[str], vector: str, prefix: str) -> DataFrame:
    """A vector column as rows (keys, feature_id, value)."""
    return df.select(*keys, F.posexplode(vector).alias("__i", "value")).select(*keys, F.concat(F.lit(prefix + "_"), F.col("__i") + 1).alias("feature_id"), "value")


def heatmap(tidied: DataFrame, feature_type: str, channels: Sequence[str] = ()) -> DataFrame:
    """Cells of one feature set, and of some of its channels where they are named;
    the same rows are drawn as lines, one for each channel."""
    rows = tidied.where(F.col("feature_type") == feature_type)
    return rows.where(F.col("feature_id").isin(*channels)) if channels else rows


feature_lines = heatmap


def event_marks(starts: DataFrame, stops: DataFrame, start: str, stop: str) -> DataFrame:
    """Starts and stops as one table: timestamp, event."""
    one = lambda df, c, name: df.select(F.col(c).alias("timestamp"), F.lit(name).alias("event"))
    return one(starts, start, "start").unionByName(one(stops, stop, "stop"))


def figure_rows(frames: DataFrame, by: str, order: str, kinematics: str, features: str, every: int = 5) -> DataFrame:
    """Each ``every``-th frame, the first kept, in long form: panel, line (from 1),
    value.  Kinematics are set apart by their number; features are normalised to
    the range of all frames of their recording."""
    w, all_ = Window.partitionBy(by).orderBy(order), Window.partitionBy(by, "panel", "line")
    numbered = frames.withColumn("__row", F.row_number().over(w))
    part = lambda panel, c: numbered.select(by, order, "__row", F.lit(panel).alias("panel"), F.posexplode(F.col(c).cast("array<double>")).alias("line", "value"))
    long = part("kinematics", kinematics).unionByName(part("features", features)).withColumn("line", F.col("line") + 1)
    scaled = F.try_divide(F.col("value") - F.min("value").over(all_), F.max("value").over(all_) - F.min("value").over(all_))
    value = F.when(F.col("panel") == "kinematics", F.col("value") + F.col("line")).otherwise(scaled)
    return long.withColumn("value", value).where((F.col("__row") - 1) % every == 0).drop("__row")


def figure_limits(frames: DataFrame, by: str, features: str, high: float = 95.0, low: float = 5.0) -> DataFrame:
    """by, low, high: the percentiles of the least and of the greatest feature of
    each frame; the k-th of n sorted values is the percentile 100 (k - 0.5) / n,
    between them straight lines, beyond them the first and the last value."""
    values = F.col(features).cast("array<double>")
    ends = frames.select(by, F.explode(F.array(F.struct(F.lit("low").alias("end"), F.array_min(values).alias("value")), F.struct(F.lit("high").alias("end"), F.array_max(values).alias("value")))).alias("e"))
    ends = ends.select(by, "e.end", "e.value").where("value is not null")
    w = Window.partitionBy(by, "end")
    ranked = ends.withColumn("k", F.row_number().over(w.orderBy("value"))).withColumn("n", F.count(F.lit(1)).over(w))
    at = F.least(F.greatest(F.when(F.col("end") == "low", low).otherwise(high) / 100 * F.col("n") + 0.5, F.lit(1.0)), F.col("n").cast("double"))
    weight = F.greatest(1 - F.abs(F.col("k") - at), F.lit(0.0))
    found = ranked.where(F.abs(F.col("k") - at) < 1).groupBy(by, "end").agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"))
    return found.groupBy(by).agg(F.max(F.when(F.col("end") == "low", F.col("value"))).alias("low"), F.max(F.when(F.col("end") == "high", F.col("value"))).alias("high"))
