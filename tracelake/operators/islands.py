"""Runs, edges and masks over ordered frames (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, by: str, order: str, active: Column) -> DataFrame:
    """Runs of neighbouring active rows: by, run, start, stop (row numbers), length."""
    w = Window.partitionBy(by).orderBy(order)
    marked = df.select(by, order, active.alias("__on")).withColumn("__row", F.row_number().over(w))
    on = marked.where("__on").withColumn("__island", F.col("__row") - F.row_number().over(w))
    found = on.groupBy(by, "__island").agg(F.min("__row").alias("start"), F.max("__row").alias("stop"), F.count(F.lit(1)).alias("length"))
    return found.withColumn("run", F.row_number().over(Window.partitionBy(by).orderBy("start"))).select(by, "run", "start", "stop", "length")


def edges(df: DataFrame, by: str, order: str, active: Column) -> DataFrame:
    """Starts and stops of movement as a search for changes finds them: the last
    quiet row before movement begins, and its last row.

    Movement at the very start has no such row before it; it then starts at row
    1, and likewise a stop that is never reached is the last row."""
    return runs(df, by, order, active).select(by, F.col("run").alias("window"), F.greatest(F.col("start") - 1, F.lit(1)).alias("start"), "stop")


def sized_windows(found: DataFrame, by: str, size: int | None = None, big_gap: int = 200) -> DataFrame:
    """Runs as windows of one size (given, or the rounded mean length); the run
    just before a gap over ``big_gap`` is left out."""
    w = Window.partitionBy(by).orderBy("start")
    gap = F.lead("start").over(w) - F.col("stop")
    kept = found.withColumn("__gap", gap).where(F.coalesce(F.col("__gap") <= big_gap, F.lit(True)))
    width = F.lit(size) if size is not None else F.round(F.avg("length").over(Window.partitionBy(by))).cast("long")
    return kept.withColumn("stop", F.col("start") + width - 1).select(by, "run", "start", "stop")


def movement_windows(df: DataFrame, by: str, order: str, value: str, size: int | None = None, big_gap: int = 200) -> DataFrame:
    """Windows of positive and of negative values: by, side, run, start, stop.

    All have one size; where none is given it is the rounded mean length of the
    positive windows, or of the negative ones where there are no positive."""
    up = runs(df, by, order, F.col(value) > 0).withColumn("side", F.lit("pos"))
    down = runs(df, by, order, F.col(value) < 0).withColumn("side", F.lit("neg"))
    w = Window.partitionBy(by, "side").orderBy("start")
    found = up.unionByName(down).withColumn("__gap", F.lead("start").over(w) - F.col("stop"))
    kept = found.where(F.coalesce(F.col("__gap") <= big_gap, F.lit(True)))
    of = lambda side: F.round(F.avg(F.when(F.col("side") == side, F.col("length"))).over(Window.partitionBy(by)))
    width = F.lit(size) if size is not None else F.coalesce(of("pos"), of("neg")).cast("long")
    return kept.withColumn("stop", F.col("start") + width - 1).select(by, "side", "run", "start", "stop")


def compacted(df: DataFrame, by: str, order: str, keep: Column) -> DataFrame:
    """Kept rows with their row number in the whole and in the compacted series."""
    w = Window.partitionBy(by).orderBy(order)
    return (
        df.withColumn("row", F.row_number().over(w)).where(keep)
        .withColumn("relative_row", F.row_number().over(w))
    )


def mask_trials(trials: DataFrame, kept: DataFrame, by: str, shift: int = 0) -> DataFrame:
    """Start and stop of each trial counted in the compacted rows alone; trials
    without a kept row are left out.  With ``shift`` the kept rows count as that
    many rows later, as where a mask was taken of differences.

    One exchange and one sort by recording: kept rows are counted along, and no
    trial meets the rows of its recording."""
    own = F.struct(*trials.columns)
    none = F.lit(None).cast(trials.select(own.alias("t")).schema["t"].dataType)
    points = kept.select(by, (F.col("row") + shift).alias("__at"), F.lit(1).alias("__kind"), none.alias("__trial"))
    starts = trials.select(by, F.col("start").alias("__at"), F.lit(0).alias("__kind"), own.alias("__trial"))
    stops = trials.select(by, F.col("stop").alias("__at"), F.lit(2).alias("__kind"), own.alias("__trial"))
    w = Window.partitionBy(by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = points.unionByName(starts).unionByName(stops).withColumn("__n", F.sum((F.col("__kind") == 1).cast("int")).over(w))
    ends = counted.where("__kind <> 1").groupBy("__trial").agg(
        (F.max(F.when(F.col("__kind") == 0, F.col("__n"))) + 1).cast("int").alias("relative_start"),
        F.max(F.when(F.col("__kind") == 2, F.col("__n"))).cast("int").alias("relative_stop"),
    )
    return ends.where("relative_start <= relative_stop").select("__trial.*", "relative_start", "relative_stop")


def cleared(df: DataFrame, by: str, order: str, value: str, active: Column, keep_sign: int) -> DataFrame:
    """``mask`` stays only in runs whose sum of ``value`` has the wanted sign."""
    w = Window.partitionBy(by).orderBy(order)
    flagged = df.withColumn("__on", active).withColumn("__row", F.row_number().over(w))
    ranked = flagged.withColumn("__island", F.col("__row") - F.sum(F.col("__on").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum(value).over(Window.partitionBy(by, "__on", "__island"))
    return ranked.withColumn("mask", F.col("__on") & (F.signum(total) == keep_sign)).drop("__on", "__row", "__island")
