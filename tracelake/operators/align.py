"""Joining streams of events and frames by time.

Everything is keyed by the recording (``by``), so a recording's rows meet in one
partition and no recording sees another's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _merged(events: DataFrame, frames: DataFrame, by: str, ts: str, frame_ts: str) -> DataFrame:
    left = events.withColumn("__frame", F.lit(None).cast(frames.schema[frame_ts].dataType)).withColumn("__t", F.col(ts))
    right = frames.select(by, F.col(frame_ts).alias("__frame"), F.col(frame_ts).alias("__t"))
    return left.unionByName(right, allowMissingColumns=True)


def nearest(events: DataFrame, frames: DataFrame, by: str, ts: str, frame_ts: str, out: str = "frame_ts") -> DataFrame:
    """Each event with the nearest frame time; the earlier of two equally near;
    null for an event before the first or after the last frame.

    One exchange by recording: frames and events are merged, the last frame
    before is carried along in order of time, and the first after in reverse
    order, so that each pass is linear in the rows of a recording."""
    first = Window.partitionBy(by).orderBy("__t", F.col("__frame").isNull().cast("int"))
    last = Window.partitionBy(by).orderBy(F.col("__t").desc(), F.col("__frame").isNull().cast("int"))
    carried = lambda w: F.last("__frame", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back, ahead = carried(first), carried(last)
    t = F.col("__t").cast("double")
    chosen = F.when(
        F.col("__back").isNotNull() & F.col("__ahead").isNotNull(),
        F.when(t - F.col("__back").cast("double") <= F.col("__ahead").cast("double") - t, F.col("__back")).otherwise(F.col("__ahead")),
    )
    merged = _merged(events, frames, by, ts, frame_ts).withColumn("__back", back).withColumn("__ahead", ahead)
    return merged.where("__frame is null").withColumn(out, chosen).select(*events.columns, out)


def nearest_frames(events: DataFrame, frames: DataFrame, by: str, ts: str, frame_ts: str) -> DataFrame:
    """The frames that are nearest to some event, each once."""
    return nearest(events, frames, by, ts, frame_ts, "__near").where("__near is not null").select(by, F.col("__near").alias(frame_ts)).distinct()


def left_rank(events: DataFrame, frames: DataFrame, by: str, ts: str, frame_ts: str, out: str = "idx") -> DataFrame:
    """Each event with the number of frames strictly before it (the place at
    which a sorted search from the left would insert it)."""
    w = Window.partitionBy(by).orderBy("__t", F.col("__frame").isNotNull().cast("int"))
    merged = _merged(events, frames, by, ts, frame_ts)
    return (
        merged.withColumn(out, F.count("__frame").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where("__frame is null").select(*events.columns, out)
    )


def in_intervals(frames: DataFrame, intervals: DataFrame, by: str, t: str, start: str, stop: str, step: float) -> DataFrame:
    """Frames joined with the intervals that hold them, both ends included.

    Both sides also meet on time buckets of width ``step`` (about the length of
    an interval), so that a long recording with many intervals is an equi-join
    over many partitions and not a product of its frames and intervals."""
    bucket = lambda c: F.floor(F.col(c).cast("double") / step)
    spread = intervals.where(F.col(start) <= F.col(stop)).withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(stop))))
    return (
        frames.withColumn("__bucket", bucket(t)).join(spread, [by, "__bucket"])
        .where(F.col(t).between(F.col(start), F.col(stop))).drop("__bucket")
    )


def outside_intervals(frames: DataFrame, intervals: DataFrame, by: str, t: str, start: str, stop: str) -> DataFrame:
    """Frames that no interval holds: the baseline.

    One exchange and one sort by recording: the greatest end of the intervals
    begun so far is carried along, and a frame beyond it is in none."""
    reach = frames.schema[t].dataType
    opened = intervals.where(F.col(start) <= F.col(stop)).select(by, F.col(start).cast(reach).alias("__t"), F.col(stop).cast(reach).alias("__stop"))
    merged = frames.withColumn("__t", F.col(t)).withColumn("__stop", F.lit(None).cast(reach)).unionByName(opened.withColumn("__opens", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("__t", F.col("__opens").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    carried = merged.withColumn("__reach", F.max("__stop").over(w))
    return carried.where(F.col("__opens").isNull() & (F.col("__reach").isNull() | (F.col("__reach") < F.col(t)) | F.col(t).isNull())).select(*frames.columns)


def expand(df: DataFrame, start: str, stop: str, out: str = "idx") -> DataFrame:
    """A row for each index of [start, stop); none for an empty range."""
    return df.where(F.col(start) < F.col(stop)).withColumn(out, F.explode(F.sequence(F.col(start), F.col(stop) - 1)))


def clock_range(kdf: DataFrame, by: str, t: str, offset: str) -> DataFrame:
    """First and last sample of a recording after the clock offset; the offset
    is null, and so is the range, where no start of recording is known."""
    return kdf.groupBy(by).agg((F.min(t) + F.first(offset)).alias("first_sample"), (F.max(t) + F.first(offset)).alias("last_sample"))
