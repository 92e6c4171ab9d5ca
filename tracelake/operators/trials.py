"""Labelling trials and splitting them to training and test sets."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_trials(starts: DataFrame, stops: DataFrame, by: str, start: str, stop: str, n: str) -> DataFrame:
    """Starts and stops paired by their order (the longer list cut off), kept
    where start < stop < number of frames."""
    place = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(c))
    pairs = starts.withColumn("trial", place(start)).join(stops.withColumn("trial", place(stop)), [by, "trial"])
    return pairs.where((F.col(start) < F.col(stop)) & (F.col(stop) < F.col(n)))


def peaks(samples: DataFrame, trial: Sequence[str], dof: str, value: str, order: Sequence[str]) -> DataFrame:
    """Greatest magnitude by trial and degree of freedom, and the value there
    (of equal magnitudes the first in order)."""
    place = F.struct(-F.abs(value), *order)
    return samples.groupBy(*trial, dof).agg(F.min_by(F.col(value), place).alias("peak"), F.max(F.abs(value)).alias("size"))


def gestures(samples: DataFrame, trial: Sequence[str], dof: str, value: str, order: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """Gesture of each trial from its active degrees of freedom: ``dof_d_pos``,
    or ``combo_`` and the names in string order; trials without one are left out."""
    active = peaks(samples, trial, dof, value, order).where(F.col("size") > threshold)
    name = F.concat(F.lit("dof_"), F.col(dof).cast("string"), F.when(F.col("peak") > 0, "_pos").otherwise("_neg"))
    named = active.groupBy(*trial).agg(F.array_join(F.array_sort(F.collect_list(name)), "-").alias("names"), F.count(F.lit(1)).alias("n_active"))
    return named.select(
        *trial, (F.col("n_active") > 1).alias("is_combined"),
        F.when(F.col("n_active") > 1, F.concat(F.lit("combo_"), "names")).otherwise(F.col("names")).alias("gesture_id"),
    )


def split(
    trials: DataFrame, group: str, order: Sequence[str], ratio: float, mode: str = "train_first", by: Sequence[str] = (),
    half_even: bool = True, least: int = 2, seed: int = 2025,
) -> DataFrame:
    """``set`` is train or test for each trial of a gesture, in proportion.

    The number to train is the share of the group rounded half to even, or cut
    down where ``half_even`` is off; groups of fewer than ``least`` are left out.
    ``train_random`` orders by a seeded hash, so it is the same in every run."""
    if mode not in ("train_first", "train_last", "train_random"):
        raise ValueError(f"unknown mode {mode}")
    keys = [*by, group]
    ordering: list[Column] = [F.col(c) for c in order]
    if mode == "train_random":
        ordering = [F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in order), F.lit(str(seed)))), *ordering]
    w = Window.partitionBy(*keys)
    share = F.col("__n") * F.lit(ratio)
    cut = (F.bround(share) if half_even else F.floor(share)).cast("long")
    placed = (
        trials.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") >= least)
        .withColumn("__at", F.row_number().over(w.orderBy(*ordering)))
    )
    train = F.col("__at") > F.col("__n") - cut if mode == "train_last" else F.col("__at") <= cut
    return placed.withColumn("set", F.when(train, "train").otherwise("test")).drop("__n", "__at")


def trial_info(trials: DataFrame, by: Sequence[str], start: str, stop: str) -> DataFrame:
    """Places of the trials once they are put one after the other by start."""
    w = Window.partitionBy(*by).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col(stop) - F.col(start)).over(w), F.lit(0))
    return trials.withColumn("relative_start_idx", before).withColumn("relative_stop_idx", F.col("relative_start_idx") + F.col(stop) - F.col(start))


def windows_from_ends(trials: DataFrame, by: Sequence[str], end: str) -> DataFrame:
    """Each trial reaches from the end of the one before (0 for the first) to its own."""
    w = Window.partitionBy(*by).orderBy(end)
    return trials.withColumn("start", F.lag(end, 1, 0).over(w))


def eligible(trials: DataFrame, amplitudes: str, selected: Sequence[int], combos: bool, up: Sequence[float], down: Sequence[float]) -> DataFrame:
    """Trials whose first moving degree of freedom is selected, whose movement
    count (the sum of magnitudes) is 1 at most unless ``combos``, and whose
    direction has a gain; with that count."""
    moving = F.filter(F.transform(amplitudes, lambda a, i: F.struct((i + 1).alias("dof"), a.alias("amp"))), lambda m: m["amp"] != 0)
    gain = F.when(F.col("__first.amp") > 0, F.element_at(F.array(*map(F.lit, up)), F.col("__first.dof"))).otherwise(
        F.element_at(F.array(*map(F.lit, down)), F.col("__first.dof"))
    )
    found = trials.withColumn("__moving", moving).withColumn("__first", F.try_element_at("__moving", F.lit(1)))
    count = F.aggregate(amplitudes, F.lit(0.0), lambda s, a: s + F.abs(a))
    ok = F.col("__first.dof").isin(*selected) & (F.lit(combos) | (count <= 1)) & (gain != 0)
    return found.where(F.col("__first").isNotNull()).where(ok).withColumn("mvnt_count", count).drop("__moving", "__first")


SPLITS = ("first", "last", "shuffle")


def split_movements(
    trials: DataFrame, by: str, code: str, end: str, percent: float = 0.5, mode: str = "first", train_combos: bool = False, test_combos: bool = True, seed: int = 2025,
) -> DataFrame:
    """Trials split by movement code (array of signed degrees of freedom, more than
    one of them a combination), with ``start``, the end of the trial before (0 for
    the first), ``pos``, the place among those of its code, and ``set``.

    Of each code the share ``percent``, cut down, is for training.  Combinations
    train only where ``train_combos``; those that would are tested instead, and
    no combination is tested unless ``test_combos``: such trials are left out.
    ``shuffle`` orders by a seeded hash, the same in every run."""
    if mode not in SPLITS:
        raise ValueError(f"unknown mode {mode}; there are {', '.join(SPLITS)}")
    if not 0 < percent <= 1:
        raise ValueError("percent is over 0 and at most 1")
    named = trials.withColumn("start", F.lag(end, 1, 0).over(Window.partitionBy(by).orderBy(end)))
    w = Window.partitionBy(by, code)
    order = [F.md5(F.concat_ws("|", F.col(by).cast("string"), F.col(end).cast("string"), F.lit(str(seed))))] if mode == "shuffle" else []
    named = named.withColumn("pos", F.row_number().over(w.orderBy(*order, end))).withColumn("__n", F.count(F.lit(1)).over(w))
    # In decimals, for 0.7 x 90 is a little under 63 in binary.
    cut = F.floor(F.col("__n") * F.lit(Decimal(str(percent))))
    chosen = F.col("pos") > F.col("__n") - cut if mode == "last" else F.col("pos") <= cut
    combo = F.size(code) > 1
    kind = F.when(chosen & (F.lit(train_combos) | ~combo), "train").when(F.lit(test_combos) | ~combo, "test")
    return named.withColumn("set", kind).where("set is not null").drop("__n")


def frame_sets(frames: DataFrame, split: DataFrame, by: str, t: str, end: str, step: float) -> DataFrame:
    """Frames that training or testing trials hold, from the end of the trial before
    to their own, both included; a frame at such an end may be in both."""
    from tracelake.operators.align import in_intervals

    held = in_intervals(frames, split.select(by, F.col("start").alias("__start"), F.col(end).alias("__stop"), "set"), by, t, "__start", "__stop", step)
    marks = held.groupBy(by, t).agg(F.max((F.col("set") == "train").cast("int")).alias("train"), F.max((F.col("set") == "test").cast("int")).alias("test"))
    return marks.select(by, t, (F.col("train") == 1).alias("train"), (F.col("test") == 1).alias("test"))


def test_ranges(frames: DataFrame, split: DataFrame, by: str, t: str, code: str, end: str, step: float) -> DataFrame:
    """First and last place (from 1) of each test trial once test trials are put one
    after the other, code by code in order of their first trial."""
    from tracelake.operators.align import in_intervals

    first = split.groupBy(by, code).agg(F.min(end).alias("__first"))
    tested = split.where("set = 'test'").join(first, [by, code])
    inside = in_intervals(frames.select(by, t), tested.select(by, "start", F.col(end).alias("__stop")), by, t, "start", "__stop", step)
    sizes = inside.groupBy(by, F.col("__stop").alias(end)).agg(F.count(F.lit(1)).alias("size"))
    sized = tested.join(sizes, [by, end], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    w = Window.partitionBy(by).orderBy("__first", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("relative_stop", F.sum("size").over(w)).select(by, end, (F.col("relative_stop") - F.col("size") + 1).alias("relative_start"), "relative_stop")


test_ranges.__test__ = False  # not a test, whatever its name


def down_select(frames: DataFrame, trials: DataFrame, by: str, t: str, start: str, stop: str, dofs: Sequence[int], kinematics: str, features: str, step: float, channels: Sequence[int] | None = None) -> DataFrame:
    """Frames of eligible trials, both ends included, put one after the other by
    trial: place, the trial's end, the chosen degrees of freedom and channels
    (from 1; all channels where none are named)."""
    from tracelake.operators.align import in_intervals

    own = trials.select(by, F.col(start).alias("__start"), F.col(stop).alias("__stop"))
    held = in_intervals(frames.select(by, t, kinematics, features), own, by, t, "__start", "__stop", step)
    pick = lambda c, places: F.array(*(F.get(c, F.lit(p - 1)) for p in places))
    w = Window.partitionBy(by).orderBy("__stop", "__start", t)
    return held.select(
        by, F.row_number().over(w).alias("place"), F.col("__stop").alias(stop), t, pick(kinematics, dofs).alias(kinematics),
        (pick(features, channels) if channels is not None else F.col(features)).alias(features),
    )


def active_dofs(frames: DataFrame, by: str, kinematics: str) -> DataFrame:
    """Degrees of freedom (from 1) whose values do not sum to zero, as an array."""
    sums = frames.select(by, F.posexplode(kinematics).alias("dof", "value")).groupBy(by, "dof").agg(F.sum(F.col("value").cast("double")).alias("total"))
    return sums.groupBy(by).agg(F.sort_array(F.collect_list(F.when(F.col("total") != 0, F.col("dof") + 1))).alias("active"))
