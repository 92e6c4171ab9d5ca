"""Column expressions: scalar maths, strings, arrays, and safe aggregates.

All of them are built from Spark's own functions, so they stay in generated
code.  Where the domain treats an undefined value as zero this is said here,
since ANSI mode would raise instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of a group; 0 where either side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def digital_to_analog(samples: Column, max_anlg: Column, min_anlg: Column, max_dig: Column, min_dig: Column) -> Column:
    """Array of raw counts to single-precision values."""
    scale = (max_anlg - min_anlg) / (max_dig - min_dig)
    return F.transform(samples, lambda s: (s * scale).cast("float"))


def clip_gain(x: Column, gain: Column | float = 1.0, dead: float = 0.2) -> Column:
    """Gain with a dead zone of ``dead`` about zero; values that the zone would
    carry across zero become 0; the result is clipped to -1 .. 1."""
    g = gain if isinstance(gain, Column) else F.lit(float(gain))
    up = (x * g - dead) / (1 - dead)
    down = (x * g + dead) / (1 - dead)
    moved = F.when(x >= 0, F.greatest(up, F.lit(0.0))).otherwise(F.least(down, F.lit(0.0)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), moved))


def cube_root(x: Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(1 / 3))


def minmax_sqrt(value: Column, low: Column, high: Column) -> Column:
    """Range-normalised value times the square root of the maximum; 0 where the
    range is 0 or the result is not a number."""
    scaled = F.try_divide(value - low, high - low) * F.sqrt(high)
    return F.when(high == low, 0.0).otherwise(F.coalesce(F.nanvl(scaled, F.lit(0.0)), F.lit(0.0)))


def range_normalise(value: Column, low: Column, high: Column) -> Column:
    return F.try_divide(value - low, high - low)


def stack_offset(value: Column, row: Column, gap: float = 1.75) -> Column:
    return value + row * gap


def clean_path(path: Column) -> Column:
    """Forward slashes, none at the ends."""
    return F.btrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def swap_extension(path: Column, old: str, new: str) -> Column:
    return F.regexp_replace(path, F.lit(f"\\.{old}$"), F.lit(f".{new}"))


def tail(path: Column, n: int = 15) -> Column:
    return F.right(path, F.lit(n))


def feature_parts(name: Column) -> tuple[Column, Column]:
    """``type_id`` to (type, id)."""
    parts = F.split(name, "_", 2)
    return parts[0], parts[1].cast("int")


def movement_code(amplitudes: Column) -> Column:
    """Signed one-based numbers of the non-zero degrees of freedom."""
    coded = F.transform(amplitudes, lambda a, i: F.signum(a).cast("int") * (i + 1))
    return F.filter(coded, lambda c: c != 0)


def flex_extend(amplitudes: Column) -> Column:
    """(flexion, extension) flags by degree of freedom."""
    return F.transform(amplitudes, lambda a: F.array(a > 0, a < 0))


def is_subset(of: Column, whole: Column) -> Column:
    return F.size(F.array_except(of, whole)) == 0


def tick_index(t: Column, first: Column) -> Column:
    """One-based sample index of a tick relative to the first."""
    return F.ceil(t - first) + 1


def aic(n: Column, rss: Column, k: Column) -> Column:
    return 2 * k + n * F.log(rss)


def aicc(n: Column, rss: Column, k: Column) -> Column:
    return aic(n, rss, k) + F.try_divide(2 * k * (k + 1), n - k - 1)


def bic(n: Column, rss: Column, k: Column) -> Column:
    return k * F.log(n) + n * F.log(rss)
