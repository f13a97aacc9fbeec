"""Column expressions shared by the measures. Undefined values are NULL, never NaN, and stay so under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGINAL, SYNTHETIC = "o", "s"


def of(variant: str, value: Column) -> Column:
    """The value where the row is of that variant, else NULL: for conditional aggregates."""
    return F.when(F.col("variant") == variant, value)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; NULL where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def ratio(x: Column, y: Column) -> Column:
    """x / y, NULL for y = 0."""
    return F.try_divide(x, F.nullif(y, F.lit(0.0)))


def symmetric_ratio(o: Column, s: Column) -> Column:
    """min(s / o, o / s); for o = 0: 1 if s = 0, else 0; 0 for s = 0."""
    return F.when(o == 0, F.when(s == 0, 1.0).otherwise(0.0)).when(s == 0, 0.0).otherwise(F.least(ratio(s, o), ratio(o, s)))


def capped_ratio(o: Column, s: Column) -> Column:
    """min(s / o, 1); for o = 0: 1 if s = 0, else 0."""
    return F.when(o == 0, F.when(s == 0, 1.0).otherwise(0.0)).otherwise(F.least(ratio(s, o), F.lit(1.0)))


def bin_of(v: Column, lo: Column, hi: Column, bins: int, slack: float = 0.0) -> Column:
    """Number of the equal-width bin on [lo, hi], the last one closed; 0 for lo = hi. A value within ``slack`` bins below an edge lies on it."""
    return F.when(lo == hi, 0).otherwise(F.least(F.floor(F.try_divide(v - lo, (hi - lo) / bins) + F.lit(slack)), F.lit(bins - 1))).cast("int")


def clipped(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))
