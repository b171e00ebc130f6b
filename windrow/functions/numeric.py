"""Column helpers for denominators, non-finite values and small statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite0(x: Column) -> Column:
    """Null, NaN and infinities become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def safe_den(d: Column) -> Column:
    """A denominator near zero becomes 1."""
    return F.when(F.abs(d) < 1e-9, 1.0).otherwise(d)


def clamp_den(d: Column) -> Column:
    """A denominator of at least 1e-6; negative ones are raised to it too."""
    return F.greatest(d, F.lit(1e-6))


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it does not or is unknown."""
    return F.when(condition, 1.0).otherwise(0.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval; 0 without observations."""
    p = hits / n
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(n <= 0, 0.0).otherwise((centre - spread) / (1 + z * z / n))
