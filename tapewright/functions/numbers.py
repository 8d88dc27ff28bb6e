"""Guards for doubles. Spark orders NaN above every number; the guards make NaN compare as false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def above(x: Column, bound) -> Column:
    return (x > bound) & ~F.isnan(x)


def at_least(x: Column, bound) -> Column:
    return (x >= bound) & ~F.isnan(x)


def is_finite(x: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def to_double(text: Column) -> Column:
    """Text to double, 0.0 where it does not parse."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def to_long(text: Column) -> Column:
    """Text to long, 0 where it is not a whole number."""
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.coalesce(whole, F.lit(0).cast("bigint"))
