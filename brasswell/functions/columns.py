"""Rules and vector arithmetic as column expressions; all stay inside generated code or Spark's higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def comparable_dot(a: Column, b: Column) -> Column:
    """The dot product; minus infinity where dimensions differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.lit(float("-inf")))


def cosine(a: Column, b: Column) -> Column:
    """0 where the product of the lengths is up to 1e-9."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 1e-9, dot(a, b) / length).otherwise(F.lit(0.0))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def stepped(value: Column, factor: float, step: int) -> Column:
    """value * factor, rounded half up to a multiple of step."""
    return F.floor(value * F.lit(factor) / step + 0.5) * step


def hyphenless(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit("-"), F.lit(""))


def half_up(value: Column) -> Column:
    """Rounded half up, towards plus infinity for negative values too."""
    return F.floor(value + 0.5)


def money(name: str) -> Column:
    """Exact cents, so that sums don't hang on the order of rows."""
    return F.col(name).cast("decimal(18,2)")
