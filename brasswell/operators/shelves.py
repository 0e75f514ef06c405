"""Pages and shelves: top-k reads, never a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 24


def page(df: DataFrame, order: list[str], number: int, size: int = PAGE) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def filled(df: DataFrame, preferred: list[Column], order: list[str], most: int) -> DataFrame:
    """Rows of the first preference, then of the next, then the others, up to so many."""
    return df.orderBy(*(F.desc(F.coalesce(p, F.lit(False))) for p in preferred), *order).limit(most)
