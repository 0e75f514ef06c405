"""Filters whose predicates are all optional, and text search over several columns and nested members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasswell.functions.columns import hyphenless


def holds(columns: list[Column], query: str) -> Column:
    """Whether a column (text, or an array of texts) contains the query in any case; nulls don't."""
    q = F.lit(query.lower())

    def one(c: Column, nested: bool) -> Column:
        return F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), q)) if nested else F.contains(F.lower(c), q), F.lit(False))

    found = F.lit(False)
    for c in columns:
        nested = isinstance(c, tuple)
        found = found | one(c[0] if nested else c, nested)
    return found


def members(array: Column) -> tuple[Column]:
    """Marks a column of holds() as an array of texts."""
    return (array,)


def searched(df: DataFrame, query: str | None, columns: list, codes: list[Column] = (), least: int = 1) -> DataFrame:
    """Rows in which a column contains the query, or a code does without hyphens. No rows for a query that is blank or shorter than ``least``."""
    text = (query or "").strip()
    if len(text) < max(1, least):
        return df.limit(0)
    match = holds(columns, text)
    for c in codes:
        match = match | F.coalesce(F.contains(hyphenless(c), F.lit(text.lower().replace("-", ""))), F.lit(False))
    return df.where(match)


def where_all(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal the values given; None and 'all' ask for nothing, a list for one of its values."""
    for name, value in wanted.items():
        if value is None or value == "all":
            continue
        df = df.where(F.col(name).isin(value) if isinstance(value, list | tuple) else F.col(name) == value)
    return df


def stock_is(df: DataFrame, state: str | None, stock: str = "stock") -> DataFrame:
    """available (over 0), low (1 to 5), none (0 or less); anything else keeps all."""
    s = F.col(stock)
    kinds = {"available": s > 0, "low": (s > 0) & (s <= 5), "none": s <= 0}
    return df.where(kinds[state]) if state in kinds else df
