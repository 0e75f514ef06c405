"""First rows of groups, ranks and margins, bounded logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the least by ``order`` (column names): a partial aggregate, so a hot key costs a row a task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in (*order, *rest)))


def newest(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The log's newest rows, at most so many: a top-k, not a global sort."""
    return df.orderBy(*order).limit(most)


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


#: Pieces that a table is numbered in.
PIECES = 64


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its place, from 1, by a number that orders it (ties have no order). Rows are ranked inside ranges of about equal size, and
    the ranges' sizes are added up: no task sees more than a range."""
    cuts = df.approxQuantile(order, [i / PIECES for i in range(1, PIECES)], 0.005)
    piece = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("_piece", piece)
    sizes = {r["_piece"]: r["count"] for r in rows.groupBy("_piece").count().collect()}  # PIECES at most
    ahead, upto = 0, []
    for k in range(max(sizes, default=0) + 1):
        upto.append(F.lit(ahead).cast("long"))
        ahead += sizes.get(k, 0)
    rank = F.row_number().over(Window.partitionBy("_piece").orderBy(order))
    return rows.withColumn(name, rank + F.get(F.array(*upto), F.col("_piece"))).drop("_piece")
