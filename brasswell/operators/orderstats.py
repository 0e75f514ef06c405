"""Exact order statistics of groups that fit no task: histograms narrow each wanted place to a span of values until it holds one value or few rows.

Each round counts rows by (group, place, bin) with partial aggregates, so that a group's rows never meet; the bin that holds the place becomes the next span, with
the least and greatest value really in it as borders. A span whose borders differ always loses at least one of them, so rounds end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasswell.sources.storage import stored

#: Bins of a span in a round.
BINS = 1024
#: Rows that are sorted in one list once a span holds no more.
FEW = 2048


def places(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group, name, value: of each group's values in ascending order the one at place floor(n * share), from 0, and the last one at most; not interpolated.
    Null and NaN values are left out; a group of them only has no row; a null group is a group."""
    usable = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    whole = usable.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("share")) for n, s in shares.items())))
    spans = whole.withColumn("w", wanted).select("g", "w.name", F.least(F.floor(F.col("n") * F.col("w.share")), F.col("n") - 1).alias("k"), "n", "low", "high")
    spans = stored(spans)
    done = []
    while True:
        done.append(spans.where("low = high").select("g", "name", F.col("low").alias("v")))
        few = spans.where(f"low < high AND n <= {FEW}")
        listed = _met(usable, few).groupBy("g", "name", "k").agg(F.array_sort(F.collect_list("v")).alias("s"))
        done.append(listed.select("g", "name", F.get("s", F.col("k").cast("int")).alias("v")))
        open_ = spans.where(f"low < high AND n > {FEW}")
        if open_.isEmpty():
            break
        spans = stored(_narrowed(usable, open_))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("g").alias(group), "name", F.col("v").alias(value))


def _met(rows: DataFrame, spans: DataFrame) -> DataFrame:
    named = spans.withColumnRenamed("g", "h")
    return rows.join(named, F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("low"), F.col("high"))).drop("h")


def _narrowed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    # Halves keep the width of finite spans finite; each border has a bin of its own, so ties there and infinite borders go first.
    half = F.col("high") / 2 - F.col("low") / 2
    at = F.floor((F.col("v") / 2 - F.col("low") / 2) / half * (BINS - 1))
    bin_ = F.when(F.col("v") == F.col("high"), BINS - 1).when(F.col("v") == F.col("low"), 0).when((half > 0) & (half < float("inf")), F.least(F.greatest(at, F.lit(1)), F.lit(BINS - 2))).otherwise(1)
    counts = _met(rows, spans).groupBy("g", "name", "k", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = F.sum("n").over(Window.partitionBy("g", "name").orderBy("bin"))
    found = counts.withColumn("upto", upto).where("k < upto AND k >= upto - n")
    return found.select("g", "name", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "n", "low", "high")
