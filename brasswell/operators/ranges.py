"""Which of many ranges hold a number: an equal-key join for ranges of any widths.

A range of a length up to 2**level lies in at most two buckets of that width, so it is stored under (level, bucket) once or twice however long it is. A number
asks for its bucket at each level that ranges have, and the borders verify. Buckets that very many numbers ask for are dealt over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a bucket in a part, by expectation.
PART = 100_000


def holding(numbers: DataFrame, value: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """All columns of both, for each number and each range with low <= number <= high (whole numbers, lengths below 2**62). Nulls hold nothing and lie nowhere, nor does
    anything in a range whose low is above its high; rows that repeat match each. The two tables share no column names."""
    usable = ranges.where(F.col(low) <= F.col(high))
    # The least level whose width is at least the length; lengths of 0 and 1 share level 0. Doubles may err by one level, which is corrected by the comparison.
    length = F.col(high) - F.col(low) + 1
    rough = F.ceil(F.log2(F.col(high).cast("double") - F.col(low).cast("double") + 1)).cast("int")
    level = F.when(F.expr("shiftleft(1L, _rough)") < length, F.col("_rough") + 1).otherwise(F.col("_rough"))
    levelled = usable.withColumn("_rough", rough).withColumn("_level", level).drop("_rough")
    stored = levelled.withColumn("_bucket", F.explode(F.sequence(_shifted(low), _shifted(high))))
    levels = sorted(r["_level"] for r in levelled.select("_level").distinct().collect())  # 64 at most
    if not levels:
        return numbers.join(ranges, F.lit(False))
    asked = numbers.where(F.col(value).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bucket", _shifted(value))
    keys = ["_level", "_bucket"]
    parts = asked.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts")).where("_parts > 1")
    asked = asked.join(parts, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*numbers.columns), F.coalesce("_parts", F.lit(1))).cast("int"))
    stored = stored.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    both = asked.drop("_parts").join(stored.drop("_parts"), [*keys, "_part"]).where(F.col(value).between(F.col(low), F.col(high)))
    return both.select(*numbers.columns, *ranges.columns)


def _shifted(column: str):
    """The bucket of a number at its row's level; rounds towards minus infinity."""
    return F.expr(f"shiftright(CAST(`{column}` AS BIGINT), _level)")
