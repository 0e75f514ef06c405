"""Running balances that never fall below a floor, for accounts of any length.

A row turns a balance b into max(b + amount, floor). Rows in a row compose to max(b + s, t), and the balance after a row is its running sum minus the least
running sum so far where that lies below 0. So each slice of an account needs its sum and its least prefix only: accounts are cut into slices, slices are
summed up in one small window an account, and rows in one window a slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floored(rows: DataFrame, account: str, order: list[str], amount: Column, piece: Column, floor: int = 0) -> DataFrame:
    """rows with ``balance`` after each: it starts at the floor, and what would take it lower takes it to the floor. order makes the rows of an account distinct
    and piece, which cuts accounts into slices, doesn't fall along it. A null amount is none. Amounts are whole numbers or decimals, so that sums are exact."""
    moved = rows.withColumns({"_x": F.coalesce(amount, F.lit(0)), "_piece": piece})
    within = Window.partitionBy(account, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = moved.withColumn("_sum", F.sum("_x").over(within)).withColumn("_least", F.min("_sum").over(within))
    pieces = summed.groupBy(account, "_piece").agg(F.sum("_x").alias("_total"), F.min("_sum").alias("_low"))
    earlier = Window.partitionBy("_account").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = pieces.withColumnRenamed(account, "_account").withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    ahead = ahead.withColumn("_lowest", F.coalesce(F.min(F.col("_before") + F.col("_low")).over(earlier), F.lit(0)))
    ahead = ahead.select("_account", F.col("_piece").alias("_slice"), "_before", "_lowest")
    joined = summed.join(ahead, F.col(account).eqNullSafe(F.col("_account")) & F.col("_piece").eqNullSafe(F.col("_slice")))
    lowest = F.least(F.lit(0), F.col("_lowest"), F.col("_before") + F.col("_least"))
    return joined.withColumn("balance", F.col("_before") + F.col("_sum") - lowest + F.lit(floor)).select(*rows.columns, "balance")


def guarded(rows: DataFrame, account: str, order: list[str], amount: Column) -> DataFrame:
    """rows with ``accepted`` and ``balance`` (longs) after each, from 0: a row that the balance doesn't cover is refused and changes nothing, a null amount is none.
    What is refused hangs on all rows before, so an account is one stream in order, read in batches with its balance carried along; between refusals a
    batch is summed at once. Accounts are sorted by Spark, on disk where they are long."""
    columns = [*rows.columns, "_x"]
    sorted_ = rows.withColumn("_x", F.coalesce(amount, F.lit(0)).cast("long")).repartition(account).sortWithinPartitions(account, *order)
    schema = rows.schema.add("accepted", "boolean").add("balance", "long")
    at = rows.columns.index(account)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names, x = batch.column(at).to_pylist(), batch.column(len(columns) - 1).to_numpy()
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            accepted, balance = np.ones(len(x), bool), np.zeros(len(x), np.int64)
            for a, b in zip(starts, [*starts[1:], len(x)], strict=True):
                if names[a] != last:
                    last, carried = names[a], 0
                while a < b:
                    sums = carried + np.cumsum(x[a:b])
                    short = np.flatnonzero((sums < 0) & (x[a:b] < 0))
                    upto = short[0] if len(short) else b - a
                    balance[a : a + upto] = sums[:upto]
                    carried = int(sums[upto - 1]) if upto else carried
                    a += upto
                    if len(short):
                        accepted[a], balance[a] = False, carried
                        a += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(accepted), pa.array(balance)], [*columns[:-1], "accepted", "balance"])

    return sorted_.mapInArrow(run, schema)
