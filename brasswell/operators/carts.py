"""Carts, saved products and wish lists from the log of what people did, without playing it row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carts(log: DataFrame) -> DataFrame:
    """cart, product, quantity (long, 0 for none), saved of a log cart, product, at, kind, quantity, whose ``at`` orders each product of a cart; a row for each product that is in the cart or saved.

    add: quantity more (at least 1, else nothing happens). set: this quantity if the product is there, below 1 takes it out. remove: out. save: out, and saved if it was there.
    back: no longer saved, and one more. forget: no longer saved. Other kinds and null quantities do nothing.

    Whether a product is there depends only on the last thing that put it in or took it out, so each set and save is judged by one window; the quantity is that of
    the last judged set or removal plus all adds since."""
    clears = F.col("kind").isin("remove", "save") | ((F.col("kind") == "set") & (F.col("quantity") < 1))
    adds = F.when(F.col("kind") == "back", 1).when((F.col("kind") == "add") & (F.col("quantity") >= 1), F.col("quantity"))
    order = Window.partitionBy("cart", "product").orderBy("at")
    known = log.select("cart", "product", "at", "kind", F.col("quantity").cast("long").alias("quantity"))
    rows = known.withColumns({"_in": F.when(clears, False).when(adds.isNotNull(), True), "_add": adds.cast("long")})
    there = F.coalesce(F.last("_in", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_there", there)
    base = F.when(F.col("_in") == F.lit(False), 0).when((F.col("kind") == "set") & F.col("_there"), F.col("quantity"))
    saved = F.when((F.col("kind") == "save") & F.col("_there"), True).when(F.col("kind").isin("back", "forget"), False)
    rows = rows.withColumns({"_base": base, "_saved": saved})
    based = F.col("_base").isNotNull()
    last = F.max(F.when(based, F.col("at"))).over(Window.partitionBy("cart", "product"))
    since = F.when(F.col("_last").isNull() | (F.col("at") > F.col("_last")), F.col("_add"))
    found = rows.withColumn("_last", last).groupBy("cart", "product").agg(
        F.coalesce(F.max_by("_base", F.when(based, F.col("at"))), F.lit(0)).alias("_from"),
        F.coalesce(F.sum(since), F.lit(0)).alias("_more"),
        F.coalesce(F.max_by("_saved", F.when(F.col("_saved").isNotNull(), F.col("at"))), F.lit(False)).alias("saved"),
    )
    out = found.select("cart", "product", (F.col("_from") + F.col("_more")).cast("long").alias("quantity"), "saved")
    return out.where("quantity > 0 OR saved")


def wished(log: DataFrame) -> DataFrame:
    """person, product, at of products toggled an odd number of times (person, product, at), with the time of the last toggle, by which the list is ordered."""
    return log.groupBy("person", "product").agg(F.count("*").alias("_n"), F.max("at").alias("at")).where("_n % 2 = 1").drop("_n")
