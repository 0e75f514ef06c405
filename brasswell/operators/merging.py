"""Keyed changes to tables as joins: upsert, removal, patch, states with history, orders, imports, index upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasswell.functions.columns import half_up


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; the others are added. ``new`` has each key once."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def placed(old: DataFrame, new: DataFrame, key: str, order: str = "ord", first: bool = True) -> DataFrame:
    """upserted() that keeps places: a replaced row stays at its place, new rows stand before all others (or behind), in their own order."""
    ends = F.broadcast(old.agg(F.coalesce(F.min(order), F.lit(0)).alias("_low"), F.coalesce(F.max(order), F.lit(0)).alias("_high")))  # one row
    before = new.withColumnRenamed(order, "_mine").join(old.select(key, order), key, "left").join(ends)
    rank = F.row_number().over(Window.partitionBy(F.col(order).isNotNull()).orderBy("_mine"))  # of what is added in one change
    added = F.col("_low") - F.count("*").over(Window.partitionBy(F.col(order).isNotNull())) + rank - 1 if first else F.col("_high") + rank
    return old.join(new.select(key), key, "left_anti").unionByName(before.withColumn(order, F.coalesce(order, added)).select(*old.columns))


def removed(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def patched(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Named columns take the new value where there is one (not null), and stay otherwise."""
    given = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    found = old.join(given, key, "left")
    return found.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


def absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key ``old`` hasn't: what an insert adds where existing rows win."""
    return new.join(old.select(key), key, "left_anti")


def moved(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows (key, status, history) with the changes (key, to, at, note): status set, and the change behind the history; one change a key."""
    both = rows.join(changes, key, "left")
    entry = F.struct(F.col("to").alias("status"), "at", "note")
    return both.select(key, F.coalesce("to", "status").alias("status"), F.when(F.col("to").isNotNull(), F.array_append("history", entry)).otherwise(F.col("history")).alias("history"))


def reordered(rows: DataFrame, listed: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """rows with places 1..n for the keys listed (key, place), the rest behind them in their order. For lists that people sort: one task ranks them."""
    both = rows.join(listed, key, "left")
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("place"), order))
    return both.withColumn(order, rank).drop("place")


def merged_quantities(old: DataFrame, new: DataFrame, keys: list[str], quantity: str) -> DataFrame:
    """Both carts as one: quantities of one key add up, and rows of none left go."""
    return old.select(*keys, quantity).unionByName(new.select(*keys, quantity)).groupBy(*keys).agg(F.sum(quantity).alias(quantity)).where(F.col(quantity) > 0)


def classified(rows: DataFrame, old: DataFrame) -> DataFrame:
    """Import rows (code, name, price) with status: error without code, name or price, update where the code (any case) or else the name is known."""
    codes = old.select(F.upper("code").alias("_code")).distinct().withColumn("_by_code", F.lit(True))
    names = old.select(F.col("name").alias("_name")).distinct().withColumn("_by_name", F.lit(True))
    both = rows.join(codes, F.upper("code") == F.col("_code"), "left").join(names, F.col("name") == F.col("_name"), "left")
    status = F.when((F.col("code") == "") | (F.col("name") == ""), "error").when(F.col("price") <= 0, "error").when(F.col("_by_code") | F.col("_by_name"), "update").otherwise("new")
    message = F.when((F.col("code") == "") | (F.col("name") == ""), "no code or name").when(F.col("price") <= 0, "no price")
    return both.select(*rows.columns, status.alias("status"), message.alias("message"))


#: What the price layers are to the base price (fixed values).
LADDER = {"retail": 1.35, "wholesale": 1.18, "dealer": 1.08}


def imported(old: DataFrame, rows: DataFrame) -> DataFrame:
    """old (code, name, brand, price, retail, stock) after the rows that aren't errors: of one code the last row counts; known codes (in any
    case) are updated, keeping name and brand where the row has none; others are added."""
    good = rows.where("status <> 'error'").withColumn("_code", F.upper("code"))
    last = good.groupBy("_code").agg(F.max_by(F.struct("code", "name", "brand", "price", "stock"), "row_number").alias("n"))
    both = old.withColumn("_code", F.upper("code")).join(last, "_code", "full")
    given = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(c))
    retail = half_up(F.col("n.price") * F.lit(LADDER["retail"])).cast("long")
    return both.select(F.coalesce("code", "n.code").alias("code"), given("name").alias("name"), given("brand").alias("brand"), F.coalesce("n.price", "price").alias("price"), F.coalesce(retail, F.col("retail")).alias("retail"), F.coalesce("n.stock", "stock").alias("stock"))


def stale(images: DataFrame, index: DataFrame) -> DataFrame:
    """Images (image, hash) to be indexed anew: not in the index (image, hash, signed), with another hash, or without signatures."""
    known = index.select("image", F.col("hash").alias("_hash"), "signed")
    both = images.join(known, "image", "left")
    return both.where(~(F.col("hash").eqNullSafe(F.col("_hash")) & F.coalesce("signed", F.lit(False)))).select(*images.columns)


def changed_when(value: Column, condition: Column, new: Column) -> Column:
    return F.when(condition, new).otherwise(value)
