"""Price lists, discount codes, tiers and points as column rules and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasswell.functions.columns import half_up

#: Percent off by tier; gold ships free (fixed values).
TIERS = {"bronze": 0, "silver": 2, "gold": 5}


def inquiry_price(rows: DataFrame, grades: DataFrame, lists: DataFrame, default: str) -> DataFrame:
    """rows (product, retail, grade, list) with the list that holds and the price: null without grade and list; the list given, else the grade's,
    else the default one; a price of the product's own there (not 0), else retail less the list's percent.

    grades: grade, grade_list; lists: list_name, percent, own (map from product to price). Both are dimensions."""
    by_grade = rows.join(grades, "grade", "left")
    wanted = F.coalesce("list", "grade_list")
    known = lists.select(F.col("list_name").alias("wanted"), F.struct("list_name", "percent", "own").alias("found"))
    fallback = F.broadcast(lists.where(F.col("list_name") == default).select(F.struct("list_name", "percent", "own").alias("fallback")))  # one row
    both = by_grade.withColumn("wanted", wanted).join(known, "wanted", "left").join(fallback)
    chosen = both.withColumn("chosen", F.coalesce("found", "fallback"))
    own = F.nullif(F.try_element_at("chosen.own", F.col("product")), F.lit(0))
    price = F.coalesce(own.cast("long"), half_up(F.col("retail") * (1 - F.col("chosen.percent") / 100)))
    asked = F.col("grade").isNotNull() | F.col("list").isNotNull()
    return chosen.select(*rows.columns, F.when(asked, F.col("chosen.list_name")).alias("used"), F.when(asked, price).alias("price"))


def discount_reason(known: Column, allowed: Column, first_only: Column, comeback_only: Column, orders: Column, inactive: Column, enough: Column) -> Column:
    """Why a discount code doesn't hold, or ok: unknown, not for this role, not the first order, not long away, below the minimum; the first counts."""
    return (
        F.when(~known, "unknown").when(~allowed, "role").when(first_only & (orders > 0), "not first")
        .when(comeback_only & ~inactive & (orders > 0), "not away").when(~enough, "minimum").otherwise("ok")
    )


def tier_discount(tier: Column, total: Column) -> Column:
    percent = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), tier), F.lit(0))
    return half_up(total * percent / 100)


def redeemed(points: Column, remaining: Column) -> Column:
    """Points that can be used: no more than what is left to pay, none below 0."""
    return F.greatest(F.lit(0.0), F.least(points, remaining))
