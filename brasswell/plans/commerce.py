"""Pricing, orders, credit and table changes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brasswell.functions.columns import half_up, money
from brasswell.operators.merging import patched
from brasswell.plans.registry import query, table

_SPEND = "(SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS spent, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY o_custkey)"


def spend(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).cast("double").alias("spent"), F.count("*").alias("n"), F.max("o_orderdate").alias("last"))


@query("SELECT l_orderkey, total, floor(total * 0.1 + 0.5) AS vat, total + floor(total * 0.1 + 0.5) AS grand FROM (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total FROM lineitem GROUP BY l_orderkey)")
def agg18_quote(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).cast("double").alias("total"))
    vat = half_up(F.col("total") * F.lit(0.1)).cast("double")
    return totals.select("l_orderkey", "total", vat.alias("vat"), (F.col("total") + vat).alias("grand"))


@query("SELECT p_partkey, floor(p_retailprice * 1.35::DOUBLE + 0.5) AS retail, floor(p_retailprice * 1.18::DOUBLE + 0.5) AS wholesale, floor(p_retailprice * 1.08::DOUBLE + 0.5) AS dealer FROM part")
def biz01_price_ladder(spark, sf_dir):
    rungs = (("retail", 1.35), ("wholesale", 1.18), ("dealer", 1.08))
    return table(spark, sf_dir, "part").select("p_partkey", *(half_up(F.col("p_retailprice") * F.lit(k)).cast("double").alias(n) for n, k in rungs))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'below minimum' WHEN o_orderstatus = 'P' THEN 'not allowed' ELSE 'ok' END AS reason, CASE WHEN o_totalprice >= 50000 AND o_orderstatus <> 'P' THEN least(floor(o_totalprice * 0.15::DOUBLE + 0.5), 20000) ELSE 0 END::DOUBLE AS discount FROM orders")
def biz04_capped_discount(spark, sf_dir):
    total, open_ = F.col("o_totalprice"), F.col("o_orderstatus") == "P"
    reason = F.when(total < 50000, "below minimum").when(open_, "not allowed").otherwise("ok")
    discount = F.when(reason == "ok", F.least(half_up(total * F.lit(0.15)), F.lit(20000))).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"), discount.cast("double").alias("discount"))


@query(f"SELECT o_custkey, spent, CASE WHEN spent >= 3000000 THEN 'gold' WHEN spent >= 1500000 THEN 'silver' ELSE 'bronze' END AS tier, CASE WHEN spent >= 3000000 THEN 0 WHEN spent >= 1500000 THEN 3000000 - spent ELSE 1500000 - spent END AS missing FROM {_SPEND}")
def biz07_tier(spark, sf_dir):
    spent = F.col("spent")
    tier = F.when(spent >= 3000000, "gold").when(spent >= 1500000, "silver").otherwise("bronze")
    missing = F.when(spent >= 3000000, F.lit(0.0)).when(spent >= 1500000, 3000000 - spent).otherwise(1500000 - spent)
    return spend(spark, sf_dir).select("o_custkey", "spent", tier.alias("tier"), missing.alias("missing"))


@query("SELECT o_orderkey, greatest(1, floor(floor(o_totalprice / 1000) * (CASE o_orderstatus WHEN 'F' THEN 1.5 WHEN 'O' THEN 1.2 ELSE 1.0 END)::DOUBLE + 0.5))::BIGINT AS points FROM orders")
def biz08_points(spark, sf_dir):
    factor = F.when(F.col("o_orderstatus") == "F", 1.5).when(F.col("o_orderstatus") == "O", 1.2).otherwise(1.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.greatest(F.lit(1), half_up(F.floor(F.col("o_totalprice") / 1000) * factor)).cast("long").alias("points"))


@query(f"SELECT o_custkey, n, date_diff('day', last::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) > 60 AS comeback FROM {_SPEND}")
def biz09_comeback(spark, sf_dir):
    newest = F.broadcast(table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("as_of")))  # one row
    return spend(spark, sf_dir).join(newest).select("o_custkey", "n", (F.datediff("as_of", "last") > 60).alias("comeback"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity >= 20 THEN floor(l_extendedprice * 0.95::DOUBLE + 0.5) ELSE floor(l_extendedprice + 0.5) END AS line_total FROM lineitem")
def biz10_bulk_break(spark, sf_dir):
    price = F.col("l_extendedprice")
    total = F.when(F.col("l_quantity") >= 20, half_up(price * F.lit(0.95))).otherwise(half_up(price)).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", total.alias("line_total"))


@query("SELECT o_orderkey, taxable, floor(taxable * 0.09::DOUBLE + 0.5) AS vat, taxable + floor(taxable * 0.09::DOUBLE + 0.5) AS total FROM (SELECT o_orderkey, greatest(0, o_totalprice - 5000)::DOUBLE AS taxable FROM orders)")
def biz11_invoice(spark, sf_dir):
    taxable = F.greatest(F.lit(0.0), F.col("o_totalprice") - 5000)
    vat = half_up(taxable * F.lit(0.09)).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", taxable.alias("taxable"), vat.alias("vat"), (taxable + vat).alias("total"))


@query(f"SELECT c_custkey, 5000000 - coalesce(spent, 0) AS available, floor(100 * coalesce(spent, 0) / 5000000 + 0.5) AS used_percent FROM customer LEFT JOIN {_SPEND} ON c_custkey = o_custkey")
def biz13_credit(spark, sf_dir):
    debt = F.coalesce("spent", F.lit(0.0))
    found = table(spark, sf_dir, "customer").join(spend(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left")
    return found.select("c_custkey", (5000000 - debt).alias("available"), half_up(100 * debt / 5000000).cast("double").alias("used_percent"))


@query("SELECT o_custkey, o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS balance FROM orders")
def win09_running_balance(spark, sf_dir):
    """A customer's orders are summed month by month, and the months before are added, so that no task holds a whole history."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", money("o_totalprice").alias("amount"), F.trunc("o_orderdate", "month").alias("month"))
    months = orders.groupBy("o_custkey", "month").agg(F.sum("amount").alias("total"))
    earlier = Window.partitionBy("o_custkey").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    before = months.select("o_custkey", "month", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("o_custkey", "month").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    rows = orders.withColumn("upto", F.sum("amount").over(own)).join(before, ["o_custkey", "month"])
    return rows.select("o_custkey", "o_orderkey", (F.col("before") + F.col("upto")).cast("double").alias("balance"))


@query("SELECT o_orderkey, coalesce(a.c_name, b.c_name, '-') AS name FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey AND o_orderstatus <> 'P' LEFT JOIN customer b ON o_orderkey = b.c_custkey")
def jn04_two_key_lookup(spark, sf_dir):
    """By the first key, else by the second: two equal-key joins in place of an OR."""
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    first = names.select(F.col("c_custkey").alias("first_key"), F.col("c_name").alias("first_name"))
    second = names.select(F.col("c_custkey").alias("second_key"), F.col("c_name").alias("second_name"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("by_customer"))
    found = orders.join(first, F.col("by_customer") == F.col("first_key"), "left").join(second, F.col("o_orderkey") == F.col("second_key"), "left")
    return found.select("o_orderkey", F.coalesce("first_name", "second_name", F.lit("-")).alias("name"))


@query("SELECT p_partkey, coalesce(m, p_size::DOUBLE) AS stock FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON p_partkey = l_partkey")
def jn16_override(spark, sf_dir):
    given = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.max("l_quantity").alias("m"))
    return table(spark, sf_dir, "part").join(given, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("m", F.col("p_size").cast("double")).alias("stock"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml05_patch(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return patched(old, old.where("c_acctbal < 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")), "c_custkey", ["c_acctbal"])


@query("SELECT p_partkey, greatest(0, 1000 - coalesce(sold, 0))::DOUBLE AS stock FROM part LEFT JOIN (SELECT l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sold FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey")
def dml19_stock_after_orders(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(money("l_quantity")).cast("double").alias("sold"))
    found = table(spark, sf_dir, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    return found.select("p_partkey", F.greatest(F.lit(0.0), 1000 - F.coalesce("sold", F.lit(0.0))).alias("stock"))


@query("SELECT s_suppkey, least(5000, greatest(0, s_acctbal))::DOUBLE AS clamped FROM supplier")
def dml20_clamp(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.least(F.lit(5000.0), F.greatest(F.lit(0.0), "s_acctbal")).alias("clamped"))
