"""Catalogue, log, pricing and similarity queries over the star-schema tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasswell.operators.ranking import first_of, ranked
from brasswell.plans.registry import query, table

@query("SELECT p_brand, count(*) AS n, count_if(p_size > 25) AS large, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand")
def agg02_group_count(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("SELECT event_type, count(*) AS n, count_if(ts >= m - INTERVAL 24 HOUR) AS last_day FROM events, (SELECT max(ts) AS m FROM events) GROUP BY event_type")
def agg01_log_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest_ts = F.broadcast(events.agg(F.max("ts").alias("m")))  # one row
    return events.join(newest_ts).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.col("m") - F.expr("interval 24 hours")).alias("last_day"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn09_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def win07_latest_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) WHERE k = 1")
def win04_first_per_group(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_partkey")
    return first_of(part, ["p_brand"], ["p_retailprice", "p_partkey"]).select("p_brand", "p_partkey", "p_retailprice")
