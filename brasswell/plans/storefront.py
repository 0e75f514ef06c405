"""Storefront reads: filters, lookups, facets, ordering, shelves, text and log functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brasswell.functions.columns import half_up, hyphenless
from brasswell.operators.ranking import first_of
from brasswell.operators.shelves import filled, page
from brasswell.plans.registry import query, table


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_type = (SELECT max(p_type) FROM part) OR contains(p_brand, '2') OR contains(p_brand, '3')")
def flt02_virtual_category(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    last = F.broadcast(part.agg(F.max("p_type").alias("m")))  # one row
    return part.join(last).where("p_type = m or contains(p_brand, '2') or contains(p_brand, '3')").select("p_partkey", "p_brand", "p_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND starts_with(o_orderpriority, '1') AND (contains(o_orderkey::VARCHAR, '7') OR contains(o_custkey::VARCHAR, '7'))")
def flt09_order_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and startswith(o_orderpriority, '1') and (contains(string(o_orderkey), '7') or contains(string(o_custkey), '7'))").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, CASE WHEN p_retailprice > 0 THEN floor(100 * (p_size - p_retailprice) / p_retailprice + 0.5) ELSE 0 END AS change FROM part")
def flt13_percent_change(spark, sf_dir):
    old, new = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(old > 0, half_up(100 * (new - old) / old)).otherwise(0).cast("double").alias("change"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_brand, 'AT-') THEN p_brand ELSE 'AT-' || p_brand END AS sku, concat_ws(' | ', 'type: ' || p_type, 'size: ' || p_size::VARCHAR) AS specs, p_retailprice <= 0 AS inquiry_only FROM part")
def flt19_derived_columns(spark, sf_dir):
    sku = F.when(F.startswith("p_brand", F.lit("AT-")), F.col("p_brand")).otherwise(F.concat(F.lit("AT-"), "p_brand"))
    specs = F.concat_ws(" | ", F.concat(F.lit("type: "), "p_type"), F.concat(F.lit("size: "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", sku.alias("sku"), specs.alias("specs"), (F.col("p_retailprice") <= 0).alias("inquiry_only"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY TRY_CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) DESC, c_custkey LIMIT 50")
def ord04_embedded_number(spark, sf_dir):
    number = F.expr(r"try_cast(regexp_extract(c_name, '[0-9]+', 0) as bigint)")
    return table(spark, sf_dir, "customer").orderBy(number.desc(), "c_custkey").select("c_custkey", "c_name").limit(50)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 24 OFFSET 24")
def ord05_second_page(spark, sf_dir):
    return page(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], 2)


@query("SELECT count(*) AS total, greatest(1, ceil(count(*) / 24))::BIGINT AS pages FROM part WHERE p_size > 10")
def ord06_page_count(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size > 10").agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / 24)).cast("long").alias("pages"))


@query("SELECT p_partkey, p_size FROM part ORDER BY (p_size > 45) DESC, p_partkey LIMIT 300")
def set01_ordered_fill(spark, sf_dir):
    return filled(table(spark, sf_dir, "part").select("p_partkey", "p_size"), [F.col("p_size") > 45], ["p_partkey"], 300)


@query("SELECT p.p_partkey, p.p_brand FROM part p, (SELECT * FROM part WHERE p_partkey = 1) o WHERE p.p_type = o.p_type AND p.p_partkey <> 1 ORDER BY (p.p_brand = o.p_brand) DESC, p.p_partkey LIMIT 8")
def set02_similar_items(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    one = F.broadcast(part.where("p_partkey = 1").select("p_type", F.col("p_brand").alias("own")))  # one row by its key
    return filled(part.join(one, "p_type").where("p_partkey <> 1"), [F.col("p_brand") == F.col("own")], ["p_partkey"], 8).select("p_partkey", "p_brand")


@query("(SELECT 'product' AS kind, p_name AS name, p_partkey AS id FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 6) UNION ALL (SELECT 'supplier', s_name, s_suppkey FROM supplier WHERE contains(lower(s_name), 'a') OR s_suppkey > 2 ORDER BY s_suppkey LIMIT 4) UNION ALL (SELECT 'nation', n_name, n_nationkey::BIGINT FROM nation WHERE contains(lower(n_name), 'a') ORDER BY n_nationkey LIMIT 3)")
def set06_instant_search(spark, sf_dir):
    def top(name, kind, text, key, where, most):
        return table(spark, sf_dir, name).where(where).orderBy(key).limit(most).select(F.lit(kind).alias("kind"), F.col(text).alias("name"), F.col(key).cast("long").alias("id"))

    products = top("part", "product", "p_name", "p_partkey", "contains(lower(p_name), 'a')", 6)
    suppliers = top("supplier", "supplier", "s_name", "s_suppkey", "contains(lower(s_name), 'a') or s_suppkey > 2", 4)
    return products.unionByName(suppliers).unionByName(top("nation", "nation", "n_name", "n_nationkey", "contains(lower(n_name), 'a')", 3))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey")
def agg08_distinct_claimants(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def agg15_breakdown(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return counts.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("SELECT p_name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice, p_partkey) AS k FROM part) WHERE k = 1 ORDER BY p_retailprice, p_partkey LIMIT 20")
def win01_dedupe_top(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_retailprice", "p_partkey")
    return first_of(part, ["p_name"], ["p_retailprice", "p_partkey"]).orderBy("p_retailprice", "p_partkey").limit(20)


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def dt01_daily_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, translate(p_partkey::VARCHAR, '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS shown, coalesce(TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT), 0) AS digits FROM part")
def str03_digits(spark, sf_dir):
    digits = F.expr("coalesce(try_cast(regexp_replace(p_brand, '[^0-9]', '') as bigint), 0)")
    return table(spark, sf_dir, "part").select("p_partkey", F.translate(F.col("p_partkey").cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹").alias("shown"), digits.alias("digits"))
