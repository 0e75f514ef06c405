"""Browsing: optional filters, text search, orders, shelves and lookups, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasswell.functions.columns import half_up
from brasswell.functions.text import falsy, natural
from brasswell.operators.filters import members, searched, stock_is, where_all
from brasswell.operators.ranges import holding
from brasswell.operators.ranking import first_of
from brasswell.operators.shelves import filled
from brasswell.operators.substrings import containing, first_containing
from brasswell.plans.registry import query, table
from brasswell.sources.storage import stored as in_table

#: Products as shops show them; the same text is the SQL.
_P = """p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'p-' || CAST(p_partkey AS STRING) ELSE 'AT-P-' || CAST(p_partkey AS STRING) END AS code, p_name AS name,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS brand, p_type AS slug, p_size AS size, p_retailprice AS price, CAST(p_partkey % 23 - 4 AS INT) AS stock, p_size % 11 = 0 AS inquiry,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 50 AS DOUBLE) / 10 END AS rating, p_partkey % 9 = 0 AS active"""
PRODUCTS = f"(SELECT {_P} FROM part)"


def products(spark, sf_dir) -> DataFrame:
    columns = [x.strip() for x in _split(_P)]
    return table(spark, sf_dir, "part").selectExpr(*columns, "split(p_name, ' ') AS tags", "array(struct('type' AS key, lower(p_type) AS value)) AS specs")


def _split(columns: str) -> list[str]:
    """The columns of a select list (no commas stand inside them)."""
    return columns.split(",")


_FACETS = f"SELECT id, code FROM {PRODUCTS} WHERE slug IN ('STANDARD', 'SMALL') AND stock > 0 AND NOT inquiry AND (contains(lower(name), 'e') OR contains(lower(coalesce(brand, '')), 'e'))"


@query(_FACETS)
def flt01_faceted_filter(spark, sf_dir):
    """Category, brand, stock, kind and text: what isn't asked for isn't filtered."""
    found = where_all(products(spark, sf_dir), slug=["STANDARD", "SMALL"], brand=None, inquiry=False)
    return searched(stock_is(found, "available"), "E ", [F.col("name"), F.col("brand")]).select("id", "code")


@query(f"SELECT id, stock FROM {PRODUCTS} WHERE stock > 0 AND NOT inquiry")
def flt03_in_stock(spark, sf_dir):
    return stock_is(where_all(products(spark, sf_dir), inquiry=False), "available").select("id", "stock")


@query(f"SELECT id, name FROM {PRODUCTS} p JOIN part ON id = p_partkey WHERE contains(lower(name), 'an') OR contains(lower(coalesce(brand, '')), 'an') OR contains(lower(p_type), 'an') OR contains(code, '7an')")
def flt04_text_search(spark, sf_dir):
    """In names, brands, tags and the values of specs."""
    columns = [F.col("name"), F.col("brand"), members(F.col("tags")), members(F.col("specs.value"))]
    return searched(products(spark, sf_dir), "AN", columns).select("id", "name")


@query(f"SELECT id, code FROM {PRODUCTS} WHERE contains(replace(lower(code), '-', ''), 'tp12')")
def flt05_code_match(spark, sf_dir):
    return searched(products(spark, sf_dir), "T-P-12", [], [F.col("code")]).select("id", "code")


@query(f"SELECT 'blank' AS asked, 0::BIGINT AS n UNION ALL SELECT 'short', 0 UNION ALL SELECT 'enough', count(*) FROM {PRODUCTS} WHERE contains(lower(name), 'bl')")
def flt06_least_length(spark, sf_dir):
    """A blank query finds nothing, nor does one of a single character where two are the least."""
    told = lambda name, q: searched(products(spark, sf_dir), q, [F.col("name")], least=2).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n")
    return told("blank", "  ").union(told("short", "b")).union(told("enough", "bl"))


@query(f"SELECT id FROM {PRODUCTS} WHERE slug = 'PROMO' AND inquiry")
def flt07_category_page(spark, sf_dir):
    return where_all(products(spark, sf_dir), slug="PROMO", brand="all", inquiry=True).select("id")


@query(f"SELECT 'low' AS state, id FROM {PRODUCTS} WHERE stock BETWEEN 1 AND 5 AND slug = 'SMALL' UNION ALL SELECT 'none', id FROM {PRODUCTS} WHERE stock <= 0 AND slug = 'SMALL' UNION ALL SELECT 'all', id FROM {PRODUCTS} WHERE slug = 'SMALL'")
def flt08_admin_filter(spark, sf_dir):
    told = lambda s: stock_is(where_all(products(spark, sf_dir), slug="SMALL"), s).select(F.lit(s).alias("state"), "id")
    return told("low").union(told("none")).union(told("all"))


_TIER = "CASE WHEN c_acctbal >= 7500 THEN 'gold' WHEN c_acctbal >= 2500 THEN 'silver' ELSE 'bronze' END"


@query(f"SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_name END, 'no. ' || c_custkey::VARCHAR) AS name, {_TIER} AS tier FROM customer WHERE {_TIER} = 'gold' AND (contains(lower(coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_name END, 'no. ' || c_custkey::VARCHAR)), '8') OR contains(lower(c_mktsegment), 'auto'))")
def flt10_customers(spark, sf_dir):
    """By the name shown (the number where there is none), the segment and a tier that follows from the balance."""
    name = F.coalesce(F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")), F.concat(F.lit("no. "), F.col("c_custkey").cast("string")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.expr(_TIER).alias("tier"), "c_mktsegment")
    tier = where_all(rows, tier="gold")
    return searched(tier, "8", [F.col("name")]).union(searched(tier, "auto", [F.col("c_mktsegment")])).distinct().select("c_custkey", "name", "tier")


@query("SELECT 'all' AS asked, count(*) AS n FROM orders UNION ALL SELECT 'P', count(*) FROM orders WHERE o_orderstatus = 'P'")
def flt11_by_status(spark, sf_dir):
    told = lambda s: where_all(table(spark, sf_dir, "orders"), o_orderstatus=s).agg(F.count("*").alias("n")).select(F.lit(s).alias("asked"), "n")
    return told("all").union(told("P"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 2, 3, 4, 5, 6, 7) AND contains(lower(s_name), '5')")
def flt12_agencies(spark, sf_dir):
    return searched(where_all(table(spark, sf_dir, "supplier"), s_nationkey=[1, 2, 3, 4, 5, 6, 7]), "5", [F.col("s_name")]).select("s_suppkey", "s_name")


@query(f"SELECT slug, CASE WHEN stock > 10 THEN 'many' WHEN stock > 0 THEN 'few' ELSE 'none' END AS bucket, count(*) AS n FROM {PRODUCTS} WHERE contains(lower(name), 'a') GROUP BY ALL")
def flt14_stock_buckets(spark, sf_dir):
    bucket = F.when(F.col("stock") > 10, "many").when(F.col("stock") > 0, "few").otherwise("none")
    return searched(products(spark, sf_dir), "A", [F.col("name")]).groupBy("slug", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name FROM region WHERE contains(lower(r_name), 'n_1') OR r_regionkey IN (SELECT n_regionkey FROM nation WHERE contains(lower(n_name), 'n_1') AND n_nationkey > 10 AND n_nationkey < 14)")
def flt15_nested_search(spark, sf_dir):
    """Categories found by their own name or that of a part of theirs."""
    parts = table(spark, sf_dir, "nation").where("n_nationkey > 10 and n_nationkey < 14").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("parts"))
    both = table(spark, sf_dir, "region").join(parts, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return searched(both, "N_1", [F.col("r_name"), members(F.col("parts"))]).select("r_regionkey", "r_name")


@query("SELECT 'code' AS by, c_custkey::VARCHAR AS found FROM customer WHERE lower(c_name) = 'customer#000000042' UNION ALL SELECT 'tracking', o_orderkey::VARCHAR FROM orders WHERE upper('t-' || o_orderkey::VARCHAR) = 'T-77' UNION ALL SELECT 'phone', s_suppkey::VARCHAR FROM supplier WHERE s_name = 'Supplier#000000009' UNION ALL SELECT 'grade', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'list', r_name FROM region WHERE r_regionkey = 2")
def flt17_point_lookup(spark, sf_dir):
    """By code in any case, tracking code in capitals, phone without blanks around it, grade and price list."""
    one = lambda by, name, where, found: table(spark, sf_dir, name).where(where).select(F.lit(by).alias("by"), F.col(found).cast("string").alias("found"))
    rows = [one("code", "customer", "lower(c_name) = 'customer#000000042'", "c_custkey"), one("tracking", "orders", "upper('t-' || string(o_orderkey)) = upper('t-77')", "o_orderkey"), one("phone", "supplier", "s_name = trim(' Supplier#000000009 ')", "s_suppkey"), one("grade", "nation", "n_nationkey = 3", "n_name"), one("list", "region", "r_regionkey = 2", "r_name")]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'kind' WHEN length(props) < 9 THEN 'short' WHEN NOT (value >= 0 AND value < value + 10 AND value + 10 <= 100) THEN 'box' ELSE 'ok' END AS verdict FROM events")
def flt20_input_rules(spark, sf_dir):
    """The first rule that a request breaks: kind, length of its text, a box inside 0 to 100 whose ends are in order."""
    low, high = F.col("value"), F.col("value") + 10
    verdict = F.when(F.col("event_type").isin("click", "view"), "kind").when(F.length("props") < 9, "short").when(~((low >= 0) & (low < high) & (high <= 100)), "box").otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"))


@query(f"SELECT id, code FROM {PRODUCTS} WHERE active")
def flt22_active(spark, sf_dir):
    return where_all(products(spark, sf_dir), active=True).select("id", "code")


_NAT = "regexp_extract(code, '[0-9]+')::BIGINT"


@query(f"(SELECT 'code' AS mode, row_number() OVER (ORDER BY regexp_extract(lower(code), '^[^0-9]*'), {_NAT}) AS place, id FROM {PRODUCTS} ORDER BY 2 LIMIT 40) UNION ALL (SELECT 'rating', row_number() OVER (ORDER BY coalesce(rating, 0) DESC, id), id FROM {PRODUCTS} ORDER BY 2 LIMIT 40) UNION ALL (SELECT 'stock', row_number() OVER (ORDER BY stock DESC, id), id FROM {PRODUCTS} ORDER BY 2 LIMIT 40) UNION ALL (SELECT 'name', row_number() OVER (ORDER BY lower(name), id), id FROM {PRODUCTS} ORDER BY 2 LIMIT 40)")
def ord01_sort_modes(spark, sf_dir):
    """The first forty by code (numbers as numbers), rating, stock or name."""
    modes = {"code": [natural(F.col("code"))], "rating": [F.desc(F.coalesce("rating", F.lit(0.0))), F.asc("id")], "stock": [F.desc("stock"), F.asc("id")], "name": [F.lower("name"), F.asc("id")]}
    out = None
    for mode, order in modes.items():
        top = products(spark, sf_dir).orderBy(*order).limit(40)
        rows = top.select(F.lit(mode).alias("mode"), F.row_number().over(Window.orderBy(*order)).alias("place"), "id")  # of forty rows
        out = rows if out is None else out.union(rows)
    return out


@query(f"(SELECT 'asc' AS mode, id, price FROM {PRODUCTS} WHERE slug = 'PROMO' ORDER BY price, id LIMIT 30) UNION ALL (SELECT 'desc', id, price FROM {PRODUCTS} WHERE slug = 'PROMO' ORDER BY price DESC, id LIMIT 30) UNION ALL (SELECT 'code', id, price FROM {PRODUCTS} WHERE slug = 'PROMO' ORDER BY code LIMIT 30)")
def ord02_price_orders(spark, sf_dir):
    rows = where_all(products(spark, sf_dir), slug="PROMO")
    top = lambda mode, *order: rows.orderBy(*order).limit(30).select(F.lit(mode).alias("mode"), "id", "price")
    return top("asc", "price", "id").union(top("desc", F.desc("price"), "id")).union(top("code", "code"))


@query(f"(SELECT 'first' AS shelf, id FROM {PRODUCTS} ORDER BY id LIMIT 8) UNION ALL (SELECT 'best', id FROM {PRODUCTS} WHERE rating >= 4.5 ORDER BY rating DESC, id LIMIT 8) UNION ALL SELECT 'category', id FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY id) AS k FROM {PRODUCTS}) WHERE k <= 4")
def ord07_shelves(spark, sf_dir):
    """The first eight, the best eight, four of each category (a top-k in each task before the shuffle)."""
    rows = products(spark, sf_dir)
    first = rows.orderBy("id").limit(8).select(F.lit("first").alias("shelf"), "id")
    best = rows.where("rating >= 4.5").orderBy(F.desc("rating"), "id").limit(8).select(F.lit("best"), "id")
    k = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    return first.union(best).union(rows.withColumn("k", k).where("k <= 4").select(F.lit("category"), "id"))


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_regionkey, n_nationkey DESC)::INT AS place FROM nation")
def ord08_by_order_column(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.row_number().over(Window.orderBy("n_regionkey", F.desc("n_nationkey"))).alias("place"))


@query(f"(SELECT 'exact' AS kind, id, size FROM {PRODUCTS} WHERE size >= 44 AND active ORDER BY size DESC, id LIMIT 4) UNION ALL (SELECT 'similar', id, size FROM {PRODUCTS} WHERE size >= 44 AND NOT active ORDER BY size DESC, id LIMIT 4)")
def ord10_two_lists(spark, sf_dir):
    good = products(spark, sf_dir).where("size >= 44")
    top = lambda kind, rows: rows.orderBy(F.desc("size"), "id").limit(4).select(F.lit(kind).alias("kind"), "id", "size")
    return top("exact", good.where("active")).union(top("similar", good.where("not active")))


@query(f"SELECT id FROM {PRODUCTS} ORDER BY slug IN (SELECT slug FROM {PRODUCTS} WHERE id IN (3, 11)) DESC, id LIMIT 12")
def set03_recommended(spark, sf_dir):
    """Products of the categories looked at, then all others."""
    rows = products(spark, sf_dir)
    seen = F.broadcast(rows.where("id in (3, 11)").select("slug").distinct().withColumn("seen", F.lit(True)))  # two rows at most
    return filled(rows.join(seen, "slug", "left"), [F.col("seen")], ["id"], 12).select("id")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY last DESC, event_type) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS k FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL)) WHERE k <= 3 GROUP BY user_id")
def set05_most_recent(spark, sf_dir):
    """The last three different things of each user, the newest first."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last"))
    newest = F.slice(F.array_sort(F.collect_list(F.struct(F.negate("last").alias("minus"), "event_type"))), 1, 3)
    return last.groupBy("user_id").agg(F.array_join(F.transform(newest, lambda x: x["event_type"]), ",").alias("recent"))


@query("SELECT c_custkey, 'old' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1")
def set07_append_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    old = rows.where("c_custkey % 2 = 0")
    return old.withColumn("origin", F.lit("old")).union(rows.where("c_custkey % 3 = 0").join(old, "c_custkey", "left_anti").withColumn("origin", F.lit("new")))


@query(f"SELECT id, coalesce(v.verdict, 'unsure') AS verdict FROM {PRODUCTS} LEFT JOIN (SELECT lower('P-' || p_partkey::VARCHAR) AS key, CASE WHEN p_size > 25 THEN 'same' ELSE 'other' END AS verdict FROM part WHERE p_partkey % 2 = 0) v ON lower(code) = key")
def jn05_verdicts(spark, sf_dir):
    """Candidates with the verdict on their code in any case, unsure without one."""
    verdicts = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.lower(F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))).alias("key"), F.when(F.col("p_size") > 25, "same").otherwise("other").alias("verdict"))
    both = products(spark, sf_dir).join(verdicts, F.lower("code") == F.col("key"), "left")
    return both.select("id", F.coalesce("verdict", F.lit("unsure")).alias("verdict"))


@query("SELECT c_custkey, coalesce(n_name, 'none') AS grade, coalesce(r_name, 'DEFAULT') AS list FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END LEFT JOIN region ON r_regionkey = CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END")
def jn06_chained_lookup(spark, sf_dir):
    """Customer to grade to price list; the default list where the chain breaks."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).alias("n_nationkey"))
    grades = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).alias("r_regionkey"))
    both = rows.join(grades, "n_nationkey", "left").join(table(spark, sf_dir, "region"), "r_regionkey", "left")
    return both.select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("grade"), F.coalesce("r_name", F.lit("DEFAULT")).alias("list"))


@query("SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'BASE') AS grade FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def jn07_approval_or_default(spark, sf_dir):
    approved = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(approved, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("BASE")).alias("grade"))


@query("SELECT p_partkey, count(l_suppkey) AS images, coalesce(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey), '') AS list FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey % 4 > 0) ON p_partkey = l_partkey GROUP BY p_partkey")
def jn08_nested_images(spark, sf_dir):
    """Products with the list of their images that exist."""
    images = table(spark, sf_dir, "lineitem").where("l_suppkey % 4 > 0").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    lists = images.groupBy("p_partkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("list"))
    both = table(spark, sf_dir, "part").select("p_partkey").join(lists, "p_partkey", "left")
    text = F.array_join(F.transform("list", lambda k: k.cast("string")), ",")
    return both.select("p_partkey", F.coalesce(F.size("list"), F.lit(0)).cast("long").alias("images"), F.coalesce(text, F.lit("")).alias("list")).withColumn("images", F.greatest("images", F.lit(0)))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def jn10_anti_join(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, coalesce((SELECT max(n_nationkey) FROM nation WHERE p_size BETWEEN n_nationkey * 2 AND n_nationkey * 2 + 1 AND n_nationkey % 3 > 0), p_partkey % 3)::INT AS domain FROM part")
def jn11_range_join(spark, sf_dir):
    """The domain whose range holds a number, one of three in turn where none does. The ranges are a dimension of one row a nation."""
    ranges = F.broadcast(table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select("n_nationkey", (F.col("n_nationkey") * 2).alias("low"), (F.col("n_nationkey") * 2 + 1).alias("high")))
    both = table(spark, sf_dir, "part").join(ranges, F.col("p_size").between(F.col("low"), F.col("high")), "left")
    return both.select("p_partkey", F.coalesce("n_nationkey", F.col("p_partkey") % 3).cast("int").alias("domain"))


@query("WITH r AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS low, floor(o_totalprice)::BIGINT + o_orderkey % 40 + CASE WHEN o_orderkey % 500 = 0 THEN 3000 ELSE 0 END AS high FROM orders), p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 4)::BIGINT AS v FROM lineitem), m AS (SELECT v, max(o_orderkey) AS domain, count(*) AS domains FROM (SELECT DISTINCT v FROM p), r WHERE v BETWEEN low AND high GROUP BY v) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(domain, l_orderkey % 3) AS domain, coalesce(domains, 0) AS domains FROM p LEFT JOIN m USING (v)")
def jn11_many_ranges(spark, sf_dir):
    """The last of the orders' price ranges, narrow and wide, that holds a number, and how many do; one of three in turn where none does. Equal numbers ask once."""
    low = F.floor("o_totalprice").cast("long")
    wide = F.when(F.col("o_orderkey") % 500 == 0, 3000).otherwise(0)
    ranges = table(spark, sf_dir, "orders").select("o_orderkey", low.alias("low"), (low + F.col("o_orderkey") % 40 + wide).alias("high"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 4).cast("long").alias("v"))
    met = holding(lines.select("v").distinct(), "v", ranges, "low", "high").groupBy("v").agg(F.max("o_orderkey").alias("domain"), F.count("*").alias("domains"))
    both = lines.join(met, "v", "left").drop("v")
    return both.withColumns({"domain": F.coalesce("domain", F.col("l_orderkey") % 3), "domains": F.coalesce("domains", F.lit(0).cast("long"))})


_MESSAGE = "event_type || ' order ' || lpad(CAST(event_id * 7 % 100000 AS STRING), 5, '0') || ' by ' || CAST(user_id AS STRING) || ' ' || props"


@query(f"WITH m AS (SELECT event_id, user_id, {_MESSAGE} AS message FROM events) SELECT o_orderkey, event_id FROM orders, m WHERE user_id = o_custkey OR contains(message, lpad(o_orderkey::VARCHAR, 5, '0'))")
def jn12_either_key(spark, sf_dir):
    """Log entries of the order's customer, or whose message contains the order's code: an equal-key join, and a substring join without the pairs of the first, so that each
    pair comes once and no pairs are compared with each other."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lpad(F.col("o_orderkey").cast("string"), 5, "0").alias("code"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_MESSAGE).alias("message"))
    own = F.col("o_custkey") == F.col("user_id")
    by_user = orders.join(events.drop("message"), own).select("o_orderkey", "event_id")
    named = containing(events, "message", orders, "code").where(~F.coalesce(own, F.lit(False)))
    return by_user.union(named.select("o_orderkey", "event_id"))


@query("WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'AT-P-' || (p_partkey + 1)::VARCHAR WHEN 1 THEN 'at-p-' || (p_partkey + 1)::VARCHAR WHEN 2 THEN 'atp' || p_partkey::VARCHAR ELSE 'no' || p_partkey::VARCHAR END AS asked FROM part), p AS " + PRODUCTS + " SELECT p_partkey, coalesce((SELECT min(id) FROM p WHERE code = asked), (SELECT min(id) FROM p WHERE lower(code) = lower(asked)), (SELECT min(id) FROM p WHERE replace(lower(code), '-', '') = replace(lower(asked), '-', ''))) AS found FROM k")
def jn13_cascading_key(spark, sf_dir):
    """The product of a code as written, else in lower case, else without hyphens too."""
    key = F.col("p_partkey")
    asked = F.when(key % 4 == 0, F.concat(F.lit("AT-P-"), (key + 1).cast("string"))).when(key % 4 == 1, F.concat(F.lit("at-p-"), (key + 1).cast("string"))).when(key % 4 == 2, F.concat(F.lit("atp"), key.cast("string"))).otherwise(F.concat(F.lit("no"), key.cast("string")))
    rows, codes = table(spark, sf_dir, "part").select("p_partkey", asked.alias("asked")), products(spark, sf_dir).select("id", "code")
    spellings = (lambda c: c, F.lower, lambda c: F.replace(F.lower(c), F.lit("-"), F.lit("")))
    for k, spell in enumerate(spellings):
        known = codes.groupBy(spell(F.col("code")).alias(f"key{k}")).agg(F.min("id").alias(f"id{k}"))
        rows = rows.join(known, spell(F.col("asked")) == F.col(f"key{k}"), "left")
    return rows.select("p_partkey", F.coalesce("id0", "id1", "id2").alias("found"))


@query("WITH k AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') ELSE 'none' END AS name, lpad((s_suppkey * 7)::VARCHAR, 5, '0') AS tail FROM supplier) SELECT s_suppkey, coalesce(a.c_custkey, b.c_custkey) AS c_custkey FROM k LEFT JOIN customer a ON a.c_name = name LEFT JOIN (SELECT right(c_name, 5) AS t, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) b ON t = tail")
def jn14_fallback_by_tail(spark, sf_dir):
    """By name, else by the end of a name: the part of the text that is searched for is itself a key."""
    key = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(key, 9, "0"))).otherwise("none").alias("name"), F.lpad((F.col("s_suppkey") * 7).cast("string"), 5, "0").alias("tail"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    ends = people.groupBy(F.right("c_name", F.lit(5)).alias("tail")).agg(F.min("c_custkey").alias("second"))
    both = rows.join(people.toDF("first", "name"), "name", "left").join(ends, "tail", "left")
    return both.select("s_suppkey", F.coalesce("first", "second").alias("c_custkey"))


_ASKED = "CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS STRING), 9, '0') ELSE CAST(s_suppkey * 7 AS STRING) END"


@query(f"WITH k AS (SELECT s_suppkey, {_ASKED} AS asked FROM supplier) SELECT s_suppkey, coalesce((SELECT min(c_custkey) FROM customer WHERE c_name = asked), (SELECT min(c_custkey) FROM customer WHERE contains(c_name, asked))) AS c_custkey FROM k")
def jn14_fallback_by_substring(spark, sf_dir):
    """By the whole name; who isn't found so, by the first name that contains what is asked for."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_ASKED).alias("asked"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    exact = in_table(rows.join(people.groupBy(F.col("c_name").alias("asked")).agg(F.min("c_custkey").alias("first")), "asked", "left"))  # read several times
    second = first_containing(exact.where("first is null"), "s_suppkey", "asked", people, "c_name", "c_custkey")
    return exact.join(second, "s_suppkey", "left").select("s_suppkey", F.coalesce("first", "c_custkey").alias("c_custkey"))


_WORDS = "SELECT n_nationkey AS word_id, lower(substr(n_name, 1 + CAST(n_nationkey % 3 AS INT), 4)) AS word FROM nation UNION ALL SELECT 1000 + s_suppkey, lower(right(s_name, 2)) FROM supplier"


@query(f"WITH w AS ({_WORDS}) SELECT word_id, p_partkey AS id FROM w, part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), word) UNION ALL SELECT word_id, 1000000 + c_custkey FROM w, customer WHERE contains(lower(c_name || ' ' || c_mktsegment), word)")
def flt04_texts_of_words(spark, sf_dir):
    """Many searches at once: all products and customers whose text contains each of a table of words, in any case."""
    words = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS word_id", "lower(substr(n_name, 1 + CAST(n_nationkey % 3 AS INT), 4)) AS word").union(table(spark, sf_dir, "supplier").selectExpr("1000 + s_suppkey", "lower(right(s_name, 2))"))
    texts = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "lower(p_name || ' ' || p_brand || ' ' || p_type) AS told").union(table(spark, sf_dir, "customer").selectExpr("1000000 + c_custkey", "lower(c_name || ' ' || c_mktsegment)"))
    return containing(texts, "told", words, "word").select("word_id", "id")


@query("SELECT p_partkey, r_name, coalesce(n_name, '-') AS legacy FROM part JOIN region ON (p_partkey + 4) % 5 = r_regionkey LEFT JOIN nation ON n_nationkey = p_partkey")
def jn15_round_robin(spark, sf_dir):
    """Rows dealt over definitions in turn, with what an older table has for the same key."""
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("p_partkey"), "n_name")
    both = table(spark, sf_dir, "part").join(table(spark, sf_dir, "region"), F.pmod(F.col("p_partkey") - 1, F.lit(5)) == F.col("r_regionkey")).join(old, "p_partkey", "left")
    return both.select("p_partkey", "r_name", F.coalesce("n_name", F.lit("-")).alias("legacy"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(nullif(CASE l_returnflag WHEN 'A' THEN floor(p_retailprice * 1.18::DOUBLE + 0.5) WHEN 'R' THEN 0 END, 0), floor(p_retailprice * 1.35::DOUBLE + 0.5)) AS price FROM lineitem JOIN part ON l_partkey = p_partkey")
def jn17_price_layer(spark, sf_dir):
    """The price of the buyer's layer; retail where there is none or it is 0."""
    price = F.col("p_retailprice")
    layers = F.create_map(F.lit("A"), half_up(price * F.lit(1.18)), F.lit("R"), F.lit(0).cast("long"))
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", falsy(F.try_element_at(layers, F.col("l_returnflag")), half_up(price * F.lit(1.35))).cast("double").alias("price"))


@query(f"SELECT key, id, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY price, id) AS k FROM (SELECT lower(name) AS key, * FROM {PRODUCTS})) WHERE k = 1 AND key <> '' ORDER BY price, id LIMIT 8")
def win02_dedupe_by_key(spark, sf_dir):
    """One row for each name in any case, the cheapest, eight of them."""
    rows = products(spark, sf_dir).select(F.lower("name").alias("key"), "price", "id", "name").where("key <> ''")
    return first_of(rows, ["key"], ["price", "id"]).orderBy("price", "id").limit(8).select("key", "id", "name")
