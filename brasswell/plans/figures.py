"""Counts, windows, rules, and text, number, list and map functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brasswell.functions import text
from brasswell.functions.columns import half_up, money
from brasswell.operators import pricing
from brasswell.operators.ledger import floored, guarded
from brasswell.operators.orderstats import places
from brasswell.operators.ranking import numbered
from brasswell.plans.registry import query, table


@query("SELECT l_orderkey, count(*) AS items, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS quantity, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total, greatest(0, sum(CAST(l_quantity * 30 AS DECIMAL(18,2))) - sum(CAST(l_extendedprice AS DECIMAL(18,2))))::DOUBLE AS savings FROM lineitem GROUP BY l_orderkey")
def agg03_cart_totals(spark, sf_dir):
    """Savings against the list price, never below 0."""
    lines = table(spark, sf_dir, "lineitem").withColumn("listed", F.col("l_quantity") * 30)
    saved = F.greatest(F.lit(0), F.sum(money("listed")) - F.sum(money("l_extendedprice")))
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("items"), F.sum(money("l_quantity")).cast("double").alias("quantity"), F.sum(money("l_extendedprice")).cast("double").alias("total"), saved.cast("double").alias("savings"))


@query("SELECT p_type, string_agg(p_brand, ',' ORDER BY first) AS first_ten, max(n) AS n FROM (SELECT p_type, p_brand, min(p_partkey) AS first, row_number() OVER (PARTITION BY p_type ORDER BY min(p_partkey)) AS k, count(*) OVER (PARTITION BY p_type) AS n FROM part GROUP BY p_type, p_brand) WHERE k <= 10 GROUP BY p_type")
def agg09_facet_values(spark, sf_dir):
    """The first ten brands of each category in the order in which they first occur, and how many there are."""
    first = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("first"))
    brands = F.array_sort(F.collect_list(F.struct("first", "p_brand")))
    return first.groupBy("p_type").agg(F.array_join(F.transform(F.slice(brands, 1, 10), lambda b: b["p_brand"]), ",").alias("first_ten"), F.count("*").alias("n"))


@query("SELECT p_brand, sum(p_size % 4)::BIGINT AS images, coalesce(sum(CASE WHEN p_partkey % 5 > 0 THEN p_size % 4 END), 0)::BIGINT AS indexed, count_if(p_partkey % 5 = 0 AND p_size % 4 > 0)::BIGINT AS missing FROM part GROUP BY p_brand")
def agg10_index_coverage(spark, sf_dir):
    images, done = F.col("p_size") % 4, F.col("p_partkey") % 5 > 0
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(images).cast("long").alias("images"), F.coalesce(F.sum(F.when(done, images)), F.lit(0)).cast("long").alias("indexed"), F.count_if(~done & (images > 0)).alias("missing"))


@query("SELECT count(*) AS orders, count_if(o_orderstatus = 'O') AS open, count_if(o_orderstatus = 'P') AS part, count_if(o_totalprice > 300000) AS large, count_if(starts_with(o_orderpriority, '1')) AS urgent FROM orders")
def agg12_dashboard(spark, sf_dir):
    """All tiles in one pass."""
    n = lambda c, name: F.count_if(c).alias(name)
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), n(F.col("o_orderstatus") == "O", "open"), n(F.col("o_orderstatus") == "P", "part"), n(F.col("o_totalprice") > 300000, "large"), n(F.startswith("o_orderpriority", F.lit("1")), "urgent"))


@query("SELECT p_brand, string_agg(p_partkey::VARCHAR || ':' || p_size::VARCHAR, ',' ORDER BY p_partkey) AS items FROM part WHERE p_size > 48 GROUP BY p_brand")
def agg19_group_to_list(spark, sf_dir):
    items = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda x: F.concat_ws(":", x["p_partkey"].cast("string"), x["p_size"].cast("string")))
    return table(spark, sf_dir, "part").where("p_size > 48").groupBy("p_brand").agg(F.array_join(items, ",").alias("items"))


@query("SELECT label, least(15, greatest(0, floor((x + 0.5) * 16)))::BIGINT AS bin, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def agg21_histogram(spark, sf_dir):
    """Sixteen bins of component values for each label; values beyond the ends count with the end bins."""
    bins = F.transform("embedding", lambda x: F.least(F.lit(15), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.5) * 16))))
    return table(spark, sf_dir, "embeddings").select("label", F.explode(bins).alias("bin")).groupBy("label", "bin").agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(s[3], 6) AS low, round(s[63], 6) AS high, round(s[33], 6) AS upper_median FROM (SELECT vec_id, list_sort(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings)")
def agg22_order_statistics(spark, sf_dir):
    """Values at fixed places of the sorted list, not interpolated."""
    s = F.array_sort(F.col("embedding").cast("array<double>"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", s.alias("s"))
    return rows.select("vec_id", *(F.round(F.element_at("s", k), 6).alias(n) for k, n in ((3, "low"), (63, "high"), (33, "upper_median"))))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS line FROM orders")
def win05_line_numbers(spark, sf_dir):
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(own).alias("line"))


@query("SELECT p_partkey, k AS place FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k, count(*) OVER () AS n FROM part) WHERE (k - 1) % greatest(1, n // 30) = 0 ORDER BY k LIMIT 30")
def win06_strided_sample(spark, sf_dir):
    """Thirty rows at equal steps of the whole table."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    step = max(1, part.count() // 30)
    return numbered(part, "p_partkey", "place").where((F.col("place") - 1) % step == 0).orderBy("place").limit(30)


@query("SELECT event_id, sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW)::DOUBLE AS used FROM events")
def win08_sliding_sum(spark, sf_dir):
    """What a user used in the hour up to each event; a user's events are dealt into days, with the hour before each day added to it."""
    width, day = 3_600_000_000, 86_400_000_000
    events = table(spark, sf_dir, "events").select("event_id", "user_id", money("value").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    own = F.floor(F.col("at") / day)
    dealt = events.withColumn("day", own).withColumn("own", F.lit(True)).union(events.where(F.floor((F.col("at") + width) / day) > own).withColumn("day", own + 1).withColumn("own", F.lit(False)))
    window = Window.partitionBy("user_id", "day").orderBy("at").rangeBetween(-width, 0)
    return dealt.withColumn("used", F.sum("value").over(window).cast("double")).where("own").select("event_id", "used")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'e(' || lpad(p_partkey::VARCHAR, greatest(3, length(p_partkey::VARCHAR))::INT, '0') || ')' ELSE 'x' || p_partkey::VARCHAR END AS name FROM part")
def str02_padded(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("e("), k, F.lit(")"))).otherwise(F.concat(F.lit("x"), k))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(text.padded_names(name), -1).alias("name"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN translate(format('{:,}', round_even(c_acctbal, 0)::BIGINT), '0123456789', '۰۱۲۳۴۵۶۷۸۹') ELSE 'ask for the price' END AS shown FROM customer")
def str04_price_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.price_text(F.col("c_acctbal")).alias("shown"))


@query("SELECT c_custkey, coalesce(TRY_CAST(regexp_replace(c_acctbal::DECIMAL(12,2)::VARCHAR, '[^0-9]', '', 'g') AS BIGINT), 0) AS n, coalesce(TRY_CAST(regexp_replace(c_mktsegment, '[^0-9]', '', 'g') AS BIGINT), 0) AS none FROM customer")
def str05_digits(spark, sf_dir):
    """Sign and point are dropped; no digits make a 0."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.digits(F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("n"), text.digits(F.col("c_mktsegment")).alias("none"))


@query("SELECT page_id, regexp_extract(k, '^(.*)::[^:]*$', 1) AS head, regexp_extract(k, '::([^:]*)$', 1) AS tail FROM (SELECT page_id, url || '::v::' || (page_id % 4)::VARCHAR AS k FROM pages)")
def str06_last_split(spark, sf_dir):
    """A key in two at its last double colon."""
    k = F.concat("url", F.lit("::v::"), (F.col("page_id") % 4).cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", k.alias("k")).withColumn("tail", F.substring_index("k", "::", -1))
    return rows.select("page_id", F.substr("k", F.lit(1), F.length("k") - F.length("tail") - 2).alias("head"), "tail")


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN props ELSE '' END AS object FROM events")
def str07_first_object(spark, sf_dir):
    """The object in a reply with code fences and words around it; none in a reply without braces."""
    reply = F.when(F.col("event_id") % 3 == 0, "nothing to say").when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("so "), "props"))
    return table(spark, sf_dir, "events").select("event_id", text.first_object(reply).alias("object"))


@query("SELECT p_partkey, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(p_name || p_partkey::VARCHAR, ''), lambda c: ascii(c)::HUGEINT)), lambda s, c: (s * 31 + c) % 4294967296)::BIGINT AS hash FROM part")
def str08_string_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.string_hash(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("hash"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'CLUB-' || right(c_name, 5) ELSE 'CLUB-' || right('0000' || c_custkey::VARCHAR, 4) END AS referral FROM customer")
def str09_referral_code(spark, sf_dir):
    """From the end of a number where there is one, else from that of the id."""
    name, key = F.right("c_name", F.lit(5)), F.right(F.concat(F.lit("0000"), F.col("c_custkey").cast("string")), F.lit(4))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("CLUB-"), F.when(F.col("c_custkey") % 2 == 0, name).otherwise(key)).alias("referral"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base, replace(replace(replace('a b/é=' || page_id::VARCHAR, ' ', '+'), '/', '%2F'), 'é=', '%C3%A9%3D') AS encoded FROM pages")
def str10_paths(spark, sf_dir):
    encoded = F.url_encode(F.concat(F.lit("a b/é="), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"), encoded.alias("encoded"))


@query("SELECT c_custkey, regexp_full_match('09' || right(c_name, 9), '09[0-9]{9}') AS phone, regexp_full_match(right(c_name, 9 + (c_custkey % 2)::INT), '[0-9]{9}') AS code FROM customer")
def str11_formats(spark, sf_dir):
    tail = F.expr("right(c_name, 9 + cast(c_custkey % 2 as int))")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("09"), F.right("c_name", F.lit(9))).rlike("^09[0-9]{9}$").alias("phone"), tail.rlike("^[0-9]{9}$").alias("code"))


@query("SELECT vec_id, round(atan2(embedding[1]::DOUBLE, embedding[2]::DOUBLE) / 2, 6) AS angle, round(cos(embedding[3]::DOUBLE), 6) AS cosine, ceil(abs(embedding[4]::DOUBLE) * 10)::BIGINT AS steps, floor(embedding[4]::DOUBLE * 10)::BIGINT AS low FROM embeddings")
def num02_arithmetic(spark, sf_dir):
    e = lambda k: F.element_at("embedding", k).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.atan2(e(1), e(2)) / 2, 6).alias("angle"), F.round(F.cos(e(3)), 6).alias("cosine"), F.ceil(F.abs(e(4)) * 10).alias("steps"), F.floor(e(4) * 10).alias("low"))


@query("SELECT o_orderkey, round(o_totalprice / 7, 3) AS three, floor(o_totalprice / 1000 + 0.5)::BIGINT AS thousands, -floor(-(o_totalprice / 1000) + 0.5)::BIGINT AS mirrored FROM orders")
def num03_fixed_places(spark, sf_dir):
    """Fixed places; half up goes towards plus infinity, also below 0."""
    k = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 7, 3).alias("three"), half_up(k).alias("thousands"), F.negate(half_up(-k)).alias("mirrored"))


@query("SELECT p_partkey, 10 + floor((p_partkey - 1) * 20 / 2000)::BIGINT AS page, ceil(p_partkey / 12)::BIGINT AS bucket FROM part")
def num04_interpolated(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (10 + F.floor((F.col("p_partkey") - 1) * 20 / 2000)).alias("page"), F.ceil(F.col("p_partkey") / 12).alias("bucket"))


@query("SELECT o_orderkey FROM orders WHERE contains(CAST(o_orderdate AS DATE)::VARCHAR, '-07-')")
def dt03_date_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.contains(F.col("o_orderdate").cast("date").cast("string"), F.lit("-07-"))).select("o_orderkey")


@query("SELECT vec_id, list_bool_or(list_transform(e, lambda x: x > 0.3)) AS some, list_bool_and(list_transform(e, lambda x: x > -0.5)) AS every, len(list_filter(e, lambda x: x > 0))::INT AS positive, round(list_sum(list_transform(e[1:8], lambda x: x * 2)), 6) AS total, coalesce(list_position(list_transform(e, lambda x: x > 0.2), true), 0)::BIGINT AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def arr01_list_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    total = F.aggregate(F.transform(F.slice("e", 1, 8), lambda x: x * 2), F.lit(0.0), lambda s, x: s + x)
    first = F.array_position(F.transform("e", lambda x: x > 0.2), F.lit(True))
    return rows.select("vec_id", F.exists("e", lambda x: x > 0.3).alias("some"), F.forall("e", lambda x: x > -0.5).alias("every"), F.size(F.filter("e", lambda x: x > 0)).alias("positive"), F.round(total, 6).alias("total"), first.alias("first"))


@query("SELECT vec_id, round(e[64], 6) AS turned, round(e[8], 6) AS mirrored FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def arr02_turned(spark, sf_dir):
    """An 8 x 8 plane turned by half a turn, and mirrored row by row: the first value of each."""
    e = F.col("embedding").cast("array<double>")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.reverse(F.slice(e, r * 8 + 1, F.lit(8))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(F.reverse(e), 1), 6).alias("turned"), F.round(F.element_at(F.flatten(rows), 1), 6).alias("mirrored"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 9 ELSE 0 END AS weight, 3::BIGINT AS kinds FROM events")
def map01_defaults(spark, sf_dir):
    """Settings over defaults: the later map wins; a key of neither is 0."""
    defaults, given = F.create_map(F.lit("click"), F.lit(2), F.lit("view"), F.lit(1)), F.create_map(F.lit("view"), F.lit(9), F.lit("error"), F.lit(0))
    merged = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k)), given)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(merged, F.col("event_type")), F.lit(0)).alias("weight"), F.size(F.map_entries(merged)).cast("long").alias("kinds"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"type\":\"' || event_type || '\",\"user\":' || user_id::VARCHAR || '}' AS told FROM events")
def jsn01_json(spark, sf_dir):
    """Read by schema, and told again."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k bigint")["k"].cast("string").alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("told"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 5.0::DOUBLE WHEN c_custkey % 3 = 1 THEN 5 ELSE c_acctbal END AS falsy, CASE WHEN c_custkey % 3 = 0 THEN 5.0::DOUBLE WHEN c_custkey % 3 = 1 THEN 0 ELSE c_acctbal END AS nullish FROM customer")
def cnd02_defaults(spark, sf_dir):
    """A default for null and 0, and one for null only."""
    value = F.when(F.col("c_custkey") % 3 == 1, 0.0).when(F.col("c_custkey") % 3 == 2, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.falsy(value, F.lit(5.0)).alias("falsy"), F.coalesce(value, F.lit(5.0)).alias("nullish"))


@query("SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'none' WHEN p_size <= 15 THEN 'low' ELSE 'available' END AS state, upper(p_brand) AS brand FROM part")
def cnd01_stock_state(spark, sf_dir):
    state = F.when(F.col("p_size") <= 5, "none").when(F.col("p_size") <= 15, "low").otherwise("available")
    return table(spark, sf_dir, "part").select("p_partkey", state.alias("state"), F.upper("p_brand").alias("brand"))


_INQUIRY = """WITH g AS (SELECT n_nationkey AS grade, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'L' || n_regionkey::VARCHAR END AS grade_list FROM nation),
l AS (SELECT 'L' || r_regionkey::VARCHAR AS name, r_regionkey * 5 AS percent, r_regionkey * 40 + 3 AS own_key, r_regionkey * 7 AS own_price FROM region),
r AS (SELECT p_partkey, floor(p_retailprice * 1.35::DOUBLE + 0.5)::BIGINT AS retail, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 25)::INT END AS grade, CASE WHEN p_partkey % 5 = 0 THEN 'L' || (p_partkey % 7)::VARCHAR END AS list FROM part),
u AS (SELECT r.*, coalesce(l.name, 'L3') AS used FROM r LEFT JOIN g ON r.grade = g.grade LEFT JOIN l ON l.name = coalesce(r.list, grade_list))"""


@query(_INQUIRY + " SELECT p_partkey, CASE WHEN grade IS NOT NULL OR list IS NOT NULL THEN used END AS used, CASE WHEN grade IS NOT NULL OR list IS NOT NULL THEN CASE WHEN own_key = p_partkey AND own_price <> 0 THEN own_price ELSE floor(retail * (1 - percent / 100) + 0.5)::BIGINT END END AS price FROM u JOIN l ON used = l.name")
def biz02_inquiry_price(spark, sf_dir):
    nation, region, part = (table(spark, sf_dir, n) for n in ("nation", "region", "part"))
    grades = nation.select(F.col("n_nationkey").cast("long").alias("grade"), F.when(F.col("n_nationkey") % 4 > 0, F.concat(F.lit("L"), F.col("n_regionkey").cast("string"))).alias("grade_list"))
    key = F.col("r_regionkey").cast("long")
    lists = region.select(F.concat(F.lit("L"), F.col("r_regionkey").cast("string")).alias("list_name"), (key * 5).alias("percent"), F.create_map(key * 40 + 3, key * 7).alias("own"))
    rows = part.select(F.col("p_partkey").alias("product"), half_up(F.col("p_retailprice") * F.lit(1.35)).alias("retail"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 25).alias("grade"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("L"), (F.col("p_partkey") % 7).cast("string"))).alias("list"))
    return pricing.inquiry_price(rows, grades, lists, "L3").select(F.col("product").alias("p_partkey"), "used", "price")


@query("SELECT o_orderkey, code, CASE WHEN code = 'NONE' THEN 'unknown' WHEN o_orderstatus = 'P' THEN 'role' WHEN code = 'FIRST' AND n > 9 THEN 'not first' WHEN code = 'BACK' AND n > 9 AND o_custkey % 2 = 0 THEN 'not away' WHEN o_totalprice < 100000 THEN 'minimum' ELSE 'ok' END AS reason FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'FIRST' WHEN 2 THEN 'BACK' ELSE 'SALE' END AS code, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def biz03_discount_code(spark, sf_dir):
    """Whether a code holds for an order; ten orders or more are a history here."""
    orders = table(spark, sf_dir, "orders")
    n = orders.groupBy("o_custkey").agg(F.greatest(F.count("*") - 9, F.lit(0)).alias("n"))
    turn = F.col("o_orderkey") % 5
    code = F.when(turn == 0, "NONE").when(turn == 1, "FIRST").when(turn == 2, "BACK").otherwise("SALE")
    rows = orders.withColumn("code", code).join(n, "o_custkey")
    reason = pricing.discount_reason(F.col("code") != "NONE", F.col("o_orderstatus") != "P", F.col("code") == "FIRST", F.col("code") == "BACK", F.col("n"), F.col("o_custkey") % 2 == 1, F.col("o_totalprice") >= 100000)
    return rows.select("o_orderkey", "code", reason.alias("reason"))


_TIERED = "CASE WHEN c_acctbal >= 7500 THEN 'gold' WHEN c_acctbal >= 2500 THEN 'silver' ELSE 'bronze' END"


@query(f"SELECT o_orderkey, floor(o_totalprice * CASE {_TIERED} WHEN 'gold' THEN 5 WHEN 'silver' THEN 2 ELSE 0 END / 100 + 0.5) AS off, {_TIERED} = 'gold' AS free_shipping FROM orders JOIN customer ON o_custkey = c_custkey")
def biz05_tier_discount(spark, sf_dir):
    tiers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.expr(_TIERED).alias("tier"))
    both = table(spark, sf_dir, "orders").join(tiers, "o_custkey")
    return both.select("o_orderkey", pricing.tier_discount(F.col("tier"), F.col("o_totalprice")).cast("double").alias("off"), (F.col("tier") == "gold").alias("free_shipping"))


@query("SELECT o_orderkey, greatest(0, least(c_acctbal * 20, o_totalprice)) AS used, greatest(0, o_totalprice - greatest(0, least(c_acctbal * 20, o_totalprice))) AS to_pay FROM orders JOIN customer ON o_custkey = c_custkey")
def biz06_redemption(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") * 20).alias("points"))
    both = table(spark, sf_dir, "orders").join(points, "o_custkey")
    used = pricing.redeemed(F.col("points"), F.col("o_totalprice"))
    return both.select("o_orderkey", used.alias("used"), F.greatest(F.lit(0.0), F.col("o_totalprice") - used).alias("to_pay"))


@query("SELECT p_partkey, 100000 + (p_partkey * 7919) % 400 * 1000 AS base, p_partkey % 6 = 0 AS featured, p_partkey % 10 = 0 AS inquiry, CASE WHEN p_partkey % 4 = 0 THEN 10 ELSE 0 END AS discount FROM part")
def biz14_formula_columns(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (100000 + k * 7919 % 400 * 1000).alias("base"), (k % 6 == 0).alias("featured"), (k % 10 == 0).alias("inquiry"), F.when(k % 4 == 0, 10).otherwise(0).alias("discount"))


@query("SELECT user_id, greatest(0, sum(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 0 END))::BIGINT AS earned, greatest(0, sum(CASE WHEN event_type = 'purchase' THEN floor(value) WHEN event_type = 'click' THEN -floor(value / 10) ELSE 0 END))::BIGINT AS balance, sum(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 0 END) >= 500 AS can_redeem FROM events GROUP BY user_id")
def biz15_points_ledger(spark, sf_dir):
    """Signed rows; the balance never falls below 0, and redeeming takes a balance that covers it."""
    gained = F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(0)
    spent = F.when(F.col("event_type") == "click", F.floor(F.col("value") / 10)).otherwise(0)
    total = F.sum(gained)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.greatest(F.lit(0), total).cast("long").alias("earned"), F.greatest(F.lit(0), F.sum(gained - spent)).cast("long").alias("balance"), (total >= 500).alias("can_redeem"))


_MOVES = "SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT WHEN event_type = 'click' THEN -floor(value)::BIGINT ELSE 0 END AS amount FROM events"
_FOLD = "WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({moves})), r AS (SELECT user_id, event_id, n, {first} FROM m WHERE n = 1 UNION ALL SELECT m.user_id, m.event_id, m.n, {next} FROM r JOIN m ON m.user_id = r.user_id AND m.n = r.n + 1) "


def moves(spark, sf_dir):
    """Points that purchases bring and clicks cost."""
    points = F.floor("value").cast("long")
    amount = F.when(F.col("event_type") == "purchase", points).when(F.col("event_type") == "click", -points).otherwise(F.lit(0).cast("long"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", amount.alias("amount"))


@query(_FOLD.format(moves=_MOVES, first="greatest(0, amount) AS balance", next="greatest(0, r.balance + m.amount)") + "SELECT user_id, event_id, balance::BIGINT AS balance FROM r")
def biz15_floored_balance(spark, sf_dir):
    """The balance after each row, never below 0; a user's history is cut into hours."""
    found = floored(moves(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("amount"), F.date_trunc("hour", "ts"))
    return found.select("user_id", "event_id", F.col("balance").cast("long").alias("balance"))


@query(_FOLD.format(moves=_MOVES, first="amount >= 0 AS accepted, greatest(0, amount) AS balance", next="m.amount >= 0 OR r.balance + m.amount >= 0, CASE WHEN m.amount >= 0 OR r.balance + m.amount >= 0 THEN r.balance + m.amount ELSE r.balance END") + "SELECT user_id, event_id, accepted, balance::BIGINT AS balance FROM r")
def biz15_guarded_ledger(spark, sf_dir):
    """A redemption that the balance doesn't cover is refused and leaves no trace in the balance."""
    return guarded(moves(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("amount")).select("user_id", "event_id", "accepted", "balance")


@query("WITH s AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, name, v AS l_extendedprice FROM s JOIN (VALUES ('low', 0.02::DOUBLE), ('upper_median', 0.5), ('high', 0.98)) w(name, share) ON k = least(floor(n * share), n - 1)")
def agg22_group_order_statistics(spark, sf_dir):
    """Exact places in groups of any size; no group is sorted or listed."""
    return places(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"low": 0.02, "upper_median": 0.5, "high": 0.98})


@query("SELECT p_type, p_partkey, rank, margin FROM (SELECT p_type, p_partkey, row_number() OVER w AS rank, p_retailprice - lead(p_retailprice) OVER w AS margin FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey)) WHERE rank <= 10")
def win10_rank_margin(spark, sf_dir):
    """The ten dearest of each category and their lead over the next; salted parts of a category give their eleven dearest first."""
    part = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_retailprice").withColumn("salt", F.pmod(F.xxhash64("p_partkey"), F.lit(32)))
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    few = part.withColumn("k", F.row_number().over(Window.partitionBy("p_type", "salt").orderBy(*order))).where("k <= 11")
    own = Window.partitionBy("p_type").orderBy(*order)
    ranked = few.withColumns({"rank": F.row_number().over(own), "margin": F.col("p_retailprice") - F.lead("p_retailprice").over(own)})
    return ranked.where("rank <= 10").select("p_type", "p_partkey", "rank", "margin")


@query("SELECT page_id, lower(trim('  ' || upper(url) || ' ')) AS plain, starts_with(url, 'https') AS safe, contains(html, '<p') AS paragraphs, length(replace(html, '<', '')) AS bare FROM pages")
def str01_text_basics(spark, sf_dir):
    plain = F.lower(F.trim(F.concat(F.lit("  "), F.upper("url"), F.lit(" "))))
    return table(spark, sf_dir, "pages").select("page_id", plain.alias("plain"), F.startswith("url", F.lit("https")).alias("safe"), F.contains("html", F.lit("<p")).alias("paragraphs"), F.length(F.replace("html", F.lit("<"), F.lit(""))).cast("long").alias("bare"))


@query("SELECT c_custkey, floor(c_acctbal + 0.5)::BIGINT AS whole, floor(c_acctbal / 1000 + 0.5)::BIGINT AS thousands FROM customer")
def num01_half_up(spark, sf_dir):
    """Half up for balances below 0 too."""
    return table(spark, sf_dir, "customer").select("c_custkey", half_up(F.col("c_acctbal")).alias("whole"), half_up(F.col("c_acctbal") / 1000).alias("thousands"))


@query("SELECT user_id, count_if(ts >= m - INTERVAL 24 HOUR) AS last_day, count(*) AS n FROM events, (SELECT max(ts) AS m FROM events) GROUP BY user_id")
def stm04_last_day(spark, sf_dir):
    """Counted when read, a row of exactly a day ago included."""
    events = table(spark, sf_dir, "events")
    now = F.broadcast(events.agg(F.max("ts").alias("now")))  # one row
    recent = F.col("ts") >= F.col("now") - F.expr("interval 24 hours")
    return events.join(now).groupBy("user_id").agg(F.count_if(recent).alias("last_day"), F.count("*").alias("n"))
