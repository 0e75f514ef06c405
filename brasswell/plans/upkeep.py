"""What people do and what the index keeps, from stored tables and logs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasswell.functions.text import collated, point_id
from brasswell.operators.carts import carts, wished
from brasswell.plans.registry import query, table
from brasswell.sources import storage
from brasswell.sources.generations import Generations, append_newest

#: The letters of the Persian alphabet in its order, fixed values.
LETTERS = "آابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهی"
_LETTER = "substr('" + LETTERS + "', CAST(c_custkey * {0} % 33 AS INT) + 1, 1)"
_NAME = " || ".join(_LETTER.format(k) for k in (7, 5, 11)) + " || ' ' || CAST(c_custkey * 37 % 211 AS STRING)"


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey * 7 % 33, c_custkey * 5 % 33, c_custkey * 11 % 33, c_custkey * 37 % 211, c_custkey)::INT AS place FROM customer ORDER BY place LIMIT 200")
def ord01_collated_names(spark, sf_dir):
    """The first 200 of invented names in the order of the Persian alphabet, which isn't that of code points, and of the numbers after them."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_NAME).alias("name"))
    top = names.orderBy(collated(F.col("name")), "c_custkey").limit(200)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(collated(F.col("name")), "c_custkey")).alias("place"))  # of 200 rows


_HASH = "SELECT page_id, list_reduce(list_transform(string_split(url, ''), lambda c: ord(c)::BIGINT), lambda a, b: (a * 31 + b) % 4294967296) AS u FROM pages WHERE url <> ''"


@query(f"WITH h AS ({_HASH}), s AS (SELECT page_id, u, xor(u, 2654435769) AS x FROM h) SELECT page_id, printf('%08x', CASE WHEN u >= 2147483648 THEN 4294967296 - u ELSE u END) || '-0000-4000-8000-' || printf('%012x', CASE WHEN x >= 2147483648 THEN 4294967296 - x ELSE x END) AS point FROM s")
def str08_point_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url <> ''").select("page_id", point_id(F.col("url")).alias("point"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AS recent FROM events")
def dt01_epoch_and_cutoff(spark, sf_dir):
    """Milliseconds, ISO text and whether a row lies in the last 24 hours of the log."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = F.broadcast(events.agg(F.max("ts").alias("last")))  # one row
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events.join(last).select("event_id", F.unix_millis("ts").alias("ms"), iso.alias("iso"), (F.col("ts") > F.col("last") - F.expr("INTERVAL 24 HOURS")).alias("recent"))


_KIND = "CASE event_id * 7 % 11 WHEN 0 THEN 'set' WHEN 1 THEN 'set' WHEN 2 THEN 'remove' WHEN 3 THEN 'save' WHEN 4 THEN 'save' WHEN 5 THEN 'back' WHEN 6 THEN 'forget' ELSE 'add' END"
_LOG = f"SELECT user_id AS cart, event_id % 3 AS product, event_id AS tick, {_KIND} AS kind, event_id * 13 % 7 - 1 AS quantity FROM events"
_THERE = "CASE WHEN m.kind = 'add' AND m.quantity >= 1 THEN r.q + m.quantity WHEN m.kind = 'back' THEN r.q + 1 WHEN m.kind IN ('remove', 'save') OR (m.kind = 'set' AND m.quantity < 1) THEN 0 WHEN m.kind = 'set' AND r.q > 0 THEN m.quantity ELSE r.q END"
_SAVED = "CASE WHEN m.kind = 'save' AND r.q > 0 THEN true WHEN m.kind IN ('back', 'forget') THEN false ELSE r.saved END"


@query(f"WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY cart, product ORDER BY tick) AS n FROM ({_LOG})), r AS (SELECT DISTINCT cart, product, 0::BIGINT AS n, 0::BIGINT AS q, false AS saved FROM m UNION ALL SELECT m.cart, m.product, m.n, ({_THERE})::BIGINT, {_SAVED} FROM r JOIN m ON m.cart = r.cart AND m.product = r.product AND m.n = r.n + 1) SELECT cart, product, q AS quantity, saved FROM (SELECT *, row_number() OVER (PARTITION BY cart, product ORDER BY n DESC) AS k FROM r) WHERE k = 1 AND (q > 0 OR saved)")
def dml18_cart_log(spark, sf_dir):
    """Carts and saved products after all that people did: add, set a quantity, remove, save for later, take back."""
    return carts(table(spark, sf_dir, "events").selectExpr("user_id AS cart", "event_id % 3 AS product", "event_id AS at", f"{_KIND} AS kind", "event_id * 13 % 7 - 1 AS quantity"))


@query("SELECT user_id AS person, event_id % 5 AS product, max(event_id) AS last FROM events WHERE event_type <> 'purchase' GROUP BY ALL HAVING count(*) % 2 = 1")
def dml21_wishlist_toggle(spark, sf_dir):
    return wished(table(spark, sf_dir, "events").where("event_type <> 'purchase'").selectExpr("user_id AS person", "event_id % 5 AS product", "event_id AS at")).withColumnRenamed("at", "last")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def snk03_retained_log(spark, sf_dir):
    """Entries arrive in four batches at a stored log, each generation of which keeps the newest 500."""
    log = Generations(spark, storage.new_path(spark))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    for part in range(4):
        append_newest(log, events.where(F.col("event_id") % 4 == part), [F.desc("ts"), F.desc("event_id")], 500)
    return log.read(events.where("false")).select("event_id", "user_id", "event_type")


def features(spark, sf_dir) -> DataFrame:
    """Stored features; some hashes are short and some colour lists lack."""
    digest = F.substr(F.sha2(F.col("vec_id").cast("string"), 256), F.lit(1), F.when(F.col("vec_id") % 7 == 0, 60).otherwise(64))
    return table(spark, sf_dir, "embeddings").select("vec_id", digest.alias("dh"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("col"))


@query("SELECT vec_id, list_sum(embedding::DOUBLE[]) > 0 AS bright, version FROM embeddings, (VALUES (7), (8)) v(version) WHERE version = 7 AND vec_id % 7 <> 0 AND vec_id % 5 <> 0")
def src11_stored_features(spark, sf_dir):
    """Features are written as two versions; a reader of one of them takes its whole rows, a reader of a third finds an empty table."""
    path, rows = storage.new_path(spark), features(spark, sf_dir)
    storage.stored_version(rows.where("vec_id % 2 = 0"), path, 6)
    read = storage.stored_version(rows, path, 7)
    none = storage.read_version(spark, path, 8, read.where("false"))
    whole = lambda df, v: df.where("length(dh) = 64 AND col IS NOT NULL").select("vec_id", (F.aggregate("col", F.lit(0.0), lambda s, x: s + x.cast("double")) > 0).alias("bright"), F.lit(v).alias("version"))
    return whole(read, 7).union(whole(none, 8))


_VALID = "WITH c AS (SELECT vec_id % 50 AS product, vec_id AS image FROM embeddings), i AS (SELECT *, CASE WHEN product = 4 THEN 6 ELSE 7 END AS version, CASE WHEN product = 9 THEN 'other' ELSE 'local' END AS provider, CASE WHEN product = 11 THEN 1 ELSE 4 END AS views FROM c WHERE product < 48 AND image % 33 > 0)"


@query(_VALID + " SELECT product, expected, entries, CASE WHEN entries = 0 THEN 'build' WHEN version <> 7 THEN 'other format' WHEN provider <> 'local' THEN 'other provider' WHEN views < 4 THEN 'views lack' WHEN entries < expected THEN 'resume' ELSE 'valid' END AS state FROM (SELECT c.product, count(*) AS expected, count(i.image) AS entries, min(version) AS version, max(provider) AS provider, min(views) AS views FROM c LEFT JOIN i USING (product, image) GROUP BY 1)")
def dml11_state_of_index(spark, sf_dir):
    """Each product's stored entries held against its images in the catalogue: format, provider, views, and how many are expected."""
    catalogue = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("product"), F.col("vec_id").alias("image"))
    pick = lambda p, other, own: F.when(F.col("product") == p, other).otherwise(own)
    index = catalogue.where("product < 48 AND image % 33 > 0").select("product", "image", pick(4, 6, 7).alias("version"), pick(9, "other", "local").alias("provider"), pick(11, 1, 4).alias("views"))
    expected = catalogue.groupBy("product").agg(F.count("*").alias("expected"))
    held = storage.stored(index).groupBy("product").agg(F.count("*").alias("entries"), F.min("version").alias("version"), F.max("provider").alias("provider"), F.min("views").alias("views"))
    both = expected.join(held, "product", "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("long")))
    state = F.when(F.col("entries") == 0, "build").when(F.col("version") != 7, "other format").when(F.col("provider") != "local", "other provider").when(F.col("views") < 4, "views lack").when(F.col("entries") < F.col("expected"), "resume").otherwise("valid")
    return both.select("product", "expected", "entries", state.alias("state"))
