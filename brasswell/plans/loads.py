"""Reads and writes of the catalogue, each beside its SQL. Parts stand for products, pages and events for files and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasswell.functions.codec import decode_bytes, decode_floats, encode_bytes, encode_floats
from brasswell.operators.ranking import newest, numbered
from brasswell.operators.vectors import normalised
from brasswell.plans.registry import query, table
from brasswell.sources import readers, storage
from brasswell.sources.lines import imported_files

#: A product's code: every third one has no mark before it.
CODE = "CASE WHEN p_partkey % 3 = 0 THEN 'p-' || CAST(p_partkey AS STRING) ELSE 'AT-P-' || CAST(p_partkey AS STRING) END"
PRICE = "CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE CAST(floor(p_retailprice) AS BIGINT) END"
STOCK = "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 40 END"


def product_json(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr(f"{CODE} AS code", "' ' || p_name || ' ' AS name", "p_brand AS brand", "p_type AS category", f"{PRICE} AS price", f"{STOCK} AS stock", "array(struct('size' AS key, CAST(p_size AS STRING) AS value), struct('type' AS key, p_type AS value)) AS specs")
    return part.select(F.to_json(F.struct("*")).alias("json"))


_SKU = f"CASE WHEN starts_with({CODE}, 'AT-') THEN {CODE} ELSE 'AT-' || {CODE} END"


@query(f"SELECT {CODE} AS code, {_SKU} AS sku, trim(p_name) AS name, p_brand AS brand, p_type AS category, ({PRICE})::BIGINT AS price, coalesce({STOCK}, 0)::BIGINT AS stock, {PRICE} <= 0 AS inquiry_only, 'size: ' || p_size::VARCHAR || ' | type: ' || p_type AS specs FROM part")
def src01_products(spark, sf_dir):
    return readers.products(product_json(spark, sf_dir))


@query("SELECT p_type, count(*) AS n, 0 AS seeded FROM part GROUP BY p_type")
def src02_missing_table(spark, sf_dir):
    """A table that isn't there counts as empty."""
    part = table(spark, sf_dir, "part").select("p_type", F.lit(False).alias("seed"))
    more = readers.read_or(spark, f"{sf_dir}/part_of_no_year.parquet", part.limit(0)).withColumn("seed", F.lit(True))
    return part.unionByName(more).groupBy("p_type").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("int")).cast("int").alias("seeded"))


@query(f"WITH p AS (SELECT {CODE} AS code, p_partkey FROM part) SELECT key, min(p_partkey) AS p_partkey FROM (SELECT code AS key, p_partkey FROM p UNION SELECT lower(code), p_partkey FROM p UNION SELECT replace(lower(code), '-', ''), p_partkey FROM p) GROUP BY key")
def src03_key_index(spark, sf_dir):
    """Each product under three spellings of its code; the smallest one where products share a spelling."""
    code = F.expr(CODE)
    spellings = F.array_distinct(F.array(code, F.lower(code), F.replace(F.lower(code), F.lit("-"), F.lit(""))))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(spellings).alias("key")).groupBy("key").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT p_partkey, i % 9 = 0 AS featured, CASE WHEN i % 5 = 0 THEN 10 WHEN i % 5 = 1 THEN 5 ELSE 0 END AS discount, floor(p_retailprice / 100)::BIGINT AS points, CASE WHEN p_size < 5 THEN 10 ELSE 1 END AS min_order FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)")
def src04_by_place(spark, sf_dir):
    """Columns that follow a product's place in the table."""
    i = F.col("place") - 1
    rows = numbered(table(spark, sf_dir, "part"), "p_partkey", "place")
    discount = F.when(i % 5 == 0, 10).when(i % 5 == 1, 5).otherwise(0)
    return rows.select("p_partkey", (i % 9 == 0).alias("featured"), discount.alias("discount"), F.floor(F.col("p_retailprice") / 100).alias("points"), F.when(F.col("p_size") < 5, 10).otherwise(1).alias("min_order"))


_FILE = "CASE p_partkey % 3 WHEN 0 THEN 'e(' || CAST(p_partkey AS STRING) || ').jpg' WHEN 1 THEN 'e(0' || CAST(p_partkey AS STRING) || ').jpg' ELSE 'plain' || CAST(p_partkey AS STRING) || '.png' END"
_PADS = "WITH f AS (SELECT {0} AS name, p_partkey AS k, p_partkey::VARCHAR AS d FROM part WHERE p_size > 10), a AS (SELECT name AS alias, name FROM f UNION SELECT 'e(' || d || ').jpg', name FROM f WHERE k % 3 < 2 UNION SELECT 'e(' || lpad(d, greatest(length(d), 2)::INT, '0') || ').jpg', name FROM f WHERE k % 3 < 2 UNION SELECT 'e(' || lpad(d, greatest(length(d), 3)::INT, '0') || ').jpg', name FROM f WHERE k % 3 < 2), b AS (SELECT alias, name FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY (alias <> name), name) AS n FROM a) WHERE n = 1)".format(_FILE)


def files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 10").select(F.expr(_FILE).alias("name"))


@query(_PADS + " SELECT alias, name FROM b")
def src05_name_aliases(spark, sf_dir):
    return readers.name_aliases(files(spark, sf_dir))


@query(_PADS + " SELECT p_partkey, wanted, coalesce(b.name, 'fallback' || (p_partkey % 7)::VARCHAR || '.jpg') AS image, b.name IS NOT NULL AS found FROM (SELECT p_partkey, 'e(' || lpad(p_partkey::VARCHAR, 3, '0') || ').jpg' AS wanted FROM part) LEFT JOIN b ON wanted = alias")
def src06_image_names(spark, sf_dir):
    """The file that a product's image name means, by any padding; one of seven fallbacks where there is none."""
    wanted = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("e("), F.lpad(F.col("p_partkey").cast("string"), 3, "0"), F.lit(").jpg")).alias("wanted"))
    both = wanted.join(readers.name_aliases(files(spark, sf_dir)), F.col("wanted") == F.col("alias"), "left")
    fallback = F.concat(F.lit("fallback"), (F.col("p_partkey") % 7).cast("string"), F.lit(".jpg"))
    return both.select("p_partkey", "wanted", F.coalesce("name", fallback).alias("image"), F.col("name").isNotNull().alias("found"))


@query("SELECT page_id, coalesce(substr(sha256(html), 1, 16), '') AS hash FROM pages")
def src07_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", readers.content_hash("html").alias("hash"))


_SENT = "CASE page_id % 4 WHEN 0 THEN 'data:image/png;base64,' || {b} WHEN 1 THEN {b} WHEN 2 THEN url ELSE '' END"
MOST = 12 * 1024 * 1024


@query("WITH s AS (SELECT page_id, " + _SENT.format(b="base64(encode(html))") + " AS sent FROM pages) SELECT page_id, CASE WHEN sent = '' THEN 'empty' WHEN starts_with(sent, 'http') THEN 'link' ELSE 'bytes' END AS kind, CASE WHEN sent <> '' AND NOT starts_with(sent, 'http') THEN octet_length(from_base64(regexp_replace(sent, '^data:[^,]*,', ''))) END AS size FROM s")
def src08_payloads(spark, sf_dir):
    """Images as they are sent: a link (which isn't fetched), a data URL or bare base64; empty ones and those over 12 MB are none."""
    sent = table(spark, sf_dir, "pages").select("page_id", F.expr(_SENT.format(b="base64(encode(html, 'UTF-8'))")).alias("sent"))
    link = F.col("sent").rlike("^https?://")
    content = F.unbase64(F.regexp_replace("sent", "^data:[^,]*,", ""))
    size = F.octet_length(content)
    kind = F.when(F.col("sent") == "", "empty").when(link, "link").when(size > MOST, "too large").otherwise("bytes")
    return sent.select("page_id", kind.alias("kind"), F.when((F.col("sent") != "") & ~link, size.cast("long")).alias("size"))


_BYTES = "list_transform(embedding, lambda x: CAST(floor(greatest(-1::DOUBLE, least(1::DOUBLE, x::DOUBLE)) * 127 + 0.5) AS INT))"


@query(f"SELECT vec_id, base64(from_hex(array_to_string(list_transform({_BYTES}, lambda b: lpad(printf('%x', (b + 256) % 256), 2, '0')), ''))) AS code FROM embeddings")
def snk04_vector_codec(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", encode_bytes(F.col("embedding").cast("array<double>")).alias("code"))


@query(f"WITH d AS (SELECT vec_id, list_transform({_BYTES}, lambda b: b / 127.0::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS head, true AS whole FROM d")
def src09_vector_index(spark, sf_dir):
    """Vectors read back from bytes and normalised again; those read back from floats are what was stored."""
    told = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", encode_bytes(F.col("embedding").cast("array<double>")).alias("b"), encode_floats("embedding").alias("f"))
    read = told.select("vec_id", normalised(decode_bytes(F.col("b"))).alias("v"), (decode_floats("f") == F.col("embedding")).alias("whole"))
    return read.select("vec_id", F.round(F.element_at("v", 1), 6).alias("head"), "whole")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 1")
def src10_version_gate(spark, sf_dir):
    """Rows of another format version count as missing."""
    rows = table(spark, sf_dir, "embeddings").withColumn("version", 6 + F.col("vec_id") % 3)
    return rows.where("version = 7").select("vec_id", "label")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 0")
def src11_valid_features(spark, sf_dir):
    """Rows of a feature cache that are whole: a hash of 64 digits and a colour list."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.substr(F.sha2(F.col("vec_id").cast("string"), 256), F.lit(1), F.when(F.col("vec_id") % 7 == 0, 60).otherwise(64)).alias("dh"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("col"))
    return rows.where("length(dh) = 64 and col is not null").select("vec_id")


#: A line of import text for a part: some without a code or price, some of two cells, some blank, some quoted.
_LINE = "CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'two,cells' ELSE {code} || ', ' || {name} || ',' || p_brand || ',' || p_type || ',' || {price} || ',' || {stock} END"
_CELL = {"code": "CASE WHEN p_partkey % 23 = 0 THEN '' ELSE 'x-' || CAST(p_partkey AS STRING) END", "name": "'\"part ' || CAST(p_partkey AS STRING) || '\"'", "price": "CASE WHEN p_partkey % 29 = 0 THEN '0' ELSE CAST(p_size AS STRING) || '.5' END", "stock": "'-' || CAST(p_partkey % 9 AS STRING)"}


def import_text(spark, sf_dir) -> DataFrame:
    """One import text for each brand: a head, then a line for each part."""
    lines = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.expr(_LINE.format(**_CELL)).alias("line"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"])
    return lines.groupBy("p_brand").agg(F.concat(F.lit("code,name,brand,category,price,stock\r\n"), F.array_join(body, "\r\n")).alias("value"))


def import_files(spark, sf_dir) -> str:
    """The same texts as files, one for each brand, whose lines Spark reads in blocks."""
    part = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("k"), F.expr(_LINE.format(**_CELL)).alias("value"))
    heads = part.select("p_brand").distinct().select("p_brand", F.lit(-1).cast("long"), F.lit("code,name,brand,category,price,stock"))
    path = storage.new_path(spark)
    rows = part.union(heads).withColumn("value", F.concat("value", F.lit("\r")))
    rows.repartition("p_brand").sortWithinPartitions("p_brand", "k").select("p_brand", "value").write.option("lineSep", "\n").partitionBy("p_brand").text(path)
    return path


#: The import rows of the texts, as SQL.
IMPORT = f"""SELECT n AS row_number, {_CELL["code"]} AS code, 'part ' || p_partkey::VARCHAR AS name, p_brand AS brand, p_type AS category, CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE p_size * 10 + 5 END::BIGINT AS price, (p_partkey % 9)::BIGINT AS stock
  FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 17 <> 0) WHERE p_partkey % 19 <> 0"""


@query(IMPORT)
def src12_import_rows(spark, sf_dir):
    return readers.import_rows(import_text(spark, sf_dir))


@query(IMPORT)
def src12_import_files(spark, sf_dir):
    """Rows of import files that many tasks read, numbered over blocks."""
    return imported_files(spark, import_files(spark, sf_dir))


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 5 THEN 'stored' ELSE 'seed' END AS origin FROM nation WHERE n_nationkey < 10")
def src13_stored_or_seed(spark, sf_dir):
    """Two tables of settings: one was stored before, the other comes from its seed."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = storage.new_path(spark)
    storage.stored(nation.where("n_nationkey < 5").withColumn("origin", F.lit("stored")), path)
    seed = nation.withColumn("origin", F.lit("seed"))
    return readers.read_or(spark, path, seed.where("n_nationkey < 5")).union(readers.read_or(spark, f"{path}-none", seed.where("n_nationkey between 5 and 9")))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def src14_fallback_record(spark, sf_dir):
    """A record that isn't there is its fallback."""
    part = table(spark, sf_dir, "part").select("p_type")
    return readers.read_or(spark, storage.new_path(spark), part).groupBy("p_type").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, string_agg('img/' || l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS images, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag IN ('R', 'A')) GROUP BY l_partkey")
def src15_manifest(spark, sf_dir):
    """The extra images of each product; those of a second list are added if their path isn't there yet."""
    def images(flag: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey").distinct()

    first, second = images("R"), images("A")
    every = first.unionByName(second.join(first, ["l_partkey", "l_suppkey"], "left_anti"))
    paths = F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda k: F.concat(F.lit("img/"), k.cast("string")))
    return every.groupBy("l_partkey").agg(F.array_join(paths, ",").alias("images"), F.count("*").alias("n"))


@query("SELECT p_partkey, 'G-' || lpad((p_partkey % 864 + 1)::VARCHAR, 3, '0') AS code, 150000 + (p_partkey * 37) % 90 * 10000 AS base, (p_partkey * 13) % 60 AS stock, 3.5::DOUBLE + (p_partkey % 15) / 10.0::DOUBLE AS rating, ceil((p_partkey % 864 + 1) / 12.0)::BIGINT AS page FROM part")
def src18_generated(spark, sf_dir):
    """Catalogue columns by formula from the key."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 864 + 1
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("G-"), F.lpad(n.cast("string"), 3, "0")).alias("code"), (150000 + (k * 37) % 90 * 10000).alias("base"), (k * 13 % 60).alias("stock"), (F.lit(3.5) + (k % 15) / 10.0).alias("rating"), F.ceil(n / 12.0).alias("page"))


@query("WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS listed, 10 + s_suppkey % 6 AS number, s_suppkey * 3 AS low, s_suppkey * 3 + 7 AS high FROM supplier) SELECT s_suppkey, i::BIGINT AS item, CASE WHEN listed > 0 THEN low ELSE low + floor((i - 1) * (high - low + 1) / number) END::BIGINT AS page FROM s, range(1, 20) t(i) WHERE i <= CASE WHEN listed > 0 THEN listed ELSE number END")
def src19_sections(spark, sf_dir):
    """Items of catalogue sections: those that are listed, on the first page, or a generated run whose pages are interpolated."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("listed"), (10 + F.col("s_suppkey") % 6).alias("number"), (F.col("s_suppkey") * 3).alias("low"), (F.col("s_suppkey") * 3 + 7).alias("high"))
    named = s.where("listed > 0").select("s_suppkey", F.explode(F.sequence(F.lit(1).cast("long"), "listed")).alias("item"), F.col("low").alias("page"))
    run = s.where("listed = 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), "number")).alias("item"))
    page = F.col("low") + F.floor((F.col("item") - 1) * (F.col("high") - F.col("low") + 1) / F.col("number"))
    return named.unionByName(run.select("s_suppkey", "item", page.alias("page")))


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 5) AS priced FROM part")
def src20_priced_keys(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_suppkey = 5").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("seen", F.lit(True))
    return table(spark, sf_dir, "part").join(seen, "p_partkey", "left").select("p_partkey", F.coalesce("seen", F.lit(False)).alias("priced"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size > 25")
def snk01_whole_write(spark, sf_dir):
    """A table is replaced whole: its second generation is all that readers see."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    path = storage.new_path(spark)
    storage.stored(part.where("p_size <= 25").drop("p_size"), path)
    return storage.stored(part.where("p_size > 25").drop("p_size"), path)


@query("SELECT event_id, user_id, event_type FROM (SELECT * FROM events UNION ALL SELECT event_id + 1000000, ts + INTERVAL 1 DAY, user_id, 'again', value, props FROM events WHERE event_id % 50 = 0) ORDER BY ts DESC, event_id DESC LIMIT 500")
def snk03_newest_log(spark, sf_dir):
    """A log to which entries are added keeps its newest 500."""
    log = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    more = log.where("event_id % 50 = 0").select(F.col("event_id") + 1000000, F.col("ts") + F.expr("interval 1 day"), "user_id", F.lit("again"))
    return newest(log.union(more), [F.desc("ts"), F.desc("event_id")], 500).select("event_id", "user_id", "event_type")


@query("SELECT 'nation' AS name, n_nationkey::BIGINT AS key, n_name AS text FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def snk06_backup(spark, sf_dir):
    """Several tables in one, a JSON record a row, and what a restore reads from it."""
    record = lambda name: table(spark, sf_dir, name).select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("record"))
    saved = storage.stored(record("nation").union(record("region")).union(record("supplier")))
    field = lambda *names: F.coalesce(*(F.get_json_object("record", f"$.{n}") for n in names))
    return saved.select("name", field("n_nationkey", "r_regionkey", "s_suppkey").cast("long").alias("key"), field("n_name", "r_name", "s_name").alias("text"))


@query("SELECT r_regionkey, r_name, 0::BIGINT AS log FROM region")
def snk07_reset(spark, sf_dir):
    """A changed table is its seed again, a log is empty."""
    seed, path, log = table(spark, sf_dir, "region").select("r_regionkey", "r_name"), storage.new_path(spark), storage.new_path(spark)
    storage.stored(seed.where("r_regionkey > 2"), path)
    storage.stored(seed, log)
    emptied = storage.stored(seed.limit(0), log).agg(F.count("*").alias("log"))
    return storage.stored(seed, path).join(F.broadcast(emptied))


@query("SELECT p_type, p_brand, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS parts FROM part WHERE p_size <= 5 GROUP BY p_type, p_brand")
def snk09_generated_tables(spark, sf_dir):
    """A table for each category, by partition, read back as one."""
    path = storage.new_path(spark)
    small = table(spark, sf_dir, "part").where("p_size <= 5")
    small.select("p_type", "p_brand", "p_partkey").repartition("p_type").write.partitionBy("p_type").parquet(path)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: k.cast("string")), ",")
    return spark.read.parquet(path).groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), text.alias("parts"))
