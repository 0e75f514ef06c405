"""Changes to catalogue, index, customer and cart tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasswell.functions.columns import half_up, stepped
from brasswell.functions.text import falsy
from brasswell.operators import merging
from brasswell.plans.loads import IMPORT, import_files, import_text
from brasswell.plans.registry import query, table
from brasswell.sources import readers
from brasswell.sources.generations import PartedTable
from brasswell.sources.lines import imported_files
from brasswell.sources.storage import new_path, stored_counted


def customers(spark, sf_dir, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*(columns or ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT c_custkey, c_name || ' new', c_acctbal + 1 FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey + 1000000, c_name || ' added', c_acctbal FROM customer WHERE c_custkey % 5 = 0")
def dml01_upsert(spark, sf_dir):
    """Every fourth customer is replaced, others are added."""
    old = customers(spark, sf_dir, "c_custkey", "c_name", "c_acctbal")
    replaced = old.where("c_custkey % 4 = 0").select("c_custkey", F.concat("c_name", F.lit(" new")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    added = old.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.concat("c_name", F.lit(" added")).alias("c_name"), "c_acctbal")
    return merging.upserted(old, replaced.union(added), "c_custkey")


@query("SELECT count(*) AS before, count_if(l_suppkey <> 7) AS left_over, count_if(l_suppkey = 7) AS removed FROM lineitem")
def dml02_delete_counted(spark, sf_dir):
    """Vectors of one product go; how many went is told."""
    gone = F.col("l_suppkey") == 7
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("before"), F.count_if(~gone).alias("left_over"), F.count_if(gone).alias("removed"))


@query("SELECT l_suppkey % 10 AS supplier, count(*) AS n, (SELECT count(*) FROM lineitem WHERE l_suppkey % 10 = 7 OR l_partkey % 50 = 3) AS removed FROM lineitem WHERE NOT (l_suppkey % 10 = 7 OR l_partkey % 50 = 3) GROUP BY 1")
def dml02_delete_stored(spark, sf_dir):
    """Entries of some products and images go from a stored table, of which only the touched parts are written anew; how many went comes back."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    index = PartedTable(spark, new_path(spark), "l_partkey").create(rows)
    removed = index.delete(F.col("l_partkey") % 50 == 3) + index.delete(F.col("l_suppkey") % 10 == 7)
    return index.read().groupBy((F.col("l_suppkey") % 10).alias("supplier")).agg(F.count("*").alias("n")).withColumn("removed", F.lit(removed).cast("long"))


@query("SELECT n_nationkey, n_name, n_nationkey::BIGINT AS ord FROM nation WHERE n_regionkey > 0 UNION ALL SELECT n_nationkey, lower(n_name), n_nationkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey - 5 FROM region")
def dml03_upsert_in_place(spark, sf_dir):
    """A replaced record keeps its place; new ones stand before all others."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").cast("long").alias("ord"), "n_regionkey")
    old = nation.drop("n_regionkey")
    fresh = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").cast("long").alias("ord"))
    changed = nation.where("n_regionkey = 0").select("n_nationkey", F.lower("n_name").alias("n_name"), "ord")
    return merging.placed(old, changed.union(fresh), "n_nationkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def dml04_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return merging.removed(customers(spark, sf_dir, "c_custkey", "c_name"), gone, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'shipped' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'O>' || o_orderstatus || '>shipped' ELSE 'O>' || o_orderstatus END AS history FROM orders")
def dml06_state_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    entry = lambda status: F.struct(status.alias("status"), F.col("o_orderdate").alias("at"), F.lit("").alias("note"))
    rows = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.array(entry(F.lit("O")), entry(F.col("o_orderstatus"))).alias("history"))
    changes = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("shipped").alias("to"), F.col("o_orderdate").alias("at"), F.lit("sent").alias("note")).dropDuplicates(["o_orderkey"])
    moved = merging.moved(rows, changes, "o_orderkey")
    return moved.select("o_orderkey", "status", F.array_join(F.col("history.status"), ">").alias("history"))


_NEW_PRICE = "CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN floor(p_retailprice * 1.1::DOUBLE / 10 + 0.5) * 10 ELSE p_retailprice END"


@query(f"SELECT p_partkey, p_retailprice AS old_price, {_NEW_PRICE} AS new_price, {_NEW_PRICE} <> p_retailprice AS logged, count_if({_NEW_PRICE} <> p_retailprice) OVER () AS changed FROM part")
def dml07_bulk_price(spark, sf_dir):
    """Prices of one category go up by a tenth, to tens; the log has the rows that changed, the answer their number."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    first = F.broadcast(part.agg(F.min("p_type").alias("chosen")))  # one row
    new = merging.changed_when(F.col("p_retailprice"), F.col("p_type") == F.col("chosen"), stepped(F.col("p_retailprice"), 1.1, 10).cast("double"))
    rows = part.join(first).select("p_partkey", F.col("p_retailprice").alias("old_price"), new.alias("new_price")).withColumn("logged", F.col("new_price") != F.col("old_price"))
    return rows.join(F.broadcast(rows.agg(F.count_if("logged").alias("changed"))))  # one row


_OLD = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'X-' ELSE 'old-' END || p_partkey::VARCHAR AS code, CASE WHEN p_partkey % 4 = 1 THEN 'part ' || p_partkey::VARCHAR ELSE 'was' END AS name, 'B' AS brand, 1::BIGINT AS price, 1::BIGINT AS retail, 1::BIGINT AS stock FROM part WHERE p_partkey % 3 > 0"
_CLASS = f"WITH r AS ({IMPORT}), o AS ({_OLD}), c AS (SELECT *, CASE WHEN code = '' OR name = '' OR price <= 0 THEN 'error' WHEN upper(code) IN (SELECT upper(code) FROM o) OR name IN (SELECT name FROM o) THEN 'update' ELSE 'new' END AS status FROM r)"


def old_products(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    code = F.concat(F.when(F.col("p_partkey") % 2 == 0, "X-").otherwise("old-"), key)
    name = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("part "), key)).otherwise("was")
    one = F.lit(1).cast("long")
    return table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(code.alias("code"), name.alias("name"), F.lit("B").alias("brand"), one.alias("price"), one.alias("retail"), one.alias("stock"))


def classified(spark, sf_dir) -> DataFrame:
    return merging.classified(readers.import_rows(import_text(spark, sf_dir)), old_products(spark, sf_dir))


@query(_CLASS + " SELECT brand, row_number, code, status FROM c")
def flt21_row_class(spark, sf_dir):
    return classified(spark, sf_dir).select("brand", "row_number", "code", "status")


@query(_CLASS + " SELECT coalesce(o.code, c.code) AS code, coalesce(c.name, o.name) AS name, coalesce(c.brand, o.brand) AS brand, coalesce(c.price, o.price) AS price, coalesce(floor(c.price * 1.35::DOUBLE + 0.5)::BIGINT, o.retail) AS retail, coalesce(c.stock, o.stock) AS stock FROM o FULL JOIN (SELECT * FROM c WHERE status <> 'error') c ON upper(o.code) = upper(c.code)")
def dml08_import(spark, sf_dir):
    """The catalogue after an import: known codes are updated, others are added; a row known by its name only is added too."""
    return merging.imported(old_products(spark, sf_dir), classified(spark, sf_dir))


@query(_CLASS + " SELECT count(*) AS total, count_if(status = 'new') AS new, count_if(status = 'update') AS updated, count_if(status = 'error') AS errors FROM c")
def agg11_import_report(spark, sf_dir):
    number = lambda s: F.count_if(F.col("status") == s)
    return classified(spark, sf_dir).agg(F.count("*").alias("total"), number("new").alias("new"), number("update").alias("updated"), number("error").alias("errors"))


@query(_CLASS + " SELECT count(*) AS total, count_if(status = 'new')::BIGINT AS new, count_if(status = 'update')::BIGINT AS updated, count_if(status = 'error')::BIGINT AS errors, count_if(status <> 'error')::BIGINT AS written FROM c")
def agg11_report_of_write(spark, sf_dir):
    """Files are classified and written; the report comes with the write, which is the only pass."""
    rows = merging.classified(imported_files(spark, import_files(spark, sf_dir)), old_products(spark, sf_dir))
    number = lambda name, s: F.count_if(F.col("status") == s).alias(name)
    written, report = stored_counted(rows, F.count("*").alias("total"), number("new", "new"), number("updated", "update"), number("errors", "error"))
    told = [F.lit(report[n]).cast("long").alias(n) for n in ("total", "new", "updated", "errors")]
    return written.where("status <> 'error'").agg(F.count("*").alias("written")).select(*told, "written")


_INDEX = "WITH i AS (SELECT page_id, url AS image, substr(sha256(html), 1, 16) AS hash FROM pages), k AS (SELECT image, CASE WHEN page_id % 5 = 0 THEN 'older' ELSE hash END AS hash, page_id % 7 > 0 AS signed FROM i WHERE page_id % 3 > 0)"


def images_and_index(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("image"), readers.content_hash("html").alias("hash"))
    index = pages.where("page_id % 3 > 0").select("image", F.when(F.col("page_id") % 5 == 0, "older").otherwise(F.col("hash")).alias("hash"), (F.col("page_id") % 7 > 0).alias("signed"))
    return pages, index


@query(_INDEX + " SELECT page_id FROM i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.image = i.image AND k.hash = i.hash AND signed)")
def dml09_incremental_index(spark, sf_dir):
    """Images to be indexed anew: new ones, changed ones and those without signatures."""
    pages, index = images_and_index(spark, sf_dir)
    kept = index.where("signed").groupBy("image", "hash").agg(F.lit(True).alias("signed"))
    return pages.join(kept, ["image", "hash"], "left_anti").select("page_id")


@query(_INDEX + " SELECT image, hash, 'kept' AS how FROM k WHERE image IN (SELECT image FROM i WHERE page_id % 2 = 0) AND image NOT IN (SELECT image FROM i WHERE page_id = 4) UNION ALL SELECT image, hash, 'new' FROM i WHERE page_id = 4")
def dml10_reindex_one(spark, sf_dir):
    """One image's entry is made anew, those of images that still exist stay."""
    pages, index = images_and_index(spark, sf_dir)
    one = pages.where("page_id = 4").select("image", "hash", F.lit("new").alias("how"))
    left = index.join(pages.where("page_id % 2 = 0").select("image"), "image", "left_semi").select("image", "hash", F.lit("kept").alias("how"))
    return left.join(one.select("image"), "image", "left_anti").unionByName(one)


@query("WITH k AS (SELECT c_custkey, 'kept' AS how FROM customer WHERE c_custkey % 3 > 0) SELECT c_custkey, CASE WHEN c_custkey % 40 = 1 THEN 'again' ELSE how END AS how FROM k WHERE c_custkey % 90 <> 2 UNION ALL SELECT c_custkey, 'added' FROM customer WHERE c_custkey % 30 = 0 AND c_custkey NOT IN (SELECT c_custkey FROM k)")
def dml10_entries_changed(spark, sf_dir):
    """In a stored index some entries are removed, some made again, and images are added where there is no entry yet."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    index = PartedTable(spark, new_path(spark), "c_custkey").create(rows.where("c_custkey % 3 > 0").withColumn("how", F.lit("kept")))
    index.delete(F.col("c_custkey") % 90 == 2)
    index.upsert(rows.where("c_custkey % 40 = 1 and c_custkey % 3 > 0 and c_custkey % 90 <> 2").withColumn("how", F.lit("again")))
    index.insert_absent(rows.where("c_custkey % 30 = 0 or c_custkey % 40 = 1 and c_custkey % 3 > 0 and c_custkey % 90 <> 2").withColumn("how", F.lit("added")))
    return index.read()


@query("SELECT CASE WHEN min(version) < 7 THEN 'rebuild' WHEN count(*) < expected THEN 'resume' ELSE 'valid' END AS state, product FROM (SELECT vec_id % 9 AS product, CASE WHEN vec_id = 4 THEN 6 ELSE 7 END AS version, 500 // 9 + 1 AS expected FROM embeddings) GROUP BY product, expected")
def dml11_index_validity(spark, sf_dir):
    """Entries of an older format mean a rebuild, too few of them a resumed build."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 9).alias("product"), F.when(F.col("vec_id") == 4, 6).otherwise(7).alias("version"))
    state = F.when(F.min("version") < 7, "rebuild").when(F.count("*") < 500 // 9 + 1, "resume").otherwise("valid")
    return rows.groupBy("product").agg(state.alias("state"))


@query("SELECT l_partkey, count(*) AS entries, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) THEN 'kept' ELSE 'gone' END AS fate FROM lineitem GROUP BY l_partkey")
def dml12_collect_garbage(spark, sf_dir):
    """Index entries of products that left the catalogue go."""
    entries, live = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    told = lambda how, fate: entries.join(live, "l_partkey", how).groupBy("l_partkey").agg(F.count("*").alias("entries")).withColumn("fate", F.lit(fate))
    return told("left_semi", "kept").unionByName(told("left_anti", "gone"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def dml13_register_if_absent(spark, sf_dir):
    rows = customers(spark, sf_dir, "c_custkey", "c_name")
    old = rows.where("c_custkey % 2 = 0")
    wanted = rows.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"))
    return old.unionByName(merging.absent(old, wanted, "c_custkey"))


@query("SELECT c_custkey, 'approved' AS status, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 7000000 END, CASE n_regionkey WHEN 0 THEN NULL ELSE n_regionkey * 20000000 END, 50000000)::BIGINT AS credit FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dml14_approve_with_grade(spark, sf_dir):
    """The limit given, else that of the grade, else the default."""
    grade = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.nullif(F.col("n_regionkey") * 20000000, F.lit(0)).alias("limit"))
    given = F.when(F.col("c_custkey") % 5 == 0, 7000000)
    both = customers(spark, sf_dir, "c_custkey", "c_nationkey").join(grade, "c_nationkey", "left")
    return both.select("c_custkey", F.lit("approved").alias("status"), F.coalesce(given, "limit", F.lit(50000000)).cast("long").alias("credit"))


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN s_acctbal > 0 THEN 'D-' || lpad(s_suppkey::VARCHAR, 5, '0') END AS dealer FROM supplier")
def dml15_agency_approval(spark, sf_dir):
    """Applications are approved, which makes a dealer, or rejected."""
    ok = F.col("s_acctbal") > 0
    dealer = F.when(ok, F.concat(F.lit("D-"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(ok, "approved").otherwise("rejected").alias("status"), dealer.alias("dealer"))


@query("SELECT o_orderkey, coalesce(CASE CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' WHEN 'P' THEN 'part' END, '-') AS label FROM orders")
def dml16_status_labels(spark, sf_dir):
    labels = F.create_map(*(F.lit(x) for x in ("O", "open", "F", "done", "P", "part")))
    status = merging.changed_when(F.col("o_orderstatus"), F.col("o_orderkey") % 4 == 0, F.lit("X"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.try_element_at(labels, status), F.lit("-")).alias("label"))


@query("SELECT n_nationkey, row_number() OVER (ORDER BY CASE n_nationkey WHEN 9 THEN 1 WHEN 3 THEN 2 WHEN 20 THEN 3 ELSE 9 END, n_nationkey)::INT AS ord FROM nation")
def dml17_reorder(spark, sf_dir):
    """The keys listed first, in their order; the rest behind them."""
    listed = table(spark, sf_dir, "nation").where("n_nationkey in (9, 3, 20)").select("n_nationkey", F.array_position(F.array(F.lit(9), F.lit(3), F.lit(20)), F.col("n_nationkey")).alias("place"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("ord"))
    return merging.reordered(rows, listed, "n_nationkey")


@query("SELECT l_orderkey, l_partkey, sum(q)::DOUBLE AS quantity FROM (SELECT l_orderkey, l_partkey, l_quantity::DECIMAL(18,2) AS q FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, l_partkey, CASE WHEN l_quantity > 40 THEN -1000 ELSE l_quantity END::DECIMAL(18,2) FROM lineitem WHERE l_linestatus <> 'O' OR l_linenumber = 1) GROUP BY ALL HAVING sum(q) > 0")
def dml18_cart_merge(spark, sf_dir):
    """Adding what is there adds up; what falls to zero goes."""
    lines = table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("decimal(18,2)"))
    more = lines.where("l_linestatus <> 'O' or l_linenumber = 1").withColumn("quantity", F.when(F.col("l_quantity") > 40, F.lit(-1000)).otherwise(F.col("quantity")).cast("decimal(18,2)"))
    merged = merging.merged_quantities(lines.where("l_linestatus = 'O'"), more, ["l_orderkey", "l_partkey"], "quantity")
    return merged.withColumn("quantity", F.col("quantity").cast("double"))


@query("SELECT o_orderkey, count(*) AS items, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total, floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / 1000)::BIGINT AS points, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS snapshot FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderkey")
def dml19_place_order(spark, sf_dir):
    """What an order keeps of its cart: the items as they were, total and points. A cart's size bounds the list."""
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    lines = open_.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    items = F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",")
    return lines.groupBy("o_orderkey").agg(F.count("*").alias("items"), total.alias("total"), F.floor(total / 1000).alias("points"), items.alias("snapshot"))


@query("SELECT o_custkey, o_orderkey, k = 1 AS is_default FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS j FROM orders) WHERE j > 1)")
def dml21_default_address(spark, sf_dir):
    """A customer's default goes; the next one becomes the default."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    first = rows.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    left = rows.join(first, ["o_custkey", "o_orderkey"], "left_anti")
    second = left.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("chosen"))
    return left.join(second, "o_custkey").select("o_custkey", "o_orderkey", (F.col("o_orderkey") == F.col("chosen")).alias("is_default"))


@query("SELECT s_suppkey, 'request' AS kind, -s_suppkey AS ord FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey, 'deposit', s_suppkey FROM supplier")
def dml22_appends(spark, sf_dir):
    """Requests stand before the log, deposits behind it."""
    s = table(spark, sf_dir, "supplier")
    front = s.where("s_acctbal < 0").select("s_suppkey", F.lit("request").alias("kind"), F.negate("s_suppkey").alias("ord"))
    return front.union(s.select("s_suppkey", F.lit("deposit"), "s_suppkey"))


@query("SELECT n_nationkey, c_custkey AS recipient, 'note to ' || n_name AS message FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def dml23_message_fan_out(spark, sf_dir):
    """One message to a list of recipients becomes a row for each."""
    customers_ = customers(spark, sf_dir, "c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    notes = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey", F.concat(F.lit("note to "), "n_name").alias("message"))
    return notes.join(customers_, "n_nationkey").select("n_nationkey", F.col("c_custkey").alias("recipient"), "message")


_LINES = "SELECT l_orderkey, row_number() OVER w AS line, coalesce(nullif(l_quantity, 1), 2) AS quantity, CASE WHEN l_discount = 0 THEN 100 ELSE l_extendedprice END AS price FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"


@query(f"SELECT l_orderkey, line, quantity, price, floor(quantity * price * 0.1::DOUBLE + 0.5) AS tax FROM ({_LINES})")
def biz12_invoice_lines(spark, sf_dir):
    """Numbered lines, with defaults for what is missing, and a tenth of tax."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    quantity = falsy(F.nullif("l_quantity", F.lit(1.0)), F.lit(2.0))
    price = F.when(F.col("l_discount") == 0, 100.0).otherwise(F.col("l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(own).alias("line"), quantity.alias("quantity"), price.alias("price"))
    return rows.withColumn("tax", half_up(F.col("quantity") * F.col("price") * F.lit(0.1)).cast("double"))
