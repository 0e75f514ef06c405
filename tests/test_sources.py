"""Files, stored tables and streams that the queries can't show on the given tables."""

import json

from pyspark.sql import functions as F

from brasswell.functions.codec import decode_bytes, encode_bytes
from brasswell.functions.text import first_object, natural, padded_names, price_text
from brasswell.operators import merging
from brasswell.operators.ranking import numbered
from brasswell.operators.vectors import best_per_product, nearest
from brasswell.sources import readers, storage
from brasswell.streaming.watch import Index, watch


def test_products_of_a_file_and_of_no_file(spark, tmp_path):
    records = [{"code": "1", "name": " a ", "price": 5, "specs": [{"key": "k", "value": "v"}, {"key": "m", "value": "w"}]}, {"code": "AT-2", "name": "b"}, {"name": "no code"}]
    (tmp_path / "p.json").write_text(json.dumps(records, indent=1))
    rows = {r.code: r for r in readers.products_file(spark, str(tmp_path / "p.json")).collect()}
    assert set(rows) == {"1", "AT-2"} and rows["1"].sku == "AT-1" and rows["1"].name == "a" and rows["1"].specs == "k: v | m: w"
    assert rows["AT-2"].price == 0 and rows["AT-2"].stock == 0 and rows["AT-2"].inquiry_only and rows["AT-2"].specs == ""
    assert readers.products_file(spark, str(tmp_path / "none.json")).count() == 0


def test_import_text_by_its_own_rules(spark):
    text = 'code,name,brand,category,price,stock\n\n  a-1 , "first" ,b,c,"12.5",-5\r\nx,y\nb-2,second,,,0,3\n,third,b,c,7,1\nA-1,again,b,c,1 000,2,extra'
    rows = readers.import_rows(spark.createDataFrame([(text,)], "value string"))
    got = [(r.row_number, r.code, r.name, r.price, r.stock) for r in rows.orderBy("row_number").collect()]
    assert got == [(1, "a-1", "first", 125, 5), (3, "b-2", "second", 0, 3), (4, "", "third", 7, 1), (5, "A-1", "again", 1000, 2)]
    old = spark.createDataFrame([("Q", "third", "z", 1, 1, 1), ("A-1", "was", "z", 1, 1, 1)], "code string, name string, brand string, price long, retail long, stock long")
    status = {r.row_number: r.status for r in merging.classified(rows, old).collect()}
    assert status == {1: "update", 3: "error", 4: "error", 5: "update"}
    new = {r.code: r for r in merging.imported(old, merging.classified(rows, old)).collect()}
    assert set(new) == {"Q", "A-1"} and new["A-1"].name == "again" and new["A-1"].retail == 1350 and new["Q"].price == 1


def test_image_folder_and_names(spark, tmp_path):
    for name in ("e(7).jpg", "plain.png"):
        (tmp_path / name).write_bytes(name.encode())
    files = readers.image_files(spark, str(tmp_path))
    assert {r.name: len(r.hash) for r in files.collect()} == {"e(7).jpg": 16, "plain.png": 16}
    assert {(r.alias, r.name) for r in readers.name_aliases(files).collect()} == {(a, "e(7).jpg") for a in ("e(7).jpg", "e(07).jpg", "e(007).jpg")} | {("plain.png", "plain.png")}
    one = spark.range(1)
    assert one.select(padded_names(F.lit("e(012).jpg"))).first()[0] == ["e(012).jpg", "e(12).jpg"]
    assert one.select(first_object(F.lit("a ```json {\"x\": {}} ``` b")), price_text(F.lit(0)), natural(F.lit("a10")) > natural(F.lit("a9"))).first()[1:] == ("ask for the price", True)


def test_stored_tables_are_replaced_whole(spark):
    path = storage.new_path(spark)
    storage.stored(spark.range(5), path)
    assert storage.stored(spark.range(2), path).count() == 2
    assert readers.read_or(spark, path + "-none", spark.range(3)).count() == 3


def test_changes_are_idempotent_and_keep_places(spark):
    old = spark.createDataFrame([(k, f"n{k}", k) for k in range(4)], "k long, name string, ord long")
    new = spark.createDataFrame([(2, "two", 1), (9, "nine", 2), (8, "eight", 3)], "k long, name string, ord long")
    once = merging.placed(old, new, "k")
    names = lambda df: [r.name for r in df.orderBy("ord").collect()]
    assert names(once) == ["nine", "eight", "n0", "n1", "two", "n3"] == names(merging.placed(once, new, "k"))
    assert names(merging.placed(old, new, "k", first=False)) == ["n0", "n1", "two", "n3", "nine", "eight"]
    assert merging.upserted(merging.upserted(old, new, "k"), new, "k").count() == 6


def test_numbered_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k")).repartition(5)
    got = [(r.k, r.place) for r in numbered(rows, "k", "place").collect()]
    assert sorted(got) == [(k, i + 1) for i, k in enumerate(sorted(k for k, _ in got))]
    assert numbered(rows.limit(0), "k", "place").count() == 0


def test_codec_and_search_with_ties_and_dimensions(spark):
    v = spark.createDataFrame([(0, 1, [1.0, -1.0, 0.5]), (1, 1, [1.0, -1.0, 0.5]), (2, 2, [0.0, 1.0, 0.0]), (3, 2, [1.0, 0.0])], "vec_id long, product long, vector array<double>")
    back = v.select("vec_id", decode_bytes(encode_bytes(F.col("vector"))).alias("b")).where("vec_id = 0").first().b
    assert [round(x, 3) for x in back] == [1.0, -1.0, 0.504]
    asked = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, [0.0, 3.0])], "query long, asked array<double>")
    assert {(r.query, r.product, r.vec_id) for r in best_per_product(v, asked).collect()} == {(7, 1, 0), (7, 2, 2), (8, 2, 3)}
    assert [(r.vec_id, r["rank"]) for r in nearest(v, asked.where("query = 7"), 2).orderBy("rank").collect()] == [(0, 1), (1, 2)]


def test_watched_folder_goes_on_where_it_was(spark, tmp_path):
    schema = "image string, hash string"
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    index = Index(spark, spark.createDataFrame([("a", "1", True, "kept"), ("gone", "1", True, "kept")], schema + ", signed boolean, how string"))
    images = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    put([("a", "1"), ("b", "1")], "one")
    watch(images(), index, str(tmp_path / "state"))
    put([("a", "2")], "two")
    watch(images(), index, str(tmp_path / "state"))
    index.collect_garbage(spark.createDataFrame([("a", "2"), ("b", "1")], schema))
    assert {(r.image, r.hash, r.how) for r in index.read().collect()} == {("a", "2", "new"), ("b", "1", "new")}
