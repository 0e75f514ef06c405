"""Reads that the catalogue needs beside plain tables: tolerant and version-gated tables, products in JSON, import text, image folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.functions.text import digits, padded_names, sku

PRODUCT = "code string, name string, brand string, category string, price bigint, stock bigint, specs array<struct<key: string, value: string>>"


def read_or(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """The table there, or the fallback (a seed, or an empty table) where there is none."""
    try:
        return spark.read.schema(fallback.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return fallback


def products(records: DataFrame, text: str = "json") -> DataFrame:
    """Normalised products from JSON records, one in a row: code, sku, name, price and stock (0 where missing), inquiry_only, specs as text."""
    one = records.select(F.from_json(text, PRODUCT).alias("p")).select("p.*").where("code is not null")
    told = F.array_join(F.transform("specs", lambda s: F.concat_ws(": ", s["key"], s["value"])), " | ")
    price = F.coalesce("price", F.lit(0).cast("long"))
    return one.select("code", sku(F.col("code")).alias("sku"), F.trim("name").alias("name"), "brand", "category", price.alias("price"), F.coalesce("stock", F.lit(0).cast("long")).alias("stock"), (price <= 0).alias("inquiry_only"), F.coalesce(told, F.lit("")).alias("specs"))


def products_file(spark: SparkSession, path: str) -> DataFrame:
    """products() of a file that holds one JSON array; no rows where there is no file."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        whole = spark.createDataFrame([], "value string")
    each = whole.select(F.explode(F.from_json("value", f"array<struct<{PRODUCT}>>")).alias("p"))
    return products(each.select(F.to_json("p").alias("json")))


def import_rows(files: DataFrame, text: str = "value") -> DataFrame:
    """row_number, code, name, brand, category, price, stock of whole import texts: lines trimmed, blank ones dropped, the first is the head; cells
    split at every comma, outer quotes gone; rows of fewer than three cells are skipped but counted; numbers are all digits of their cells."""
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(text, "\n"), bare), lambda t: t != "")
    each = files.select(F.posexplode(lines).alias("row_number", "line")).where("row_number > 0")
    cells = F.transform(F.split("line", ","), lambda c: F.regexp_replace(bare(c), '^"|"$', ""))
    split = each.select("row_number", cells.alias("c")).where("size(c) >= 3")
    cell = lambda k: F.coalesce(F.get("c", F.lit(k)), F.lit(""))
    return split.select("row_number", cell(0).alias("code"), cell(1).alias("name"), cell(2).alias("brand"), cell(3).alias("category"), digits(cell(4)).alias("price"), digits(cell(5)).alias("stock"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name and content hash (16 hex digits) of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), content_hash("content").alias("hash"))


def content_hash(content: str):
    """The first 16 hex digits of the content's digest; empty for none."""
    return F.coalesce(F.substr(F.sha2(F.col(content).cast("binary"), 256), F.lit(1), F.lit(16)), F.lit(""))


def name_aliases(files: DataFrame, name: str = "name") -> DataFrame:
    """alias, name: each file name under all its paddings; its own spelling counts before others', then the least name."""
    each = files.select(F.col(name).alias("name"), F.explode(padded_names(F.col(name))).alias("alias"))
    best = each.groupBy("alias").agg(F.min(F.struct((F.col("alias") != F.col("name")).alias("other"), "name")).alias("b"))
    return best.select("alias", "b.name")
