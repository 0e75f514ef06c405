"""Lines of text files with their numbers, for files that many tasks read.

Spark reads a large file in blocks and tells each line's file and block. Lines stand in order inside a block, so their places there follow from rising ids; counts of
blocks are added up over a file, and no file passes through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brasswell.functions.text import digits
from brasswell.sources.storage import stored


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), text of the lines of all files there, trimmed and without blank ones, which have no numbers. The lines are written once in the shared folder,
    as ids must not change between the counts and the numbers."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    told = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), bare(F.col("value")).alias("text"))
    lines = stored(told.where("text <> ''"))
    # A block is read whole by one task, whose ids rise; gaps between them are blank lines.
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    placed = lines.withColumn("place", place)
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row for each block that is read
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", ahead.alias("ahead"))
    return placed.join(starts, ["file", "block"]).select("file", (F.col("ahead") + F.col("place") - 1).alias("line"), "text")


def import_cells(lines: DataFrame) -> DataFrame:
    """row_number, code, name, brand, category, price, stock of import lines (line, text): line 0 is the head; cells split at every comma, outer quotes gone; rows
    of fewer than three cells are skipped but counted; numbers are all digits of their cells; an empty brand or category stays empty."""
    cells = F.transform(F.split("text", ","), lambda c: F.regexp_replace(bare(c), '^"|"$', ""))
    split = lines.where("line > 0").select(F.col("line").cast("int").alias("row_number"), cells.alias("c")).where("size(c) >= 3")
    cell = lambda k: F.coalesce(F.get("c", F.lit(k)), F.lit(""))
    return split.select("row_number", *(cell(k).alias(n) for k, n in enumerate(("code", "name", "brand", "category"))), digits(cell(4)).alias("price"), digits(cell(5)).alias("stock"))


def imported_files(spark: SparkSession, path: str) -> DataFrame:
    """import_cells() of all files of a folder; each has its own head."""
    return import_cells(numbered_lines(spark, path))
