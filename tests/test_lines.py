"""Numbers of lines over blocks of files, and counts that come with a write."""

import pytest
from pyspark.sql import functions as F

from brasswell.sources.lines import imported_files, numbered_lines
from brasswell.sources.storage import stored_counted


@pytest.mark.parametrize("block", [64, 1000, 1 << 27])
def test_lines_keep_their_numbers_over_blocks(spark, tmp_path, block):
    texts = {"a.csv": "\n".join(f"line {i} " + "x" * (i % 90) if i % 6 else " \t" for i in range(400)), "b.csv": "one\r\n\r\n two \r\nthree", "c.csv": "", "d.csv": "\n\n" + "y" * 3000 + "\nlast\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        found = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted((name, i, t) for name, text in texts.items() for i, t in enumerate(x.strip() for x in text.split("\n") if x.strip()))
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"], r["text"]) for r in found) == want


def test_cells_of_import_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text('code,name\n\nA1, "Tap, x" ,B,C,"1,5"\nx,y\n "A2",n,,,12.5 t,-3\n')
    rows = sorted(tuple(r) for r in imported_files(spark, str(tmp_path)).collect())
    assert rows == [(1, "A1", "Tap", 'x', "B", 0, 1), (3, "A2", "n", "", "", 125, 3)]


def test_counts_come_with_the_write(spark):
    df = spark.range(100, numPartitions=7).withColumn("odd", F.col("id") % 2 == 1)
    rows, counted = stored_counted(df, F.count("*").alias("n"), F.count_if("odd").alias("odd"))
    assert counted == {"n": 100, "odd": 50} and rows.count() == 100
    rows, counted = stored_counted(df.where("false"), F.count("*").alias("n"))
    assert counted == {"n": 0} and rows.count() == 0
