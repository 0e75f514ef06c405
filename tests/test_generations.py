"""Generations behind a log, and changes that write only the parts they touch."""

import glob

from pyspark.sql import functions as F

from brasswell.sources import generations
from brasswell.sources.generations import Generations, PartedTable
from brasswell.streaming.watch import Index, watch

SCHEMA = "image string, hash string"


def test_index_survives_the_driver_between_commit_and_checkpoint(spark, tmp_path):
    put = lambda rows, name: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    seed = spark.createDataFrame([("a", "1", True, "kept"), ("z", "9", True, "kept")], SCHEMA + ", signed boolean, how string")
    images = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    root, state = str(tmp_path / "index"), str(tmp_path / "state")
    put([("a", "1"), ("b", "1")], "one")
    index = Index(spark, seed, root)

    class Lost(Exception):
        pass

    merge = index.merge

    def dies(*args):
        merge(*args)
        raise Lost

    index.merge = dies
    try:
        watch(images(), index, state)
        raise AssertionError("the stream went on")
    except Exception as e:
        assert "Lost" in str(e)
    before = index.table._last()
    del index
    index = Index(spark, seed, root)  # another driver: the seed isn't written again
    watch(images(), index, state)  # the batch comes again
    assert index.table._last() == before
    put([("b", "2")], "two")
    watch(images(), index, state)
    assert {(r.image, r.hash, r.how) for r in index.read().collect()} == {("a", "1", "kept"), ("z", "9", "kept"), ("b", "2", "new")}


def test_old_generations_go(spark, tmp_path):
    table = Generations(spark, str(tmp_path / "t"))
    assert table.read(spark.range(0)).count() == 0
    for n in range(1, 6):
        table.commit(spark.range(n))
        assert table.read(spark.range(0)).count() == n
    spark.range(3).write.parquet(str(tmp_path / "t" / "data" / "orphan"))  # of a writer that died before its log entry
    table.commit(spark.range(7))
    assert len(glob.glob(str(tmp_path / "t" / "data" / "*"))) == generations.KEPT == len(glob.glob(str(tmp_path / "t" / "log" / "[0-9]*")))
    assert not table.files.put(f"{table.root}/log/{6:012d}", "{}")


def test_changes_write_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "t")
    files = lambda: {f for f in glob.glob(f"{path}/_part=*/*.parquet")}
    table = PartedTable(spark, path, "k").create(spark.range(500).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    first = files()
    assert table.delete(F.col("k").isin(3, 4)) == 2 and table.read().count() == 498
    second = files()
    assert len(first - second) <= 2 and len(first & second) >= len(first) - 2
    assert table.delete(F.col("k") == 3) == 0 and files() == second
    table.upsert(spark.createDataFrame([(5, "new"), (900, "new")], "k long, v string"))
    table.insert_absent(spark.createDataFrame([(5, "absent"), (3, "absent")], "k long, v string"))
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 500 and got[3] == "absent" and got[5] == "new"
    assert table.delete(F.lit(True)) == 500 and table.read().count() == 0
