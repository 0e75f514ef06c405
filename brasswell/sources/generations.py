"""Stored tables that change: whole generations behind a log that survives the driver, and tables in parts of which a change writes only those it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.operators.ranking import newest

#: Parts of a table by a hash of its key.
PARTS = 64
#: Generations that stay readable.
KEPT = 2


class Files:
    """The few calls on the shared file system that commits need."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.system = self.hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.hadoop.Path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(at)) if self.system.exists(at) else []

    def put(self, path: str, text: str) -> bool:
        """Writes a small file whole, under a name that nobody had before; False if somebody had it."""
        early = self.hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self.system.create(early)
        out.write(bytearray(text.encode()))
        out.close()
        if self.system.exists(self.hadoop.Path(path)) or not self.system.rename(early, self.hadoop.Path(path)):
            self.system.delete(early, False)
            return False
        return True

    def text(self, path: str) -> str:
        stream = self.system.open(self.hadoop.Path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.system.delete(self.hadoop.Path(path), True)


class Generations:
    """A table under ``root`` that each commit replaces whole. A generation is written first and counts once its log entry stands under the next number; the entry
    names the last batch of each stream that is in it, so a batch that a restarted stream brings again changes nothing. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _last(self) -> dict | None:
        numbers = [n for n in self.files.names(f"{self.root}/log") if n.isdigit()]
        return json.loads(self.files.text(f"{self.root}/log/{numbers[-1]}")) if numbers else None

    def read(self, empty: DataFrame) -> DataFrame:
        """The newest generation; the empty table before the first."""
        last = self._last()
        return self.spark.read.schema(empty.schema).parquet(last["path"]) if last else empty

    def done(self, stream: str, batch: int) -> bool:
        last = self._last()
        return bool(last) and last["batches"].get(stream, -1) >= batch

    def commit(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        last = self._last() or {"number": 0, "batches": {}}
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        number = last["number"] + 1
        told = {"number": number, "path": path, "batches": last["batches"] | ({stream: batch} if stream is not None else {})}
        if not self.files.put(f"{self.root}/log/{number:012d}", json.dumps(told)):
            raise RuntimeError(f"somebody else wrote generation {number} of {self.root}")
        self._collect()

    def _collect(self) -> None:
        """Entries and tables before the last generations go, and tables that no entry names."""
        numbers = [n for n in self.files.names(f"{self.root}/log") if n.isdigit()]
        named = {json.loads(self.files.text(f"{self.root}/log/{n}"))["path"].rpartition("/")[2] for n in numbers[-KEPT:]}
        for n in numbers[:-KEPT]:
            self.files.delete(f"{self.root}/log/{n}")
        for name in self.files.names(f"{self.root}/data"):
            if name not in named:
                self.files.delete(f"{self.root}/data/{name}")


class PartedTable:
    """A stored table in ``PARTS`` folders by a hash of its key. A change rewrites the folders that hold rows it touches (dynamic partition overwrite) and
    leaves all other files alone; a folder whose rows all go is deleted. A change that fails leaves each folder old or new, and may be made again."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    def _parted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_part", F.pmod(F.xxhash64(F.col(self.key)), F.lit(PARTS)).cast("int"))

    def create(self, rows: DataFrame) -> PartedTable:
        self._parted(rows).repartition("_part").write.partitionBy("_part").parquet(self.path)
        self.schema = rows.schema
        return self

    def _rows(self) -> DataFrame:
        parted = self._parted(self.spark.createDataFrame([], self.schema))
        return self.spark.read.schema(parted.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop("_part")

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(self.path)

    def delete(self, gone: Column) -> int:
        """Deletes the rows for which the condition holds; how many went."""
        counts = self._rows().groupBy("_part").agg(F.count("*").alias("n"), F.count_if(gone).alias("gone")).where("gone > 0").collect()  # PARTS at most
        some = [r["_part"] for r in counts if r["gone"] < r["n"]]
        if some:
            self._write(self._rows().where(F.col("_part").isin(some) & ~F.coalesce(gone, F.lit(False))))
        files = Files(self.spark, self.path)
        for r in counts:
            if r["gone"] == r["n"]:
                files.delete(f"{self.path}/_part={r['_part']}")
        return sum(r["gone"] for r in counts)

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """merge(stored, rows), applied to the parts that the rows' keys lie in."""
        parted = self._parted(rows.select(*self.schema.names))
        some = [r["_part"] for r in parted.select("_part").distinct().collect()]  # PARTS at most
        if some:
            self._write(self._parted(merge(self._rows().where(F.col("_part").isin(some)).drop("_part"), parted.drop("_part"))))

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of their key; the rows' keys are distinct."""
        self.change(rows, lambda old, new: old.join(new, self.key, "left_anti").unionByName(new))

    def insert_absent(self, rows: DataFrame) -> None:
        """Rows whose key isn't there are added; the rows' keys are distinct."""
        self.change(rows, lambda old, new: old.unionByName(new.join(old, self.key, "left_anti")))


def append_newest(log: Generations, rows: DataFrame, order: list[Column], most: int) -> None:
    """A stored log gets more rows and keeps its newest: the next generation holds at most so many."""
    log.commit(newest(log.read(rows.where("false")).unionByName(rows), order, most))
