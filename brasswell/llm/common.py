"""Helpers shared by the corpus operators: bounded chunks of rows, shared-folder tables, digests."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task, in bytes; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, with strokes behind it as long as a column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sheltered(docs: DataFrame, *own: str) -> DataFrame:
    """The named columns, and all others under numbers, so that no working column clashes with them; restored() gives the names back."""
    return docs.select(*own, *(F.col(f"`{c}`").alias(f"column {i}") for i, c in enumerate(docs.columns) if c not in own))


def restored(docs: DataFrame, *own: str) -> list:
    """The columns of docs as sheltered() left them, under their names and in their order."""
    return [F.col(c) if c in own else F.col(f"`column {i}`").alias(c) for i, c in enumerate(docs.columns)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the named string column of each holds about ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.concatenate(([0], np.cumsum(sizes)[:-1])) // limit if len(sizes) else sizes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings; null counts as the empty text."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a session in one process gets a folder of its own; a cluster has to name one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


class Scratch:
    """Tables in the shared folder, by name: lineage ends there and survives lost executors. A new table of a name replaces the one before it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """The rows, written as Parquet and read again; what df reads under the same name is deleted afterwards."""
        path = f"{shared_dir(self.spark)}/brasswell-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for path in [self.paths.pop(n) for n in names if n in self.paths]:
            jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again."""
    return Scratch(df.sparkSession).keep("only", df)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text, as the folds of the contracts take it; of a null id, of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
