"""Tables in the shared folder: written whole, read back, replaced by a later generation."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from brasswell.sources.readers import read_or


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a session in one process makes its own where none is set, a cluster has to name one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, committed as one Parquet table (readers see the whole table or none) and read again."""
    path = path or new_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame, *counts: Column) -> tuple[DataFrame, dict]:
    """stored() with counts of the rows written, taken in the same pass, without a second scan. They are taken in the stage that writes, whose tasks count once however
    often they are tried, so df's shuffles all lie before it."""
    seen = Observation()
    rows = stored(df.observe(seen, *counts))
    return rows, seen.get


def stored_version(df: DataFrame, path: str, version: int) -> DataFrame:
    """The rows as a version of a table; other versions stay where they are."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    return read_version(df.sparkSession, path, version, df.where("false"))


def read_version(spark: SparkSession, path: str, version: int, empty: DataFrame) -> DataFrame:
    """That version of a table; the empty table where only others, or none, were written. Files of other versions aren't read."""
    return read_or(spark, f"{path}/version={version}", empty)
