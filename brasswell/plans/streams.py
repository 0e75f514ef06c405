"""Streaming queries, each beside the SQL of what they have when all input is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasswell.plans.registry import query, table
from brasswell.sources.storage import new_path, stored
from brasswell.streaming.watch import Index, watch

_HASH = "substr(sha256(p_name || p_brand), 1, 16)"


@query(f"SELECT p_partkey::VARCHAR AS image, {_HASH} AS hash, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 > 0 THEN 'kept' ELSE 'new' END AS how FROM part")
def stm01_watched_catalogue(spark, sf_dir):
    """The index starts with a third of the products, some with an older hash, and some that left; files of the catalogue come as a stream."""
    part = table(spark, sf_dir, "part")
    image, digest = F.col("p_partkey").cast("string").alias("image"), F.substr(F.sha2(F.concat("p_name", "p_brand"), 256), F.lit(1), F.lit(16))
    known = part.where("p_partkey % 3 = 0").select(image, F.when(F.col("p_partkey") % 5 == 0, "older").otherwise(digest).alias("hash"), F.lit(True).alias("signed"), F.lit("kept").alias("how"))
    left = part.where("p_partkey % 3 = 1").select(F.concat(F.lit("left"), "p_partkey").alias("image"), digest.alias("hash"), F.lit(True).alias("signed"), F.lit("kept").alias("how"))
    index, checkpoint, landed = Index(spark, known.union(left)), new_path(spark), new_path(spark)
    stored(part, landed)
    images = spark.readStream.schema(part.schema).parquet(landed).select(image, digest.alias("hash"))
    watch(images, index, checkpoint)
    watch(images, index, checkpoint)  # nothing is new
    index.collect_garbage(part.select(image))
    return index.read().select("image", "hash", "how")


@query("SELECT p_type, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY p_type")
def snk05_resumed_build(spark, sf_dir):
    """A build in small batches that goes on from its checkpoint: the first part lands and is built, then the rest; no row counts twice."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    landed, built, checkpoint = new_path(spark), new_path(spark), new_path(spark)

    def build() -> None:
        rows = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{landed}/*")
        rows.writeStream.format("parquet").option("path", built).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    stored(part.where("p_partkey % 3 = 0"), f"{landed}/first")
    build()
    stored(part.where("p_partkey % 3 > 0"), f"{landed}/second")
    build()
    return spark.read.schema(part.schema).parquet(built).groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))
