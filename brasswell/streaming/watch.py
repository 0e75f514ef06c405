"""A watched catalogue: new files of product rows are merged into the index as they come, and entries of products that left are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.operators.merging import stale, upserted
from brasswell.sources.generations import Generations
from brasswell.sources.storage import new_path


class Index:
    """An index table in the shared folder, one generation after another. Columns: image, hash, signed, how. With a root that has generations, it goes on from
    the newest one, whatever became of the driver that wrote it; else it starts with the seed."""

    def __init__(self, spark: SparkSession, seed: DataFrame, root: str | None = None) -> None:
        self.table, self.empty = Generations(spark, root or new_path(spark)), seed.limit(0)
        if not self.table.done("seed", 0):
            self.table.commit(seed, "seed", 0)

    def read(self) -> DataFrame:
        return self.table.read(self.empty)

    def merge(self, images: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        """Images (image, hash) that are new or changed are indexed. A batch of a stream that is in already is left alone."""
        if stream is not None and self.table.done(stream, batch):
            return
        images = images.dropDuplicates(["image"])
        todo = stale(images, self.read()).select("image", "hash", F.lit(True).alias("signed"), F.lit("new").alias("how"))
        self.table.commit(upserted(self.read(), todo, "image").select(*self.empty.columns), stream, batch)

    def collect_garbage(self, live: DataFrame) -> None:
        """Entries whose image isn't live go."""
        self.table.commit(self.read().join(live.select("image"), "image", "left_semi").select(*self.empty.columns))


def watch(images: DataFrame, index: Index, checkpoint: str) -> None:
    """Merges all that a stream of images (image, hash) holds now. A checkpoint remembers what was merged, so each call goes on from the last; a batch that was
    merged but not yet checkpointed when the driver was lost comes again and changes nothing."""
    merged = images.writeStream.foreachBatch(lambda batch, number: index.merge(batch, checkpoint, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    merged.start().awaitTermination()
