"""Exact nearest vectors that looks at few of them: rows lie in cells around pivots, and a cell that cannot hold a better row is not visited.

A row v of a cell with pivot p and radius r has q.v = q.p + q.(v - p) <= q.p + |q| r, for vectors of any length. The first pass searches each query's most
promising cells until they hold as many rows as are asked for; the worst of those rows is a floor. The second searches only cells whose bound reaches the floor.
Which rows are pivots decides the cost, never the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasswell.sources.storage import stored

#: Pivots at most: with 512 dimensions, 8 MB in each task.
PIVOTS = 2048
#: Rows of a cell, and queries that visit it, in a block, by expectation.
BLOCK = 1000
#: Similarities are told to nine places, so bounds that fall short of a floor by less than this count as reaching it.
SLACK = 2e-9


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most BLOCK rows, so that a slice times all pivots stays a small matrix."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            yield batch.slice(i, BLOCK)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


class Cells:
    """Rows (product, vec_id, vector) dealt to pivots and written in the shared folder once, for any number of searches. Rows without an id or a
    vector of ``dim`` finite components take no part."""

    def __init__(self, vectors: DataFrame, dim: int, pivots: int | None = None) -> None:
        usable = _usable(vectors.select("product", "vec_id", "vector"), "vec_id", "vector", dim)
        wanted = pivots or min(PIVOTS, int(usable.count() ** 0.5) + 1)
        picked = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()  # PIVOTS at most
        self.dim, self.pivots = dim, np.array([r["vector"] for r in picked], dtype=float).reshape(-1, dim)
        points, own = self.pivots, (self.pivots**2).sum(axis=1)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _cut(batches):
                v = _rows(batch.column("vector"), dim)
                cell = (own - 2 * (v @ points.T)).argmin(axis=1) if len(points) else np.zeros(0, int)
                apart = np.sqrt(((v - points[cell]) ** 2).sum(axis=1)) if len(points) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(apart)], ["product", "vec_id", "vector", "cell", "apart"])

        self.rows = stored(usable.mapInArrow(deal, "product long, vec_id long, vector array<double>, cell int, apart double"))
        sizes = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("r")).collect()  # one for each pivot
        self.sizes, self.radius = np.zeros(len(points), int), np.zeros(len(points))
        for r in sizes:
            self.sizes[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"]

    def _visits(self, asked: DataFrame, most: int, floors: bool) -> DataFrame:
        """query, asked, cell to be searched: the most promising ones that hold ``most`` rows; with floors, the others whose bound reaches a query's floor."""
        points, radius, sizes, dim = self.pivots, self.radius, self.sizes, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _cut(batches):
                q = _rows(batch.column("asked"), dim)
                bound = q @ points.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius * (1 + 1e-12)
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, held - sizes[order] < most, axis=1)
                if floors:
                    floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(float)
                    first = ~first & (bound >= floor[:, None] - SLACK)
                at, cell = np.nonzero(first & (sizes > 0))
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(at)), batch.column("asked").take(pa.array(at)), pa.array(cell, pa.int32())], ["query", "asked", "cell"])

        columns = ["query", "asked", *(["floor"] if floors else [])]
        return asked.select(*columns).mapInArrow(run, "query long, asked array<double>, cell int")

    def _searched(self, visits: DataFrame, most: int) -> DataFrame:
        """query, vec_id, product, similarity: the best ``most`` of each visit or block of it. Cells and the queries that visit them are cut into blocks; a pair of blocks is
        one matrix product, so a hot cell is many tasks' work."""
        dim = self.dim
        queries = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        rows = self.rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        sizes = queries.join(rows, "cell")  # at most a row for each pivot
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        left = self.rows.join(sizes, "cell").withColumn("part", dealt("vec_id", "parts")).groupBy("cell", "part", "blocks")
        left = left.agg(F.collect_list(F.struct("product", "vec_id", "vector")).alias("x")).select("cell", "part", numbers("blocks").alias("block"), F.col("x.product").alias("product"), F.col("x.vec_id").alias("vec_id"), F.flatten("x.vector").alias("vector"))
        right = visits.join(sizes, "cell").withColumn("block", dealt("query", "blocks")).groupBy("cell", "block", "parts")
        right = right.agg(F.collect_list(F.struct("query", "asked")).alias("y")).select("cell", "block", numbers("parts").alias("part"), F.col("y.query").alias("query"), F.flatten("y.asked").alias("asked"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = {c: batch.column(c)[i].values for c in batch.schema.names}
                    ids, query = one["vec_id"].to_numpy(), one["query"].to_numpy()
                    s = np.round(one["asked"].to_numpy().reshape(-1, dim) @ one["vector"].to_numpy().reshape(-1, dim).T, 9)
                    k = min(most, len(ids))
                    at = np.stack([np.lexsort((ids, -r))[:k] for r in s])
                    row = np.repeat(np.arange(len(s)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(query[row]), pa.array(ids[at.ravel()]), one["product"].take(pa.array(at.ravel())), pa.array(s[row, at.ravel()])], ["query", "vec_id", "product", "similarity"])

        both = left.join(right, ["cell", "block", "part"]).select("product", "vec_id", "vector", "query", "asked")
        return both.mapInArrow(run, "query long, vec_id long, product long, similarity double")

    def nearest(self, asked: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        """query, vec_id, product, similarity, rank of the ``most`` best rows of each query (query, asked), the smaller id among equals; and, for the
        report, a frame (query, visited, rows) of how many rows each query met of how many. Queries without an id or a whole vector find nothing; ids name queries."""
        usable = stored(_usable(asked.select("query", "asked"), "query", "asked", self.dim))
        first = stored(self._visits(usable, most, False))
        found = stored(_best(self._searched(first, most), most))
        floor = found.groupBy("query").agg(F.when(F.count("*") >= most, F.min("similarity")).otherwise(F.lit(float("-inf"))).alias("floor"))
        second = stored(self._visits(usable.join(floor, "query"), most, True))
        best = _best(found.drop("rank").union(self._searched(second, most)), most)
        held = self.rows.groupBy("cell").agg(F.count("*").alias("n"))
        visited = first.select("query", "cell").union(second.select("query", "cell")).join(held, "cell").groupBy("query").agg(F.sum("n").alias("visited"))
        return best, visited.withColumn("rows", F.lit(int(self.sizes.sum())))


def _usable(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.withColumn(vector, v).where(F.col(key).isNotNull() & (F.size(vector) == dim) & finite)


def _best(found: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)
