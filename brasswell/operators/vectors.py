"""Exhaustive vector search of a stated query set against all rows, in blocks that executors form: nothing passes through the driver,
nothing is broadcast whole, and a pair of blocks is one small matrix product."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasswell.functions.hashes import once

#: Rows of either side in a block, by expectation.
BLOCK = 1000


def normalised(v: Column) -> Column:
    """The vector with length one; one of a length up to 1e-9 stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return once(norm, lambda n: F.transform(v, lambda x: F.when(n > 1e-9, x.cast("double") / n).otherwise(x.cast("double"))))


def against(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Each row beside each of the stated queries. Queries are dealt into blocks and rows into chunks, and the two meet in an equal-key
    join, so that no task holds more than a chunk of one side and a block of the other."""
    chunks, blocks = -(-rows.count() // BLOCK) or 1, -(-asked.count() // BLOCK) or 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"chunk": F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"), "block": numbers(blocks)})
    right = asked.withColumn("chunk", numbers(chunks)).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    return left.join(right, ["chunk", "block"]).drop("chunk", "block")


def _blocks(df: DataFrame, number: Column, n: int, others: int, names: list[str], mine: str, other: str) -> DataFrame:
    """One row for each block and dimension, with arrays, once for each block of the other side."""
    dealt = df.withColumns({mine: F.pmod(number, F.lit(n)).cast("int"), "dim": F.size(names[-1])})
    packed = dealt.groupBy(mine, "dim").agg(F.collect_list(F.struct(*names)).alias("x"))
    arrays = packed.select(mine, "dim", *(F.col(f"x.{c}").alias(c) for c in names[:-1]), F.flatten(F.col(f"x.{names[-1]}")).alias(names[-1]))
    return arrays.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _search(vectors: DataFrame, asked: DataFrame, pick: Callable) -> DataFrame:
    """query, product, vec_id, similarity that pick(similarities, products, ids) gives for each pair of blocks of one dimension."""
    chunks, blocks = -(-vectors.count() // BLOCK) or 1, -(-asked.count() // BLOCK) or 1
    left = _blocks(vectors.select("product", "vec_id", "vector"), F.xxhash64("vec_id"), chunks, blocks, ["product", "vec_id", "vector"], "chunk", "block")
    right = _blocks(asked.select("query", "asked"), F.xxhash64("query"), blocks, chunks, ["query", "asked"], "block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("product", "vec_id", "vector", "query", "asked")}
                order = np.lexsort((one["vec_id"], one["product"]))
                products, ids = one["product"][order], one["vec_id"][order]
                v = one["vector"].astype(float).reshape(len(ids), -1)[order]
                q = one["asked"].astype(float).reshape(len(one["query"]), -1)
                row, at, similarity = pick(np.round(q @ v.T, 9), products, ids)
                yield pa.RecordBatch.from_arrays([pa.array(one["query"][row]), pa.array(products[at]), pa.array(ids[at]), pa.array(similarity)], ["query", "product", "vec_id", "similarity"])

    both = left.join(right, ["chunk", "block", "dim"]).select("product", "vec_id", "vector", "query", "asked")
    return both.mapInArrow(run, "query long, product long, vec_id long, similarity double")


def best_per_product(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """query, product, vec_id, similarity: each product's best vector (product, vec_id, vector) for each query (query, asked) of its
    dimension, the smallest id among equals (similarities to nine places)."""

    def pick(s: np.ndarray, products: np.ndarray, ids: np.ndarray):
        starts = np.flatnonzero(np.append(True, products[1:] != products[:-1]))
        at = np.stack([a + s[:, a:b].argmax(axis=1) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)], axis=1)
        row = np.repeat(np.arange(len(s)), len(starts))
        return row, at.ravel(), s[row, at.ravel()]

    found = _search(vectors, asked, pick)
    best = found.groupBy("query", "product").agg(F.max(F.struct("similarity", F.negate("vec_id").alias("minus"))).alias("b"))
    return best.select("query", "product", F.negate("b.minus").alias("vec_id"), "b.similarity")


def nearest(vectors: DataFrame, asked: DataFrame, most: int, by: Column | None = None) -> DataFrame:
    """query, vec_id, product, similarity, rank of the ``most`` best vectors. by: what several query vectors (views) are asked as;
    a vector then counts with its best view."""

    def pick(s: np.ndarray, products: np.ndarray, ids: np.ndarray):
        k = min(most, len(ids))
        at = np.stack([np.lexsort((ids, -r))[:k] for r in s])
        row = np.repeat(np.arange(len(s)), k)
        return row, at.ravel(), s[row, at.ravel()]

    from pyspark.sql import Window

    found = _search(vectors, asked, pick)
    if by is not None:
        found = found.withColumn("query", by).groupBy("query", "vec_id", "product").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)
