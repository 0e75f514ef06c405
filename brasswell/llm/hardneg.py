"""Hard-negative mining by slot-decomposed selection.

A row's score for an anchor is the integer inner product of both vectors, each component x taken as floor(256 * x). The anchor's positives are
its best other rows of the same label; for each of them the negatives are the best rows of other labels whose score lies in a window between
two shares of the positive's score.

Two passes meet all rows with all anchors, each as an equal-key join of packed chunks of rows with packed blocks of anchors; a pair of the two is
a few integer-exact matrix products, and nothing whole is broadcast or collected. The first pass keeps each chunk's best positives, which a merge
over chunks reduces. The upper limits of an anchor's positives cut all scores into disjoint slots: slot k holds the scores up to the k-th highest
limit and above the next. In the second pass each chunk keeps its best rows in each slot (the combiner), and the merge over chunks keeps
the best of a slot. The rows up to the limit of a positive are then those of its slot and of the slots below, in this order, so one ordered merge
of slot lists answers all windows, however they overlap.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows of several dimensions meet their own only. Higher scores
come first, ties by smaller id. Copies of a row (same id,
label and vector) count once; of rows with one id that differ, each takes part for itself, but none is a positive of its own id. An anchor without positives, and a positive without
rows in its window (always so below zero), give no rows. Chunks are dealt by a hash of the id, so labels and vectors that many rows share don't
gather in one. Products that don't fit 53 bits are computed as 64-bit integers; beyond that OverflowError is raised. Other columns
aren't used; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brasswell.llm.common import Scratch, table

#: Rows in a chunk and anchors in a block, by expectation; anchors that are multiplied at once.
CHUNK, BLOCK, STEP = 8192, 2048, 128
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90


def usable(rows: DataFrame, row_id: str, label: str, vector: str) -> DataFrame:
    """id, label (long) and v, the vector in whole numbers, of the rows that take part, each once."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    plain = rows.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), values.alias("v")).dropna()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return plain.where(finite).select("id", "label", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("v")).distinct()


def packed(rows: DataFrame, n: int, name: str, extra: list[str] | None = None) -> DataFrame:
    """One row for each chunk and dimension, with the rows' columns as arrays and their vectors as one."""
    columns = ["id", "label", *(extra or [])]
    dealt = rows.withColumns({name: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), "dim": F.size("v")})
    lists = dealt.groupBy(name, "dim").agg(F.array_sort(F.collect_list(F.struct(*columns, "v"))).alias("x"))
    return lists.select(name, "dim", *(F.col(f"x.{c}").alias(f"{name}_{c}") for c in columns), F.flatten(F.col("x.v")).alias(f"{name}_v"))


def beside(chunks: DataFrame, blocks: DataFrame, n_chunks: int, n_blocks: int) -> DataFrame:
    """Each chunk beside each block of its dimension."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return chunks.withColumn("block", numbers(n_blocks)).join(blocks.withColumn("chunk", numbers(n_chunks)), ["chunk", "block", "dim"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of a with those of b."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise OverflowError("the scores of these vectors don't fit 64 bits")


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest allowed scores of each row; columns are by id, so the first of equals is the smallest."""
    least = np.iinfo(np.int64).min
    held = np.where(allowed, score, least)
    if held.shape[1] > k:
        # All that reach the k-th highest score, ties included; the sort below is of those few.
        limit = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        row, column = np.nonzero(allowed & (held >= limit[:, None]))
    else:
        row, column = np.nonzero(allowed)
    order = np.lexsort((column, -held[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _pairs(both: DataFrame, extra: list[str], out: str, pick) -> DataFrame:
    """The rows that pick(anchors' columns, rows' columns, scores) gives for each step of each pair of a chunk and a block."""
    used = [*(f"chunk_{c}" for c in ("id", "label", "v")), *(f"block_{c}" for c in ("id", "label", *extra, "v"))]
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(c)[i].values for c in used}
                rows = {c: x[f"chunk_{c}"].to_numpy(zero_copy_only=False) for c in ("id", "label")}
                anchors = {c: x[f"block_{c}"].to_numpy(zero_copy_only=False) for c in ("id", "label")} | {c: x[f"block_{c}"].to_pylist() for c in extra}
                v = x["chunk_v"].to_numpy().reshape(len(rows["id"]), -1)
                q = x["block_v"].to_numpy().reshape(len(anchors["id"]), -1)
                for a in range(0, len(q), STEP):
                    some = {c: y[a : a + STEP] for c, y in anchors.items()}
                    columns = pick(some, rows, products(q[a : a + STEP], v))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return both.select(*used).mapInArrow(run, out)


def first_of(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchor: Column, row_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first ``negatives`` of each of the first ``positives`` of
    each row for which ``anchor`` (a condition on id) holds."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    vectors = scratch.keep("vectors", usable(rows, row_id, label, vector))
    n, asked = vectors.agg(F.count("*"), F.count_if(anchor)).first()
    n_chunks, n_blocks = max(1, -(-n // CHUNK)), max(1, -(-asked // BLOCK))
    chunks = scratch.keep("chunks", packed(vectors, n_chunks, "chunk"))
    # Rows of one id that differ are anchors each; key tells them apart.
    key = F.xxhash64("id", "label", "v")
    anchors = vectors.where(anchor).withColumn("key", key)

    def of_one_label(some: dict, all_rows: dict, score: np.ndarray) -> list:
        same = some["label"][:, None] == all_rows["label"][None, :]
        own = some["id"][:, None] == all_rows["id"][None, :]
        row, at = best(score, same & ~own, positives)
        return [np.array(some["key"], np.int64)[row], some["id"][row], all_rows["id"][at], score[row, at]]

    found = _pairs(beside(chunks, packed(anchors, n_blocks, "block", ["key"]), n_chunks, n_blocks), ["key"], "key long, anchor_id long, positive_id long, positive_score long", of_one_label)
    chosen = first_of(found, ["key"], [F.desc("positive_score"), F.asc("positive_id")], positives)
    # The window in whole numbers: from ceil(low * score / 100) to floor(high * score / 100).
    floor = F.ceil(F.col("positive_score").cast("decimal(20,0)") * low / 100).cast("long")
    limit = F.floor(F.col("positive_score").cast("decimal(20,0)") * high / 100).cast("long")
    windows = chosen.withColumns({"floor": floor, "limit": limit}).where("floor <= limit")
    slot = F.dense_rank().over(Window.partitionBy("key").orderBy(F.desc("limit")))
    windows = scratch.keep("windows", windows.select("key", "anchor_id", "positive_id", "positive_score", "floor", "limit", F.col("rank").alias("place"), slot.alias("slot")))
    limits = windows.groupBy("key").agg(F.array_sort(F.collect_set("limit")).alias("limits"), F.min("floor").alias("least"))

    def in_slots(some: dict, all_rows: dict, score: np.ndarray) -> list:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        other = some["label"][:, None] != all_rows["label"][None, :]
        least = np.array(some["least"], np.int64)[:, None]
        # Limits from the highest, as many for each anchor; slots that an anchor doesn't have stay empty.
        most = max(map(len, some["limits"]), default=0)
        upper = np.array([[*x[::-1], *[np.iinfo(np.int64).min] * (most - len(x))] for x in some["limits"]], np.int64).reshape(len(some["limits"]), most)
        for k in range(most):
            held = other & (score <= upper[:, k, None]) & (score >= least)
            if k + 1 < most:
                held &= score > upper[:, k + 1, None]
            row, at = best(score, held, negatives)
            for c, x in zip(out, (np.array(some["key"], np.int64)[row], np.full(len(row), k + 1, np.int64), all_rows["id"][at], score[row, at]), strict=True):
                c.append(x)
        return [np.concatenate(c) for c in out]

    asked_again = packed(anchors.join(limits, "key"), n_blocks, "block", ["key", "limits", "least"])
    in_chunks = _pairs(beside(chunks, asked_again, n_chunks, n_blocks), ["key", "limits", "least"], "key long, held long, negative_id long, negative_score long", in_slots)
    worst_last = [F.desc("negative_score"), F.asc("negative_id")]
    slots = first_of(in_chunks, ["key", "held"], worst_last, negatives).drop("rank")
    # The slots from a positive's own downwards are in order of score.
    merged = windows.join(slots, "key").where("held >= slot and negative_score >= floor")
    ranked = first_of(merged, ["key", "place"], worst_last, negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("id") % 100 == 0)


#: All rows beside all anchors.
OP13_SQL = f"""
WITH r AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor, a.label AS mine, b.id, b.label, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a, r b WHERE a.id % 100 = 0),
p AS (
  SELECT anchor, id, score FROM s WHERE mine = label AND anchor <> id
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES}),
n AS (
  SELECT p.anchor, p.id AS positive, p.score AS positive_score, s.id, s.score,
    row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND s.mine <> s.label AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM n WHERE rank <= {NEGATIVES}
"""
