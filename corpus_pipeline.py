"""The corpus pipeline: quality, near copies, benchmark passages, secrets, packing. Each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.llm import fmindex, neardup, packing, quality, secrets
from brasswell.llm.common import table, unused, written

#: Near copies here: sets of runs of so many words, alike to so many per cent (op7 has its own contract).
WIDTH, PERCENT = 5, 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labels, doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    # A filter isn't pushed below a row number: statistics are computed once, in the projection, not in the filter for each rule.
    row = unused("row", scored.columns)
    return scored.withColumn(row, F.monotonically_increasing_id()).where((F.col("predicted") == 1) & (F.col(row) >= 0)).select(*docs.columns)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Documents without an id stay."""
    gone = neardup.near_duplicates(docs, WIDTH, PERCENT).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return fmindex.cut_spans(docs, table(spark, sf_dir, "benchmark"))


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("near-dedup", single),
    ("benchmark decontamination", clean),
    ("secret scans", safe),
    ("packing", packed),
]

#: The classifier, the automaton and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
