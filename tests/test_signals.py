"""Agreement of views in blocks against all pairs, and plans in which no pair and no whole block is a row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from brasswell.operators import decisions, signals
from brasswell.plans import similarity
from brasswell.plans.registry import QUERIES

DATA = "/root/testdata/sf0.01"
#: In the order of the findings.
OF_SIGNALS = ("agg07_runner_up", "agg13_self_test", "agg14_kpis", "agg16_signal_means", "dec02_claims", "agg17_weight_sweep", "dec03_exact_guard", "flt16_candidate_gate", "flt18_response", "dec05_verdict", "ord03_best_scores", "ord09_debug_top", "rrk01_hash_similarity", "set04_two_floors", "rrk02_fusion", "strc01_structure", "win03_rank_of_true")
BLOCKS = [(250, 4000, 1 << 17), (7, 11, 64), (1, 3, 1)]


@pytest.fixture
def views(spark):
    """Rows and queries with near-duplicates, equal vectors, zeros, two lengths and null vectors; several queries a shot, some ids with two products."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = lambda k, by: (base[k % 6] + rng.normal(size=64) * by).tolist()
    rows = [(i % 5, i, near(i, (0, 1e-4, 0.01, 0.3)[i % 4])) for i in range(60)] + [(7, i, near(i, 0)) for i in range(0, 60, 6)]
    rows += [(8, 200, [0.0] * 64), (8, 201, rng.normal(size=128).tolist()), (9, 202, rng.normal(size=64).tolist()), (9, 203, None)]
    asked = [(i, near(i, (0, 1e-4, 0.02)[i % 3])) for i in range(14)] + [(20, [0.0] * 64), (21, rng.normal(size=128).tolist()), (22, None)]
    signed = lambda data, ids: spark.createDataFrame(data, f"{ids}, e array<double>").withColumn("s", similarity.signature(F.col("e")))
    return signed(rows, "product long, vec_id long").cache(), signed(asked, "query long").cache()


def pairs(views):
    """Every pair by column expressions, one by one."""
    left, right = (df.where("e is not null") for df in views)
    right = right.select("query", F.col("e").alias("q"), F.col("s").alias("t"))
    part = lambda s: {p: F.col(f"{s}.{p}") for p in similarity.PARTS}
    apart = decisions.distances("s", "t")
    l1 = F.aggregate(F.zip_with("e", "q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    far = decisions.legacy_distance(apart["dh"], apart["ph"], apart["ah"], l1).alias("far")
    return left.crossJoin(right).select("query", "product", "vec_id", similarity.comparable_dot(F.col("e"), F.col("q")).alias("dot"), decisions.structure_agreement(part("s"), part("t")).alias("structure"), *(c.alias(h) for h, c in apart.items()), far)


def same(got, want, digits=12):
    told = lambda r: tuple(round(v, digits) + 0.0 if isinstance(v, float) and math.isfinite(v) else v for v in r)
    assert sorted(map(told, got), key=str) == sorted(map(told, want), key=str) and want


@pytest.fixture(params=BLOCKS, ids=str)
def blocks(request, monkeypatch):
    for name, value in zip(("LEAST", "MOST", "TILE"), request.param, strict=True):
        monkeypatch.setattr(signals, name, value)


def test_agreements_against_all_pairs(spark, views, blocks):
    want = decisions.signals(pairs(views)).collect()
    assert sum(r["claim"] is not None for r in want) > 10
    same(signals.agreements(*views).collect(), want)


def test_bests_against_all_pairs(spark, views, blocks):
    want = pairs(views).groupBy("query", "product").agg(F.max("structure"), F.min("dh").cast("long")).collect()
    same(signals.bests(*views, ("structure", "dh")).collect(), want)


def test_legacy_against_all_pairs(spark, views, blocks):
    shot = F.floor(F.col("query") / 3)
    rows = pairs(views).groupBy(shot.alias("shot"), "vec_id", "product").agg(F.round(F.min("far"), 11).alias("d")).cache()
    assert 0 < rows.where("d < 0.2").count() < rows.count()  # the rest has the most that differences count
    same(signals.legacy(*views, shot).collect(), rows.collect(), 10)
    best = lambda df: df.groupBy("shot", "product").agg(F.min(F.struct("d", "vec_id")).alias("b")).select("shot", "product", "b.vec_id", F.round("b.d", 10)).collect()
    same(best(signals.legacy(*views, shot, by="product")), best(rows), 10)
    least = lambda df: df.groupBy("shot").agg(F.min("d")).collect()
    same(least(signals.legacy(*views, shot, by="shot")), least(rows), 10)


def test_counts_against_all_pairs(spark, views, blocks):
    left, right = (df.drop("s") for df in views)
    for floor in (0.2, 0.0):  # a zero vector's product is not over 0
        dims = left.where("e is not null").crossJoin(right.where("e is not null").select("query", F.col("e").alias("q"))).where(F.size("e") == F.size("q"))
        want = dims.groupBy("query").agg(F.count("*"), F.count_if(similarity.comparable_dot(F.col("e"), F.col("q")) > floor)).collect()
        same(signals.near_counts(left, right, floor).collect(), want)


@pytest.mark.parametrize(("products", "given"), [(3, 8000), (4000, 100)])
def test_many_products_get_smaller_blocks(spark, monkeypatch, products, given):
    """A pair of blocks gives GIVEN rows at most, by expectation: 100 x 100 where each row is a product of its own."""
    monkeypatch.setattr(signals, "GIVEN", 10000)
    monkeypatch.setattr(signals, "LEAST", given)
    rows = spark.range(4000).select((F.col("id") % products).alias("product"), F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("e"))
    asked = spark.range(150).select(F.col("id").alias("query"), "id", F.array(F.lit(1.0), F.lit(0.0)).alias("e"))
    run = lambda v, q: iter([[[len(v["vec_id"]) * len(q["query"])]]])
    sizes = [r["n"] for r in signals.meeting(rows, asked.drop("id"), F.col("vec_id"), F.col("query"), run, "n long", F.col("product")).collect()]
    assert sum(sizes) == 4000 * 150 and (max(sizes) < 25000 if products == 4000 else max(sizes) > 100000)


def told(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["agg06_least_distance", "hsh05_legacy_distance", "hsh06_legacy_ranking", "jn02_view_pairs", "jn03_every_pair"])
def test_no_pair_is_a_row(spark, name):
    assert not any("zip_with" in line or "aggregate(" in line for line in told(QUERIES[name](spark, DATA)).split("\n") if "query" in line and "vec_id" in line)
    assert "FlatMapCoGroupsInArrow" in told(QUERIES[name](spark, DATA))


@pytest.mark.parametrize("name", OF_SIGNALS)
def test_no_block_is_a_row(spark, monkeypatch, name):
    """Vectors reach the workers one by one; a row that holds a chunk and a block of them filled executors."""
    monkeypatch.setattr(similarity, "in_table", lambda df: df)
    plan = told(QUERIES[name](spark, DATA))
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan
