"""Balances, order statistics and range joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from brasswell.operators import orderstats, ranges
from brasswell.operators.ledger import floored, guarded


def histories():
    rng = random.Random(4)
    rows = [(u, i, rng.choice((None, 0, 3, 7, -2, -5, -9))) for u in (1, 2, 3) for i in range(60)] + [(7, i, rng.choice((4, -4, -5, 5))) for i in range(700)]
    return rows + [(8, 1, -5), (9, 1, None), (None, 1, 3), (None, 2, -9), (None, 3, 2)]


def test_floored_balance_against_a_loop(spark):
    df = spark.createDataFrame(histories(), "u long, i long, x long")
    want, at = {}, {}
    for u, i, x in histories():
        at[u] = max(0, at.get(u, 0) + (x or 0))
        want[u, i] = at[u]
    got = floored(df, "u", ["i"], F.col("x"), F.floor(F.col("i") / 7))
    assert {(r["u"], r["i"]): r["balance"] for r in got.collect()} == want and got.columns == ["u", "i", "x", "balance"]
    shifted = floored(df, "u", ["i"], F.col("x"), F.lit(0), floor=10).collect()
    assert {(r["u"], r["i"]): r["balance"] - 10 for r in shifted} == want
    assert floored(df.where("false"), "u", ["i"], F.col("x"), F.lit(0)).count() == 0


@pytest.mark.parametrize("batch", [10000, 13])
def test_guarded_ledger_against_a_loop(spark, batch):
    df = spark.createDataFrame(histories(), "u long, i long, x long")
    want, at = {}, {}
    for u, i, x in histories():
        fits = (x or 0) >= 0 or at.get(u, 0) + x >= 0
        at[u] = at.get(u, 0) + ((x or 0) if fits else 0)
        want[u, i] = (fits, at[u])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r["u"], r["i"]): (r["accepted"], r["balance"]) for r in guarded(df, "u", ["i"], F.col("x")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and not all(a for a, _ in got.values())
    assert guarded(df.where("false"), "u", ["i"], F.col("x")).count() == 0


@pytest.mark.parametrize(("bins", "few"), [(1024, 2048), (4, 5), (8, 0)])
def test_places_against_sorted_lists(spark, monkeypatch, bins, few):
    monkeypatch.setattr(orderstats, "BINS", bins)
    monkeypatch.setattr(orderstats, "FEW", few)
    rng = random.Random(5)
    inf = float("inf")
    groups = {"a": [rng.choice((1.0, 2.0, 2.5, -3.0)) for _ in range(90)], "b": [rng.gauss(0, 100) for _ in range(120)], "c": [5.0], "e": [-inf, inf, 0.0, 1e308, -1e308, 3.5, 2.5, inf], None: [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("d", None), ("d", float("nan")), ("a", None), ("b", float("nan"))]
    shares = {"first": 0.0, "low": 0.02, "half": 0.5, "high": 0.98, "last": 1.0}
    got = orderstats.places(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares)
    want = {(g, n): sorted(vs)[min(int(len(vs) * s), len(vs) - 1)] for g, vs in groups.items() for n, s in shares.items()}
    assert {(r["g"], r["name"]): r["v"] for r in got.collect()} == want
    assert orderstats.places(spark.createDataFrame([], "g string, v double"), "g", "v", shares).count() == 0


@pytest.mark.parametrize("part", [100_000, 3])
def test_ranges_against_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(ranges, "PART", part)
    rng = random.Random(6)
    held = [(i, a := rng.randrange(-500, 500), a + rng.choice((-1, 0, 1, 2, 3, 7, 8, 64, 900))) for i in range(80)] + [(90, None, 5), (91, 5, None), (92, -(10**15), 10**15), (93, 3, 3), (93, 3, 3)]
    asked = [(i, rng.randrange(-600, 900)) for i in range(150)] + [(200, None), (201, 3), (201, 3), (202, 10**15), (203, -(10**15) - 1)]
    got = ranges.holding(spark.createDataFrame(asked, "n long, v long"), "v", spark.createDataFrame(held, "r long, low long, high long"), "low", "high")
    want = sorted((n, r) for n, v in asked for r, a, b in held if None not in (v, a, b) and a <= v <= b)
    assert sorted((x["n"], x["r"]) for x in got.collect()) == want
    assert ranges.holding(spark.createDataFrame(asked, "n long, v long"), "v", spark.createDataFrame([], "r long, low long, high long"), "low", "high").count() == 0
