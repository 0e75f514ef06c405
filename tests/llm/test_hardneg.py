"""Hard-negative mining against brute force, with ties, odd rows and small chunks."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brasswell.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<float>, key string, block int, rank int"


def brute(rows, anchor, positives=5, negatives=10):
    kept = {}
    for r in rows:
        if r[0] is None or r[1] is None or r[2] is None or any(x is None or not math.isfinite(x) for x in r[2]):
            continue
        v = tuple(math.floor(float(np.float32(x)) * 256) for x in r[2])
        kept[(r[0], r[1], v)] = None
    out = []
    for i, label, v in kept:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in kept if len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, p, k, x[1], -s, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture
def rows():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 6))
    out = [(i, int(i % 4), [float(x) for x in centres[(i * 7) % 4] + rng.normal(size=6) / 2], "x", 1, 2) for i in range(240)]
    # Many equal vectors (ties), coarse vectors, other dimensions, and rows that take no part.
    out += [(1000 + i, i % 3, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], "y", 1, 2) for i in range(60)]
    out += [(2000 + i, i % 2, [0.5, 0.25], "y", 1, 2) for i in range(20)]
    out += [(3000, None, [1.0] * 6, None, None, None), (3010, 1, None, None, None, None), (3020, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0], "", 0, 0), (3030, 1, [math.nan] * 6, "", 0, 0), (3040, 2, [math.inf] * 6, "", 0, 0), (None, 1, [1.0] * 6, "", 0, 0), (3050, 1, [], "", 0, 0)]
    # Copies of rows, and rows of one id that differ.
    return out + out[:5] + out[245:250] + [(20, 3, out[24][2], "z", 1, 2), (20, 0, out[28][2], "z", 1, 2)]


@pytest.mark.parametrize(("chunk", "block", "step"), [(8192, 2048, 128), (50, 7, 3)])
def test_against_brute_force(spark, rows, monkeypatch, chunk, block, step):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("STEP", step)):
        monkeypatch.setattr(hardneg, name, value)
    got = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0)
    want = brute(rows, lambda i: i % 10 == 0)
    assert told(got) == want and len(want) > 500


def test_one_label_holds_a_third(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CHUNK", 64)
    rng = np.random.default_rng(3)
    some = [(i, 0 if i % 3 == 0 else i % 5, [float(x) for x in np.round(rng.normal(size=3), 1)], "", 0, 0) for i in range(400)]
    assert told(hardneg.hard_negatives(spark.createDataFrame(some, SCHEMA), F.col("id") % 20 == 0)) == brute(some, lambda i: i % 20 == 0)


def test_empty_and_lonely(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert hardneg.hard_negatives(nothing, F.col("id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0, 1.0], "", 0, 0), (1, 2, [1.0, 1.0], "", 0, 0)], SCHEMA)
    assert hardneg.hard_negatives(alone, F.col("id") % 10 == 0).count() == 0


def test_scores_beyond_doubles(spark):
    big = [(i, i % 2, [float(2**20 + 2 * i), float(2**19 + i)], "", 0, 0) for i in range(40)]
    assert told(hardneg.hard_negatives(spark.createDataFrame(big, SCHEMA), F.col("id") % 10 == 0)) == brute(big, lambda i: i % 10 == 0)
    with pytest.raises(OverflowError):
        hardneg.products(np.array([[1 << 40]]), np.array([[1 << 40]]))
