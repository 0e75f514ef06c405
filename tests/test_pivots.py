"""Pruned vector search against all pairs."""

import numpy as np
import pytest

from brasswell.operators import pivots


def told(df):
    return sorted((r["query"], r["rank"], r["vec_id"], r["product"]) for r in df.collect())


def expected(rows, asked, most):
    out = []
    for q, x in asked:
        best = sorted((-round(float(np.dot(x, v)), 9), i, p) for p, i, v in rows)[:most]
        out += [(q, k + 1, i, p) for k, (_, i, p) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("count", "block", "most"), [(12, 1000, 5), (12, 7, 5), (1, 1000, 3), (40, 1000, 500)])
def test_pruned_search_against_all_pairs(spark, monkeypatch, count, block, most):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 4
    rows = [(i % 5, i, (centres[i % 8] + rng.normal(size=6) * 0.3).tolist()) for i in range(240)]
    rows += [(9, 1000 + i, rows[0][2]) for i in range(60)]  # one hot cell of equal rows: ties by id
    asked = [(i, (centres[i % 8] + rng.normal(size=6)).tolist()) for i in range(20)] + [(50, [0.0] * 6), (51, rows[0][2])]
    odd = [(1, 2000, None), (1, 2001, [1.0, 2.0]), (1, None, [1.0] * 6), (1, 2002, [float("nan")] * 6), (1, 2003, [float("inf")] * 6)]
    left = spark.createDataFrame(rows + odd, "product long, vec_id long, vector array<double>")
    right = spark.createDataFrame([*asked, (60, None), (None, [1.0] * 6), (61, [1.0])], "query long, asked array<double>")
    found, visited = pivots.Cells(left, 6, count).nearest(right, most)
    assert told(found) == expected(rows, asked, most)
    met = {r["query"]: (r["visited"], r["rows"]) for r in visited.collect()}
    assert set(met) == {q for q, _ in asked} and all(n <= m == len(rows) for n, m in met.values())
    if count == 12 and most == 5:  # clustered rows: most cells are never visited
        assert sum(n for n, _ in met.values()) < 0.7 * len(rows) * len(asked)


def test_pruned_search_of_nothing(spark):
    left = spark.createDataFrame([(1, 1, [1.0, 0.0])], "product long, vec_id long, vector array<double>")
    right = spark.createDataFrame([(1, [1.0, 0.0])], "query long, asked array<double>")
    assert pivots.Cells(left.where("false"), 2).nearest(right, 3)[0].count() == 0
    assert pivots.Cells(left, 2).nearest(right.where("false"), 3)[0].count() == 0
    assert told(pivots.Cells(left, 2).nearest(right, 3)[0]) == [(1, 1, 1, 1)]
