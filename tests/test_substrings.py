"""Needles looked up whole, against all pairs, and plans in which no text is shuffled."""

import random

import duckdb
import pytest

import __spark_entry__  # noqa: F401
from brasswell.operators import substrings
from brasswell.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("exact", "places", "rows", "few"), [(16, 1 << 19, 1 << 16, 1 << 17), (16, 3, 2, 0), (5, 64, 7, 1)])
def test_short_and_long_needles_against_all_pairs(spark, monkeypatch, exact, places, rows, few):
    for name, value in (("EXACT", exact), ("PLACES", places), ("ROWS", rows), ("FEW", few)):
        monkeypatch.setattr(substrings, name, value)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab1Ä日𝄞 \0") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 40)), i % 3) for i in range(120)] + [(200, None, 0), (201, "", 0), (202, "1234567890123456" * 3, None), (203, "x12345678901234567y", 1), (203, "x12345678901234567y", 1), (204, "Ã", 1)]
    needles = [(i, word(rng.choice((1, 2, 3, 4, 6)))) for i in range(80)] + [(300, None), (301, ""), (302, "1234567890123456"), (303, "12345678901234567"), (303, "12345678901234567"), (304, "a"), (304, "a"), (305, "Ä" * 8), (306, "nowhere")]
    left, right = spark.createDataFrame(texts, "id long, text string, other int"), spark.createDataFrame(needles, "n long, needle string")
    got = substrings.containing(left, "text", right, "needle")
    want = sorted((i, o or -1, n, x) for i, t, o in texts for n, x in needles if t and x and x in t)
    assert sorted((r["id"], r["other"] or -1, r["n"], r["needle"]) for r in got.collect()) == want and len(want) > 200
    first = {}
    for i, _, n, _x in want:
        first[n] = min(i, first.get(n, i))
    assert sorted(tuple(r) for r in substrings.first_containing(right, "n", "needle", left, "text", "id").collect()) == sorted(first.items())


def test_no_needles_and_only_long_ones(spark):
    left = spark.createDataFrame([(1, "a needle that is long enough"), (2, "b")], "id long, text string")
    right = spark.createDataFrame([(1, "needle that is long"), (2, "")], "n long, needle string")
    assert [tuple(r) for r in substrings.first_containing(right, "n", "needle", left, "text", "id").collect()] == [(1, 1)]
    assert substrings.first_containing(right.where("n = 2"), "n", "needle", left, "text", "id").count() == 0
    assert substrings.containing(left, "text", right.where("n = 1"), "needle").count() == 1
    assert substrings.containing(left, "text", right.where("n = 2"), "needle").columns == ["id", "n", "needle"]


def told(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_name_is_found_without_its_pairs(spark):
    """jn14: a needle that most names contain brings one row of each task, and no name is shuffled."""
    plan = told(QUERIES["jn14_fallback_by_substring"](spark, DATA))
    assert "MapInArrow" in plan and "Contains(" not in plan and "c_name" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
    assert "partial_min(c_custkey" in plan


def test_pairs_of_either_key_are_not_compared(spark, tmp_path):
    """jn12: rows that repeat bring their pairs again, as in the SQL, and missing users don't hide what the message says."""
    db = duckdb.connect()
    db.execute(f"COPY (SELECT 12 AS o_orderkey, 5 AS o_custkey UNION ALL SELECT 12, 5 UNION ALL SELECT 77, NULL UNION ALL SELECT 4, 4) TO '{tmp_path}/orders.parquet'")
    db.execute(f"COPY (SELECT x AS event_id, CASE WHEN x % 2 = 0 THEN 5 WHEN x % 3 = 0 THEN NULL ELSE 4 END AS user_id, 'view' AS event_type, '00012 00077' AS props FROM range(0, 30000) t(x) WHERE x % 3001 < 2) TO '{tmp_path}/events.parquet'")
    for t in ("orders", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = QUERIES["jn12_either_key"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(db.execute(ORACLES["jn12_either_key"]).fetchall())
    assert "HashAggregate" not in told(df)


def test_words_meet_texts_without_a_shuffle_of_texts(spark):
    """flt04: only ids and words are shuffled."""
    plan = told(QUERIES["flt04_texts_of_words"](spark, DATA))
    assert "MapInArrow" in plan and "Contains(" not in plan and "told" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
