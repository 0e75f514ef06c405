"""Substring joins and Hamming searches against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from brasswell.operators import hamming, substrings


def test_substrings_against_all_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcÄ日 -") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 60))) for i in range(150)] + [(200, None), (201, ""), (202, "x" * 2000 + "needle" + "y" * 500), (203, texts_hot := "code 12345 " * 80), (204, texts_hot)]
    needles = [(i, word(rng.choice((1, 1, 2, 3, 4, 5, 9)))) for i in range(120)] + [(300, None), (301, ""), (302, "needle"), (303, "xneedley"), (304, "2345 code 1"), (305, "zz"), (306, "needle"), (307, "x" * 40), (308, "y" * 501)]
    got = substrings.containing(spark.createDataFrame(texts, "id long, text string"), "text", spark.createDataFrame(needles, "n long, needle string"), "needle")
    want = sorted((i, n) for i, t in texts for n, x in needles if t and x and x in t)
    assert sorted((r.id, r.n) for r in got.collect()) == want and len(want) > 300


def test_first_text_that_contains(spark):
    texts = spark.createDataFrame([(5, "one two"), (3, "two three"), (9, "three")], "id long, text string")
    needles = spark.createDataFrame([("a", "two"), ("b", "three"), ("c", "four"), ("d", None)], "k string, needle string")
    assert sorted(tuple(r) for r in substrings.first_containing(needles, "k", "needle", texts, "text", "id").collect()) == [("a", 3), ("b", 3)]
    assert substrings.containing(texts, "text", needles.where("false"), "needle").count() == 0


@pytest.mark.parametrize(("radius", "pieces", "part"), [(16, None, 4096), (20, 21, 4096), (20, None, 5), (64, None, 4096), (0, None, 4096)])
def test_radius_against_all_pairs(spark, monkeypatch, radius, pieces, part):
    monkeypatch.setattr(hamming, "PART", part)
    rng = random.Random(2)
    signed = lambda x: [(x >> 64 * k & (1 << 64) - 1) - ((x >> 64 * k + 63 & 1) << 64) for k in range(4)]
    base = [rng.getrandbits(256) for _ in range(12)]
    flipped = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(256), n))
    stored = {i: flipped(base[i % 12], rng.choice((0, 3, 16, 17, 20, 21, 40))) for i in range(140)} | {500 + i: base[0] for i in range(30)}
    asked = {i: flipped(base[i % 12], rng.choice((0, 1, 5))) for i in range(15)}
    left = spark.createDataFrame([(i, signed(x)) for i, x in stored.items()] + [(900, None)], "id long, hash array<long>")
    right = spark.createDataFrame([(i, signed(x)) for i, x in asked.items()] + [(None, signed(base[0]))], "query long, asked array<long>")
    want = sorted((i, q, (x ^ y).bit_count()) for i, x in stored.items() for q, y in asked.items() if (x ^ y).bit_count() <= radius)
    assert sorted(tuple(r) for r in hamming.within(left, right, 256, radius, pieces).collect()) == want
    if radius == 20 and part == 4096:  # the index looks at few pairs besides
        met = hamming.candidates(left.where("hash is not null"), right.where("query is not null"), 256, radius, pieces).agg(F.count("*")).first()[0]
        assert len(want) <= met < len(stored) * len(asked) / 2
