"""Carts against a loop, point ids, collated order, retained logs and versions of tables."""

import random
import re

from pyspark.sql import functions as F

from brasswell.functions.text import collated, point_id, signed_hash
from brasswell.operators.carts import carts, wished
from brasswell.sources.generations import Generations, append_newest
from brasswell.sources.storage import read_version, stored_version


def test_carts_against_a_loop(spark):
    rng = random.Random(7)
    kinds = ("add", "add", "set", "set", "remove", "save", "back", "forget", "other", None)
    rows = [(c, p, t, rng.choice(kinds), rng.choice((None, -1, 0, 1, 2, 5))) for t, (c, p) in enumerate((c, p) for c in (1, 2, None) for p in range(8) for _ in range(9))]
    quantity, saved = {}, {}
    for c, p, _, kind, q in rows:
        now = quantity.get((c, p), 0)
        if kind == "add" and q and q >= 1:
            quantity[c, p] = now + q
        elif kind == "back":
            quantity[c, p], saved[c, p] = now + 1, False
        elif kind == "forget":
            saved[c, p] = False
        elif kind in ("remove", "save") or (kind == "set" and q is not None and q < 1):
            quantity[c, p] = 0
            if kind == "save" and now:
                saved[c, p] = True
        elif kind == "set" and q is not None and now:
            quantity[c, p] = q
    want = {k: (quantity.get(k, 0), saved.get(k, False)) for k in quantity | saved if quantity.get(k, 0) or saved.get(k)}
    log = spark.createDataFrame(rows, "cart long, product long, at long, kind string, quantity long")
    assert {(r["cart"], r["product"]): (r["quantity"], r["saved"]) for r in carts(log).collect()} == want and want
    assert carts(log.where("false")).count() == 0


def test_wished_are_toggled_an_odd_number_of_times(spark):
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "a", 4), (1, "b", 5), (1, "b", 6)], "person long, product string, at long")
    assert sorted(tuple(r) for r in wished(log).collect()) == [(1, "b", 6), (2, "a", 4)]


def test_point_ids_over_utf16_units(spark):
    texts = ["", "a", "p::1", "شیر آلات", "tap 🚰 𝄞", "z" * 300]

    def expected(text):
        signed = lambda v: (v + 2**31) % 2**32 - 2**31
        data, h = text.encode("utf-16-be"), 0
        for k in range(0, len(data), 2):
            h = signed(h * 31 + int.from_bytes(data[k : k + 2], "big"))
        return h, f"{abs(h):08x}-0000-4000-8000-{abs(signed(h ^ 0x9E3779B9)):012x}"

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", signed_hash(F.col("t")).alias("h"), point_id(F.col("t")).alias("p")).collect()
    assert {r["t"]: (r["h"], r["p"]) for r in rows} == {t: expected(t) for t in texts}
    assert all(re.fullmatch(r"[0-9a-f]{8}-0000-4000-8000-[0-9a-f]{12}", r["p"]) for r in rows)


def test_names_in_the_order_of_their_alphabet(spark):
    names = ["آبگرم", "باران 2", "باران 10", "پونه", "تابان", "جویبار", "چشمه", "ژاله", "سپید", "کویر", "گلاب", "لاله", "هامون", "یاس"]
    shuffled = spark.createDataFrame([(n,) for n in random.Random(1).sample(names, len(names))], "n string")
    assert [r["n"] for r in shuffled.orderBy(collated(F.col("n"))).collect()] == names
    assert [r["n"] for r in shuffled.orderBy("n").collect()] != names


def test_stored_log_keeps_its_newest(spark, tmp_path):
    rows = spark.range(100).withColumn("at", F.pmod(F.col("id") * 37, F.lit(101)))
    for part in range(5):  # a new object each time, as after a restart
        append_newest(Generations(spark, str(tmp_path)), rows.where(F.col("id") % 5 == part), [F.desc("at"), F.desc("id")], 7)
    kept = Generations(spark, str(tmp_path)).read(rows.where("false"))
    assert sorted(r["at"] for r in kept.collect()) == sorted(sorted(i * 37 % 101 for i in range(100))[-7:])


def test_versions_of_a_table(spark, tmp_path):
    rows = spark.range(10)
    assert stored_version(rows.where("id < 3"), str(tmp_path), 1).count() == 3
    assert stored_version(rows, str(tmp_path), 2).count() == 10
    assert read_version(spark, str(tmp_path), 1, rows.where("false")).count() == 3
    assert read_version(spark, str(tmp_path), 9, rows.where("false")).count() == 0
    assert stored_version(rows.where("id < 2"), str(tmp_path), 1).count() == 2
