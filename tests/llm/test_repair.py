"""Conversation repair against a row-by-row programme over (cost, edits), in one part and in many."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brasswell.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, part long, edits string, c string, x int"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute(rows):
    """The digests of one conversation of rows (turn, role, text); the state is the last role's initial."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {"": (0, "", ())}
    full = lambda s: "user" if s == "u" else "assistant"
    for (_, role, text), fault in zip(rows, faults, strict=True):
        found = {}

        def offer(state, cost, letters, lines, found=found):
            if state not in found or (cost, letters) < found[state][:2]:
                found[state] = cost, letters, lines

        for state, (cost, letters, lines) in best.items():
            for n in range(4):
                offer(state, cost + 3, letters + "D", lines)
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    if role[:1] == "s" and state == "" or role[:1] in ("u", "a") and NEXT[state] == role[:1]:
                        offer(role[:1], cost + more, letters + "K", (*lines, f"{role}:{text}"))
                    offer(NEXT[state], cost + 2 + more, letters + "R", (*lines, f"{full(NEXT[state])}:{text}"))
                state, cost, letters = NEXT[state], cost + 2, letters + "I"
                lines = (*lines, f"{full(state)}:")
        best = found
    ends = []
    for state, (cost, letters, lines) in best.items():
        for _ in range(3):
            if state in ("", "a"):
                ends.append((cost, letters, lines))
                break
            state, cost, letters = NEXT[state], cost + 2, letters + "I"
            lines = (*lines, f"{full(state)}:")
    cost, letters, lines = min(ends)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def rows_of(seed, n):
    rng = random.Random(seed)
    roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "tool", "", None, "system", "Unit"], ["user"], ["assistant", "user", "user"]])
    words = ["yes.", "no?", "cut off", "", " \n", None, "a long answer!", "mehr: ä日"]
    return [(None if rng.random() < 0.05 else i // rng.choice((1, 1, 1, 2)) + rng.choice((0, 0, 0, 3)), rng.choice(roles), rng.choice(words) if rng.random() < 0.4 else f"text {rng.randrange(max(4, n))}{rng.choice(['.', '.', ''])}") for i in range(n)]


@pytest.mark.parametrize(("rows_at_most", "bytes_at_most"), [(4096, 1 << 20), (7, 1 << 20), (64, 40)])
def test_against_brute_force(spark, monkeypatch, rows_at_most, bytes_at_most):
    monkeypatch.setattr(repair, "PIECE_ROWS", rows_at_most)
    monkeypatch.setattr(repair, "PIECE_BYTES", bytes_at_most)
    talks = {k: rows_of(k, 1 + k % 13) for k in range(120)} | {1000: rows_of(5, 900), None: rows_of(11, 30), 1001: [(None, "user", "same.")] * 150 + [(1, "assistant", "same.")] * 90}
    rows = [(k, *r, 1, "mine", "mine", 0) for k, talk in talks.items() for r in talk]
    random.Random(1).shuffle(rows)
    out = repair.digests(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in out}
    assert len(out) == len(talks)
    for k, talk in talks.items():
        assert got[k] == brute(talk), k


def test_parts_hold_the_whole_repair(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 16)
    talk = rows_of(3, 200)
    parts = repair.repaired(spark.createDataFrame([(1, *r, 1, "", "", 0) for r in talk], SCHEMA)).orderBy("part").collect()
    assert len(parts) > 10 and all(len(p.symbols) <= 16 for p in parts)
    lines = [f"{r}:{t}" for p in parts for r, t in zip(p.roles, p.texts, strict=True)]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == brute(talk)[-1]
    assert "".join(p.edits for p in parts) == brute(talk)[-2]


def test_nothing_left_and_empty(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a.", 0), (2, 1, "user", "a.", 1), (2, 2, "assistant", "b.", 2)], "conv_id long, turn long, role string, text string, copies int")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.digests(rows).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()), 2: brute([(1, "user", "a."), (2, "assistant", "b."), (2, "assistant", "b.")])}
    assert repair.digests(rows.where("false")).count() == 0


def test_powers_equal_steps(spark):
    for symbol in "suaoSUAObd":
        v = (3, 0, 1, 2)
        for n in range(1, 40):
            v = repair.times(repair.power(symbol, 0), v)
            assert repair.before([(symbol, n)], (3, 0, 1, 2)) == v


def test_very_long_text(spark):
    talk = [(1, "user", "word " * 400_000 + "end."), (2, "assistant", "x" * 1_500_000), (3, "user", "more.")]
    out = repair.digests(spark.createDataFrame([(1, *r) for r in talk] + [(2, 1, "user", "short.")], "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [tuple(r)[1:] for r in out] == [brute(talk), brute([(1, "user", "short.")])]


def test_damage(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("Well. Yes!").alias("text"))
    out = repair.damaged(rows).groupBy("copies", "role", "text").count().collect()
    assert {(r.copies, r.role, r.text) for r in out} == {(0, "assistant", "Well. Yes!"), (1, "assistant", ""), (1, "assistant", "Well Yes"), (2, "assistant", "Well. Yes!"), (1, "user", "Well. Yes!"), (1, "assistant", "Well. Yes!")}
