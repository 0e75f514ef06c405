"""Substring dedup against all windows of all texts: small alphabets, shared passages, hot buckets, slices, odd rows."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brasswell.llm import suffixdedup

LEAST = suffixdedup.LEAST


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + LEAST] for r in raw for i in range(len(r) - LEAST + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - LEAST + 1):
            if seen[r[i : i + LEAST]] > 1:
                gone[i : i + LEAST] = b"\1" * LEAST
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgäß日") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(40), prose(70), prose(34), "lorem " * 90]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 60)
            parts += [p[a : a + rng.choice((150, 199, 200, 201, 260, 900))], prose(rng.randrange(1, 50))]
        texts.append(rng.choice(("", " ", "\n")).join(parts))
    texts += ["", None, "short", "x" * 199, "x" * 200, "y" * 201, "ab" * 400, passages[1], passages[1], passages[1] + "!", texts[3], texts[3][1:], texts[4] + texts[4]]
    # One passage that a third of the texts hold, each between other words.
    return texts + [prose(30) + passages[0] + prose(30) for _ in range(30)]


def told(rows):
    return sorted((r.doc_id, len((r.text or "").encode()), sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in rows)


@pytest.mark.parametrize(("hot", "slice_", "batch"), [(1 << 10, 1 << 22, 1 << 21), (4, 700, 5000)])
def test_against_all_windows(spark, monkeypatch, hot, slice_, batch):
    for name, value in (("HOT", hot), ("SLICE", slice_), ("BATCH", batch)):
        monkeypatch.setattr(suffixdedup, name, value)
    texts = corpus(hot)
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(5)
    rows = suffixdedup.remove_repeats(docs).collect()
    want = sorted((i, *x) for i, x in enumerate(brute(texts)))
    assert told(rows) == want and all(r["digest"] == "mine" for r in rows)
    assert sum(w[2] for w in want) > 10000


def test_records_cover_windows_once():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    bounds = np.array([0, 100, 1300, 1500, 1500, 5000])
    text, first, last, at, *_ = suffixdedup.records_of(data, bounds)
    got = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    want = np.concatenate([np.arange(a, b - LEAST + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    assert (got == want).all()
    assert (at >= last).all() and (at + suffixdedup.GRAM <= first + LEAST).all() and (bounds[text] <= first).all()


def test_cover_holds_all_differences():
    n, d = suffixdedup.MODULO, suffixdedup.COVER
    assert {(a - b) % n for a in d for b in d} == set(range(n))


def test_long_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    one, part = " ".join(words), " ".join(words[1000:1100])
    texts = [one, "before " + part + " behind", "a" * 1_500_000, "b" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffixdedup.remove_repeats(docs).collect()}
    start = one.index(part)
    assert [(s.start, s.end) for s in got[0].removed] == [(start - 1, start + len(part) + 1)]
    assert bytes(got[1].kept) == b"beforebehind" and bytes(got[2].kept) == b"" and bytes(got[3].kept) == b""


def test_repeated_and_null_rows(spark):
    text = " ".join(f"n{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + " more"), (None, None), (None, "tiny"), (None, "tiny"), (2, "tiny")], "doc_id long, text string")
    rows = suffixdedup.remove_repeats(docs).collect()
    assert sorted(bytes(r.kept) for r in rows) == sorted([b"", b"", b" more", b"", b"tiny", b"tiny", b"tiny"])
    assert suffixdedup.remove_repeats(docs.where(F.lit(False))).count() == 0


def test_query_tells_the_operator(spark, tmp_path):
    texts = corpus(9)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in suffixdedup.op12_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((i, n, r, s, hashlib.sha256(k).hexdigest()) for i, (n, r, s, k) in enumerate(brute(texts)))


def test_hot_buckets_make_rows_by_records(spark, monkeypatch):
    """A passage between other words in 300 texts: spans of a hot bucket go by its records, not by their windows, and none is lost."""
    monkeypatch.setattr(suffixdedup, "HOT", 8)
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    passage = prose(700)
    texts = [prose(60 + i % 90) + passage[i % 3 :] + prose(80) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hot, seen = [], suffixdedup.hot_spans

    def watched(records, scratch):
        spans = seen(records, scratch)
        rows = records.select("first", "last").collect()
        hot.append((len(rows), sum(r.last - r.first + 1 for r in rows), sum(s.count() for s in spans)))
        return spans

    monkeypatch.setattr(suffixdedup, "hot_spans", watched)
    got = told(suffixdedup.remove_repeats(docs).collect())
    assert got == sorted((i, *x) for i, x in enumerate(brute(texts)))
    records, windows, spans = hot[0]
    assert records > 1000 and windows > 5 * spans and spans < 4 * records


def test_texts_go_to_one_worker_at_the_end(spark, tmp_path):
    """Two steps in Python behind each other would keep two workers for each task, beside an executor whose memory is bounded."""
    spark.createDataFrame(list(enumerate(corpus(5))), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = suffixdedup.op12_suffix_dedup(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_memory_of_marks():
    """Tables of powers don't add up over chunks of many sizes, and a chunk of short texts takes no more than some dozens of bytes for each of its own."""
    sizes = []
    rows = pa.RecordBatch.from_pydict({"digest": [b"x"] * 3000, "row": list(range(3000)), "text": [f"{i} " * 80 for i in range(3000)]})

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            tracemalloc.start()
            for part in run(iter([rows.slice(k, n) for k, n in ((0, 40), (40, 160), (200, 800), (1000, 2000))])):
                sizes.append(part.num_rows)
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return self

    suffixdedup.POWERS.clear() if hasattr(suffixdedup, "POWERS") else suffixdedup._powers.cache_clear()
    assert suffixdedup.marks(Docs()).peak < 64e6
    assert sum(sizes) == 3000
