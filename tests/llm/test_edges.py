"""Nulls, repeated rows, ties, long texts, clashing columns and empty tables, for each operator and the pipeline."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brasswell.llm import fmindex, jpeg, linededup, lmscore, neardup, packing, quality, secrets, tokens, urlfilter
from brasswell.llm.common import written

LONG = " ".join(f"word{i} and" for i in range(15000)) + " password=abcdefghijkl0123 tail"
ROWS = [(None, "no id here " * 20), (1, None), (2, ""), (3, "same text of a few words " * 12), (3, "same text of a few words " * 12), (3, "same text of a few words " * 12), (4, "same text of a few words " * 12), (5, LONG), (6, LONG), (7, "\n\n \t "), (8, "É日本 " * 60)]
CLASHES = ["_text", "_words", "_lines", "_secrets", "_merged", "byte_hits", "hits", "items", "n_words", "doc", "removed", "kept_text", "score", "predicted", "n_tokens", "secrets", "media", "row", "bands", "digest", "shingles", "task", "rest", "h", "c", "block", "key"]


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string")
    return base.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHES), F.lit(7).alias("column 0"), F.lit("x").alias("column 1")).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "same text of a few words same text of a few words"), (1, "word7 and word8 and"), (None, "no id here no"), (2, None), (3, "")], "item_id long, text string")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_clashing_columns_and_odd_rows_pass_through(spark, odd, bench):
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    outs = {
        "quality": quality.score(odd, quality.train(odd, labels)),
        "lines": linededup.remove_repeats(odd),
        "redact": secrets.redact(odd),
        "secrets": secrets.find_secrets(odd),
        "cut": fmindex.cut_spans(odd, bench),
        "leaks": fmindex.find_leaks(odd, bench),
        "tokens": tokens.count_tokens(odd),
        "media": jpeg.media_columns(odd, wanted=("n_bytes", "payload_sha256")),
    }
    own = {"quality": {"score", "predicted"}, "lines": {"removed", "kept_text"}, "secrets": {"secrets"}, "leaks": {"n_words", "hits", "byte_hits", "items"}, "tokens": {"n_tokens"}, "media": {"n_bytes", "payload_sha256"}}
    for name, out in outs.items():
        rows = out.collect()
        assert ids(out) == ALL, name
        for c in CLASHES:
            if c not in own.get(name, ()):
                assert all(r[c] == f"mine {c}" for r in rows), (name, c)
        assert all(r["column 0"] == 7 and r["column 1"] == "x" for r in rows), name
        alike = defaultdict(set)
        for r in rows:
            if r.doc_id in (3, 5, 6):
                alike[r.doc_id].add(str({k: v for k, v in r.asDict().items() if k != "doc_id"}))
        assert len(alike[3]) == 1, name  # repeated rows have equal results
        if name != "lines":
            assert alike[5] == alike[6], name  # equal texts too


def test_near_copies_of_odd_rows(spark, odd):
    rows = neardup.near_duplicates(odd).collect()
    got = {(r.doc_id, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(ROWS)
    assert {(3, 3, True), (4, 3, False), (5, 5, True), (6, 5, False), (1, 1, True), (2, 2, True), (7, 7, True), (None, None, None)} <= got


def test_many_repeated_rows_of_one_id_stay_linear(spark):
    docs = spark.createDataFrame([(i % 2, " ".join(f"w{k}" for k in range(60)) + (" x y z" if i % 2 else "")) for i in range(800)], "doc_id long, text string")
    rows = neardup.near_duplicates(docs, 5, 80).collect()
    assert len(rows) == 800 and {(r.doc_id, r.component_id) for r in rows} == {(0, 0), (1, 0)}


def brute_groups(words, width, percent):
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()) for w in words]
    root = list(range(len(words)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_groups_of_many_near_copies_by_brute_force(spark, width, percent):
    """Copies of one text with more and more changes, copies of copies, and cut ones: many share buckets without being linked."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    words = [base]
    for _ in range(260):
        w = list(words[rng.integers(len(words))] if rng.random() < 0.3 else base)
        for _ in range(int(rng.integers(0, 12))):
            w[rng.integers(len(w))] = f"n{rng.integers(40 if rng.random() < 0.5 else 10**6)}"
        words.append(w[: len(w) - int(rng.integers(0, 25))] if rng.random() < 0.2 else w)
    order = rng.permutation(len(words))
    words = [words[i] for i in order]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width, percent).collect()}
    assert [got[i] for i in range(len(words))] == brute_groups(words, width, percent)


def test_repeats_with_ties_and_repeated_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [(5, f"five {passage} end"), (2, f"{passage}"), (2, f"{passage}"), (9, f"nine\n{passage}\n{passage}"), (7, " ".join(f"p{i}" for i in range(49))), (None, passage), (4, None)]
    rows = defaultdict(list)
    for r in linededup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        rows[r.doc_id].append(r.kept_text)
    assert rows[2] == [passage] * 2 and rows[5] == ["five end"] and rows[7] == [texts[4][1]] and rows[None] == [passage] and rows[4] == [""]
    assert rows[9] == ["nine\n"]


def test_packing_over_many_tasks_loses_nothing_and_pads_little(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", *(" ".join(rng.choice(["the", "river.", "stone", "blue!", "walks"], n)) for n in rng.integers(1, 400, 300))]
    docs = spark.createDataFrame([(i if i != 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pieces = packing.pack(docs.repartition(40)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        want = np.append(tokens.encode_long(t or "", "byte_bpe_50k.tiktoken"), packing.END)
        rows = sorted(by_doc[i if i != 9 else None], key=lambda r: r.start)
        assert [r.start for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist() and sum(r.length for r in rows) == len(want)
        assert all(r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].astype("<u4").tobytes()) and r.doc_tokens == len(want) for r in rows)
    sizes = []
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist()
        sizes.append(sum(r.length for r in rows))
    assert max(sizes) <= 2048 and len(sizes) <= sum(sizes) / 2048 * 1.1 + 1


def test_packing_and_scores_of_odd_rows(spark, odd):
    assert sorted({r.doc_id for r in packing.pack(odd).collect()}, key=str) == sorted(set(ALL), key=str)
    scored = lmscore.score_texts(odd, odd.where("doc_id < 5"))
    rows = scored.collect()
    assert ids(scored) == ALL and np.ptp([r.score for r in rows if r.doc_id in (3, 4)]) < 1e-4 and all(r.n_tokens >= 1 and r.score < 0 for r in rows)


def test_list_join_over_spans_of_time_is_that_of_brute_force(spark):
    rng = np.random.default_rng(2)
    hosts = ["hot.example.org", "a.b.co.uk", "x.y", "1.2.3.4"]
    entries = [(hosts[rng.integers(4)] if rng.random() < 0.8 else "example.org", ["", "/a", "/a/b"][rng.integers(3)], int(rng.integers(0, 300)), ["allow", "block"][rng.integers(2)]) for _ in range(120)]
    captures = [(i, hosts[0] if rng.random() < 0.7 else hosts[rng.integers(4)], ["/", "/a", "/a/b/c", ""][rng.integers(4)], int(rng.integers(-5, 400)) if i % 50 else None) for i in range(600)]
    got = urlfilter.judge(spark.createDataFrame(captures, "id long, host string, path string, fetched long").withColumn("_host", F.lit(1)).withColumn("action", F.lit("mine")), spark.createDataFrame(entries, "host string, path string, at long, action string")).collect()
    assert len(got) == 600 and all(r._host == 1 for r in got)
    want = {}
    for i, h, p, t in captures:
        best = None
        parts = h.split(".")
        names = [h] if h == "1.2.3.4" else [".".join(parts[k:]) for k in range(len(parts))]
        folders = p.rstrip("/").split("/")
        for n in names:
            for f in ("/".join(folders[:k]) for k in range(1, len(folders) + 1)):
                held = [(a, x) for eh, ep, a, x in entries if t is not None and (eh, ep) == (n, f) and a <= t]
                if held:
                    best = max(best or (), (len(n), len(f), *max(held)))
        want[i] = best[2:] if best else (None, None)
    assert {r.id: (r.valid_from, r.action) for r in got} == want
    assert urlfilter.judge(spark.createDataFrame([], "id long, host string, path string, fetched long"), spark.createDataFrame(entries, "host string, path string, at long, action string")).count() == 0


@pytest.mark.parametrize("kind", ["date", "timestamp", "double"])
def test_url_filter_takes_any_time(spark, kind):
    captures = spark.createDataFrame([(i, ["a.example.com", "b.example.com", "com", "10.0.0.1", None][i % 5], i * 7 % 60 if i % 11 else None) for i in range(200)], "id long, host string, t int")
    entries = spark.createDataFrame([("example.com", 10, "block"), ("example.com", 20, "allow"), ("a.example.com", 15, "block"), ("10.0.0.1", 0, "block"), ("b.example.com", None, "block"), ("b.example.com", 59, "block")], "host string, t int, action string")
    times = {"date": "date_add(DATE'2024-01-01', t)", "timestamp": "TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, t)", "timestamp_ntz": "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, t)", "double": "t / 7D", "int": "t"}
    told = lambda at: urlfilter.judge(captures.withColumn("fetched", F.expr(at)), entries.withColumn("at", F.expr(at)).drop("t")).select("id", "action", "blocked").collect()
    want = {}
    for r in captures.collect():
        held = [(len(h), t, a) for h, t, a in [tuple(x) for x in entries.collect()] if r.host and r.t is not None and t is not None and t <= r.t and (r.host == h or r.host.endswith("." + h))]
        want[r.id] = max(held)[2] if held else None
    assert {r.id: r.action for r in told(times[kind])} == want


def test_phrases_in_several_blocks_are_those_of_one(spark, odd, bench, monkeypatch):
    docs = odd.select("doc_id", "text")
    once = sorted(map(str, fmindex.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(fmindex, "BLOCK", 4)
    assert fmindex.blocks_of(bench)[1] > 2
    assert sorted(map(str, fmindex.find_leaks(docs, bench).collect())) == once


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = written(stages["quality classifier"](spark, docs, sf))
    assert good.columns == docs.columns
    scores = {r.doc_id: r.predicted for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, p in scores.items() if p == 1} and 0 < good.count() < docs.count()

    single = written(stages["near-dedup"](spark, good, sf))
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    lower = lambda t: t.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    root = brute_groups([re.findall(rb"[^\x20\x09-\x0d]+", lower(r.text)) for r in rows], 5, 80)
    assert {r.doc_id for r in single.collect()} == {r.doc_id for i, r in enumerate(rows) if root[i] == i}

    clean = written(stages["benchmark decontamination"](spark, single, sf))
    word = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word.findall(lower(r.text or ""))
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    widths = {len(w) for w in windows}
    before = {r.doc_id: r for r in single.collect()}
    changed = 0
    for r in clean.collect():
        raw = before[r.doc_id].text.encode()
        found = list(word.finditer(lower(before[r.doc_id].text)))
        hit = np.zeros(len(found), bool)
        for k in widths:
            for i in range(len(found) - k + 1):
                if tuple(m[0] for m in found[i : i + k]) in windows:
                    hit[i : i + k] = True
        out, at, i = [], 0, 0
        while i < len(found):
            j = i
            while j < len(found) and hit[j]:
                j += 1
            if j > i:
                out.append(raw[at : found[i].start()])
                at = found[j - 1].end()
            i = max(j, i + 1)
        want = b"".join([*out, raw[at:]]).decode()
        changed += want != before[r.doc_id].text
        assert r.text == want and (r.n_chars == len(want) or r.text == before[r.doc_id].text)
    assert changed

    safe = written(stages["secret scans"](spark, clean, sf))
    assert safe.count() == clean.count()
    was = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        spans = secrets.scan_texts([was[r.doc_id]])[0]
        mask = np.zeros(len(was[r.doc_id]) + 1, bool)
        for a, _, b in spans:
            mask[a:b] = True
        want = re.sub("\0+", "[SECRET]", "".join("\0" if m else c for c, m in zip(was[r.doc_id], mask[:-1], strict=True)))
        assert r.text == want

    packed = stages["packing"](spark, safe, sf).collect()
    totals = defaultdict(int)
    for r in packed:
        totals[r.doc_id] += r.length
    assert totals == {r.doc_id: len(tokens.encode_long(r.text, "byte_bpe_50k.tiktoken")) + 1 for r in safe.collect()}
    again = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()}
    assert sum(x[2] for x in again) == sum(r.length for r in packed) and {x[0] for x in again} == set(totals)


def test_pipeline_takes_odd_rows(spark, odd):
    sf = "/root/testdata/sf0.001"
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    stages = dict(corpus_pipeline.STAGES)
    # Each stage on the odd rows themselves: 4 and 6 are copies of 3 and 5, repeated rows of one id stay together, nothing else goes.
    assert ids(stages["near-dedup"](spark, docs, sf)) == sorted((d for d in ALL if d not in (4, 6)), key=lambda x: (x is None, x))
    assert ids(stages["benchmark decontamination"](spark, docs, sf)) == ALL == ids(stages["secret scans"](spark, docs, sf))
    assert set(ids(stages["packing"](spark, docs, sf))) == set(ALL)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = [r.doc_id for r in quality.score(docs, quality.train(docs, labels)).collect() if r.predicted == 1]
    assert ids(stages["quality classifier"](spark, docs, sf)) == sorted(kept, key=lambda x: (x is None, x))
    empty = docs.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
