"""The recurrent model held against plain numpy, one token at a time, and the groups of rarer words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brasswell.llm import gru, lmscore

CLASSES, SIZE, GROUPS = 2, 3, 3
WORDS = CLASSES * SIZE
END = 0


def model(seed=0):
    rng = np.random.default_rng(seed)
    p = gru.initial(np.array([50, 30, 20, 5, 4, 3]), np.array([9, 7, 2]), CLASSES, SIZE)
    return {k: v.astype(float) + rng.normal(0, 0.3, v.shape) for k, v in p.items()}


def distribution(p, h):
    """Log-probabilities of all ids after one state, by the formulas."""
    plain = lambda x: x - np.log(np.exp(x).sum())
    c = plain(h @ p["wc"] + p["bc"])
    own = [c[k] + plain(h @ p["ww"][k] + p["bw"][k]) for k in range(CLASSES)]
    return np.concatenate([*own, c[CLASSES:]])


def told(p, ids):
    """Log-probability of one document, token by token."""
    n, h, last, total = gru.HIDDEN, np.zeros(gru.HIDDEN), END, 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for i in ids:
        x, k = p["emb"][last] @ p["wx"] + p["bx"], h @ p["u"]
        z, r = sigmoid(x[:n] + k[:n]), sigmoid(x[n : 2 * n] + k[n : 2 * n])
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * k[2 * n :])
        total += distribution(p, h)[i]
        last = i
    return total


def test_documents_in_blocks_score_as_token_by_token():
    p, rng = model(), np.random.default_rng(1)
    docs = [np.append(rng.integers(1, WORDS + GROUPS, n), END) for n in (0, 1, 63, 64, 65, 300, 129, 0)]
    got = gru.score_documents({k: v.astype(np.float32) for k, v in p.items()}, docs, SIZE, END)
    assert np.allclose(got, [told(p, d) for d in docs], rtol=1e-4)


def test_probabilities_sum_to_one_over_words_and_groups():
    p = {k: v.astype(np.float32) for k, v in model(2).items()}
    h = np.random.default_rng(3).normal(size=(4, gru.HIDDEN)).astype(np.float32)
    got = np.stack([gru.outputs(p, h, np.full(4, i), SIZE)[0] for i in range(WORDS + GROUPS)])
    assert np.allclose(np.exp(got).sum(axis=0), 1, atol=1e-5)
    assert np.allclose(got.T, [distribution(p, row) for row in h], atol=1e-4)


def test_gradients_are_those_of_small_changes():
    p = model(4)
    doc = np.array([3, 7, 1, 6, 8, 2, 5, END])  # one window, words of both classes and all groups
    trainer = gru.Trainer(p, SIZE, END, {k: np.full_like(v, 1e-30) for k, v in p.items()})
    trainer._window(np.append(END, doc[:-1])[:, None], doc[:, None], np.zeros((1, gru.HIDDEN)))
    rng = np.random.default_rng(5)
    for name, v in p.items():
        got = np.sqrt(trainer.seen[name]) * np.sign(v - trainer.p[name])  # Adagrad's first step goes by the sign
        for at in rng.choice(v.size, min(v.size, 30), replace=False):
            at, slopes = np.unravel_index(at, v.shape), []
            for change in (1e-4, -1e-4):
                other = {k: w.copy() for k, w in p.items()}
                other[name][at] += change
                slopes.append(-told(other, doc) / len(doc))
            assert abs((slopes[0] - slopes[1]) / 2e-4 - got[at]) < 1e-4, (name, at)


def test_a_mark_is_what_stands_out():
    counts = np.array([[9, 1, 0], [0, 0, 0], [0, 3, 2], [1, 0, 0]])
    got = lmscore.marked(counts, np.array([20, 5, 10, 1000]), np.array([0.3, 0.3, 0.01]))
    assert got.tolist() == [0, 3, 2, 0]  # none occurs in the second; the last has one only, however rare it is there
    assert lmscore.marked(np.zeros((2, 0), int), np.array([1, 1]), np.zeros(0)).tolist() == [0, 0]


def test_groups_follow_what_is_written_together(spark, monkeypatch):
    """Two languages that share no word but one: the rarer words of each are in groups of its own, and shares of a group's words sum to one."""
    monkeypatch.setattr(lmscore, "CLASSES", 2)
    monkeypatch.setattr(lmscore, "SIZE", 2)
    monkeypatch.setattr(lmscore, "SHARE", 3)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["both", f"the{i % 2}", f"of{i % 2}", *(f"w{i % 2}x{k}" for k in rng.integers(0, 60, 30))])) for i in range(80)]
    docs = spark.createDataFrame([*rows, (90, None), (91, "")], "doc_id long, text string")
    counts = lmscore.word_counts(docs).orderBy(F.desc("c"), "h").toPandas()
    words = lmscore.Vocabulary(counts["h"].to_numpy(np.int64).view(np.uint64), counts["c"].to_numpy(np.int64))
    assert words.marks == 3
    words.grouped(lmscore.groups(lmscore.ranked(docs, words, 3), words, int(words.ranked.sum())))
    of = lambda side: {int(i) for i in words.look(lmscore.words_of([" ".join(f"w{side}x{k}" for k in range(60))]).hashes)[0] if i >= words.own}
    assert of(0) and of(1) and not of(0) & of(1)
    for g in range(words.own, words.last):
        mine = words.ids == g
        assert not mine.any() or abs((10 ** words.share[mine]).sum() - 1) < 1e-9
    assert words.totals.sum() + words.counts.sum() == words.ranked.sum()


def test_places_of_words_by_first_bits():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 5, 1000):
        h = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) if n != 5 else np.arange(7, 12, dtype=np.uint64)  # all in one place, and after the last
        words = lmscore.Vocabulary(h, np.arange(n, 0, -1))
        asked = np.concatenate((h, rng.integers(0, 1 << 64, 500, np.uint64, endpoint=False), np.array([0, 6, 13, (1 << 64) - 1], np.uint64)))
        want = [list(words.h).index(x) if x in words.h else -1 for x in asked]
        assert words.at(asked).tolist() == want


def test_steps_of_many_cases_are_whole_rows():
    """Columns are cases; each is what the formulas say."""
    p, rng, n = model(7), np.random.default_rng(8), gru.HIDDEN
    x, h = rng.normal(size=(3 * n, 5)), rng.normal(size=(n, 5))
    got, (_, z, r, _, new) = gru.step(p, x, h)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for i in range(5):
        k = h[:, i] @ p["u"]
        zi, ri = sigmoid(x[:n, i] + k[:n]), sigmoid(x[n : 2 * n, i] + k[n : 2 * n])
        want = np.tanh(x[2 * n :, i] + ri * k[2 * n :])
        assert np.allclose(z[:, i], zi) and np.allclose(r[:, i], ri) and np.allclose(new[:, i], want)
        assert np.allclose(got[:, i], zi * h[:, i] + (1 - zi) * want)
    assert z.flags.c_contiguous and r.flags.c_contiguous


def test_words_are_found_in_few_texts_at_a_time(monkeypatch):
    texts = [None, "", "One two two", "x " * 50, "three", "  "] * 4
    batch = pa.RecordBatch.from_pydict({"text": texts})
    want = lmscore.tokens_of(batch)
    seen, words_of = [], lmscore.words_of
    monkeypatch.setattr(lmscore, "AT_ONCE", 60)
    monkeypatch.setattr(lmscore, "words_of", lambda x: seen.append(len(x)) or words_of(x))
    got = lmscore.tokens_of(batch)
    assert len(seen) > 3 and sum(seen) == len(texts)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, want, strict=True))
    assert got[1].tolist() == [1, 1, 4, 51, 2, 1] * 4 and [len(x) for x in lmscore.tokens_of(batch.slice(0, 0))] == [0, 0]


def test_one_document_alone_scores_as_token_by_token():
    p, doc = model(3), np.append(np.random.default_rng(2).integers(1, WORDS + GROUPS, 150), END)
    got = gru.score_documents({k: v.astype(np.float32) for k, v in p.items()}, [doc], SIZE, END)
    assert np.allclose(got, [told(p, doc)], rtol=1e-4)


def test_documents_abreast_and_cases_at_once_are_bounded(monkeypatch):
    """Documents in groups and cases in parts score as token by token, and one softmax does the words of all classes."""
    p, rng = model(9), np.random.default_rng(10)
    docs = [np.append(rng.integers(1, WORDS + GROUPS, n), END) for n in (5, 0, 130, 64, 1, 70, 63)]
    for name, most in (("ABREAST", 3), ("AT_ONCE", 4), ("CASES", 10)):
        monkeypatch.setattr(gru, name, most)
    widths, softmax, step = {"cases": [], "documents": []}, gru._softmax, gru.step
    monkeypatch.setattr(gru, "_softmax", lambda x, *more: widths["cases"].append(x.shape[1]) or softmax(x, *more))
    monkeypatch.setattr(gru, "step", lambda p, x, h: widths["documents"].append(x.shape[1]) or step(p, x, h))
    got = gru.score_documents({k: v.astype(np.float32) for k, v in p.items()}, docs, SIZE, END)
    assert np.allclose(got, [told(p, d) for d in docs], rtol=1e-4)
    assert max(widths["cases"]) <= 10 and max(widths["documents"]) == 3 and sum(widths["documents"]) == sum(map(len, docs))
    widths["cases"].clear()
    gru.outputs(p, rng.normal(size=(8, gru.HIDDEN)), np.array([0, 1, 3, 5, 6, 7, 8, 4]), SIZE)
    assert widths["cases"] == [4, 4, 5]  # classes in two parts; the five words of both classes at once


def test_arrays_kept_from_window_to_window_change_nothing():
    p, rng = model(11), np.random.default_rng(12)
    grid = rng.integers(0, WORDS + GROUPS, (14, 3))
    kept, fresh = gru.Trainer(p, SIZE, END), gru.Trainer(p, SIZE, END)
    h = g = np.zeros((3, gru.HIDDEN))
    rooms = []
    for t in (0, 4, 8):  # two windows of four, one of five
        width = 5 if t == 8 else 4
        h = kept._window(grid[t : t + width], grid[t + 1 : t + 1 + width], h)
        fresh.room = None
        g = fresh._window(grid[t : t + width], grid[t + 1 : t + 1 + width], g)
        rooms.append(kept.room)
    assert rooms[0] is rooms[1] and rooms[1] is not rooms[2]
    assert (h == g).all() and all((kept.p[k] == fresh.p[k]).all() for k in p)
