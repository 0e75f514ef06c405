"""LM scoring: word counts over the whole training part, a recurrent model trained on all of it, and whole documents scored.

Counts are grouped by Spark over 64-bit word hashes. The ``FREQUENT`` most frequent words (a documented bound) go to the tasks with their counts,
the first of them are predicted word by word, the others by groups; counts of all rarer words are joined. A document's mark is the one of the
most frequent words that stands out most in it; a word's group is the mark among whose documents it stands out most, so groups follow what is
written together (a language, a form). The number of groups grows with the root of the number of words. The model is trained by every task on
its own training documents, and the tasks' weights are averaged by tokens; ``ROUNDS`` times, each time on another part of the documents and
from the average before, which makes one pass over all of them. Scoring carries the state through the whole document.

Null text counts as empty: the end alone. Null ids are in the training part by crc32 of the empty text. Repeated rows are counted and scored
each (rows carry their own number); ids are whole numbers. Ties in counts go to the smaller hash, of marks to the more frequent one. Texts of
any length are read whole. Columns beside id and text aren't used; with no training documents the model is the untrained one and N and V are
0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.llm import gru
from brasswell.llm.common import Scratch, chunks, crc_of_id, table, texts_of, written
from brasswell.llm.wordhash import words_of

CLASSES, SIZE = 40, 40
FREQUENT = 100_000
#: Marks: the root of the number of words that are grouped, divided by this.
SHARE = 8
POOL = 1 << 21
#: Text whose words are found at once, in bytes.
AT_ONCE = 1 << 17
END = np.uint64(1)
MERGE = 16
ROUNDS = 3


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the batch's texts, each text's end behind it, and how many each text has. Words are found in few texts at a time, whose arrays stay small."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in chunks([batch], limit=AT_ONCE):
        w = words_of(texts_of(part))
        hashes.append(np.insert(w.hashes, w.bounds[1:], END))
        sizes.append(np.diff(w.bounds) + 1)
    return np.concatenate(hashes), np.concatenate(sizes)


def word_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, n = np.unique(tokens_of(batch)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words by rank (sorted by hash): counts, the model's id of each, and log10 of its share in its group (0: it has an id of its own).

    Ids are the first ``CLASSES * SIZE`` words', then the groups'; the last group (id ``last``) is that of all words that aren't here.
    """

    def __init__(self, h: np.ndarray, c: np.ndarray) -> None:
        self.rank = np.argsort(h)
        self.h, self.c = h[self.rank], c[self.rank]
        self.bits = np.uint64(64 - max(1, len(h).bit_length()))
        self.begins = np.searchsorted(self.h, np.arange(1 << (64 - int(self.bits)), dtype=np.uint64) << self.bits)
        self.most = int(np.diff(np.append(self.begins, len(h))).max())
        self.own = CLASSES * SIZE
        self.marks = math.isqrt(max(0, len(h) - self.own)) // SHARE
        self.ranked = c
        self.grouped(np.full(len(h), self.marks))

    def grouped(self, group: np.ndarray) -> None:
        """Takes each rank's group (0 to ``marks``; of no meaning for words with ids of their own)."""
        n, own = len(self.ranked), self.own
        self.counts = np.zeros(own, np.int64)
        self.counts[: min(n, own)] = self.ranked[:own]
        self.totals = np.bincount(group[own:], self.ranked[own:], self.marks + 1)
        self.last = own + self.marks + 1
        ids, share = np.arange(n), np.zeros(n)
        ids[own:] = own + group[own:]
        share[own:] = np.log10(self.ranked[own:] / self.totals[group[own:]])
        self.of_rank, self.ids, self.share = ids, ids[self.rank].astype(np.int32), share[self.rank]
        ends = np.flatnonzero(self.h == END)
        self.end = int(self.ids[ends[0]]) if len(ends) else self.last

    def at(self, h: np.ndarray) -> np.ndarray:
        """Places in the sorted words, -1: none."""
        if not len(self.h):
            return np.full(len(h), -1)
        # Hashes are spread evenly: a look at the place where those of equal first bits begin, then at the few behind it.
        top = len(self.h) - 1
        k = np.minimum(self.begins[h >> self.bits], top)
        rest = np.flatnonzero(self.h[k] != h)
        for _ in range(self.most - 1):
            rest = rest[self.h[k[rest]] < h[rest]]
            k[rest] = np.minimum(k[rest] + 1, top)
        return np.where(self.h[k] == h, k, -1)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The model's ids, the counts (-1: not among the frequent words) and the shares."""
        if not len(self.h):
            return np.full(len(h), self.last, np.int32), np.full(len(h), -1, np.int64), np.zeros(len(h))
        k = self.at(h)
        hit = k >= 0
        return np.where(hit, self.ids[k], self.last), np.where(hit, self.c[k], -1), np.where(hit, self.share[k], 0.0)


def marked(counts: np.ndarray, sizes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Of each document (a row of counts of the marks), the mark that stands out most against its rate in all text; their number: none occurs."""
    if not counts.shape[1]:
        return np.zeros(len(counts), np.int64)
    stands = counts * np.log(np.maximum(counts, 1) / (sizes[:, None] * rates))
    best = np.where(counts > 0, stands, -np.inf).argmax(axis=1)
    return np.where(counts.any(axis=1), best, counts.shape[1])


def ranked(docs: DataFrame, words: Vocabulary, rounds: int) -> DataFrame:
    """The training part's words as ranks (-1: not among the frequent), to be written once for all that reads them: a row for each chunk and round of
    training, with ranks and the documents' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, sizes = tokens_of(batch)
            k = words.at(h)
            rank = np.where(k >= 0, words.rank[k], -1).astype("<i4") if len(words.h) else k.astype("<i4")
            of = batch.column("round").to_numpy(zero_copy_only=False)
            for r in np.unique(of):
                mine = of == r
                yield pa.RecordBatch.from_arrays([pa.array([int(r)]), pa.array([rank[np.repeat(mine, sizes)].tobytes()]), pa.array([sizes[mine].astype("<i4").tobytes()])], ["round", "ranks", "sizes"])

    part = F.pmod(F.xxhash64("doc_id"), F.lit(rounds)).alias("round")
    return docs.select("text", part).mapInArrow(run, "round long, ranks binary, sizes binary")


def rows_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[np.ndarray]:
    for batch in batches:
        for v in batch.column(column):
            yield np.frombuffer(v.as_buffer(), "<i4")


def groups(ranks: DataFrame, words: Vocabulary, total: int) -> np.ndarray:
    """The group of each rank, by votes of all documents; words without votes are in the last one that words here can have."""
    marks, out = words.marks, np.full(len(words.ranked), words.marks)
    if not marks:
        return out
    ends = words.rank[words.h == END]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, sizes in zip(rows_of([batch], "ranks"), rows_of([batch], "sizes"), strict=True):
                doc = np.repeat(np.arange(len(sizes)), sizes)
                votes = (rank >= 0) & (rank < marks) & ~np.isin(rank, ends)  # every document has an end
                counts = np.bincount(doc[votes] * marks + rank[votes], minlength=len(sizes) * marks).reshape(len(sizes), marks)
                mark = marked(counts, sizes, words.ranked[:marks] / total)
                grouped = rank >= words.own
                key, n = np.unique(rank[grouped] * np.int64(marks + 1) + mark[doc[grouped]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // (marks + 1)), pa.array(key % (marks + 1)), pa.array(n)], ["rank", "mark", "n"])

    votes = written(ranks.select("ranks", "sizes").mapInArrow(run, "rank long, mark long, n long").groupBy("rank", "mark").agg(F.sum("n").alias("n")))
    of_mark = {r.mark: r.n for r in votes.groupBy("mark").agg(F.sum("n").alias("n")).collect()}  # marks + 1 rows at most
    if not of_mark:
        return out
    rates = F.array(*[F.lit(of_mark.get(m, 0) / sum(of_mark.values())) for m in range(marks + 1)])
    words_votes = votes.groupBy("rank").agg(F.collect_list(F.struct("mark", "n")).alias("list"), F.sum("n").alias("all"))  # marks + 1 each at most
    stands = lambda x: x["n"] * F.log(x["n"] / (F.col("all") * F.element_at(rates, (x["mark"] + 1).cast("int"))))
    best = F.array_max(F.transform("list", lambda x: F.struct(stands(x).alias("s"), (-x["mark"]).alias("m"))))
    found = words_votes.select("rank", (-best["m"]).alias("mark")).toPandas()  # FREQUENT rows at most
    out[found["rank"].to_numpy(np.int64)] = found["mark"].to_numpy(np.int64)
    return out


def train(ranks: DataFrame, words: Vocabulary, start: np.ndarray, rounds: int) -> np.ndarray:
    """Weights after one pass over all ranks in as many parts as rounds: in each, every task goes on from the weights (and their sums of squared
    gradients) of the round before, on its own documents, and the tasks' are averaged by tokens."""
    state = np.concatenate((start, np.full(len(start), gru.SEEN, np.float32)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(state)), 0.0
        for batch in batches:
            for v, k in zip(batch.column("v"), batch.column("n").to_pylist(), strict=True):
                total += k * np.frombuffer(v.as_buffer(), "<f4")
                n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype("<f4").tobytes()]), pa.array([n])], ["v", "n"])

    def learnt(state: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, seen = (gru.unflat(x, CLASSES, SIZE, words.marks + 2) for x in np.split(state, 2))
            trainer, held, size, total = gru.Trainer(p, SIZE, words.end, seen), [], 0, 0
            table = np.append(words.of_rank, words.last).astype(np.int32)  # rank -1 is the last
            for rank in rows_of(batches, "ranks"):
                held.append(table[rank])
                size += len(held[-1])
                if size >= POOL:
                    trainer.learn(np.concatenate(held))
                    total, held, size = total + size, [], 0
            if size:
                trainer.learn(np.concatenate(held))
            if total + size:
                v = np.concatenate((gru.flat(trainer.p), gru.flat(trainer.seen))).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]), pa.array([float(total + size)])], ["v", "n"])

        return run

    for k in range(rounds):
        parts = written(ranks.where(F.col("round") == k).select("ranks").mapInArrow(learnt(state), "v binary, n double"))
        count = parts.count()
        while count > MERGE:
            count = -(-count // MERGE)
            parts = written(parts.repartition(count, F.pmod(F.xxhash64("v"), F.lit(count))).mapInArrow(merge, "v binary, n double"))
        rows = parts.orderBy("n", F.xxhash64("v")).collect()  # MERGE rows at most
        if n := sum(r.n for r in rows):
            state = sum(r.n / n * np.frombuffer(r.v, "<f4").astype(float) for r in rows).astype(np.float32)
    return state[: len(start)]


def score_texts(docs: DataFrame, training: DataFrame) -> DataFrame:
    """A row for each of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    counts = written(word_counts(training))
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
    words = Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64))
    scratch = Scratch(docs.sparkSession)
    ranks = scratch.keep("ranks", ranked(training, words, ROUNDS))
    words.grouped(groups(ranks, words, n_all))
    n_rare, v_rare = n_all - int(words.c.sum()), v_all - len(words.c)
    start = gru.flat(gru.initial(words.counts, np.append(words.totals, n_rare), CLASSES, SIZE))
    weights = train(ranks, words, start, ROUNDS)
    scratch.drop("ranks")
    all_log, rare_log = math.log10(n_all + v_all + 1), math.log10(n_rare + v_rare + 1)
    least = int(words.c.min()) if len(words.c) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, ids, facts, held = gru.unflat(weights, CLASSES, SIZE, words.marks + 2), [], [], 0

        def told() -> pa.RecordBatch:
            lm = gru.score_documents(p, ids, SIZE, words.end) / math.log(10)
            doc, n, known, base, in_rare, rare, times = zip(*facts, strict=True)
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.array(base) - np.array(n) * all_log), pa.array(lm + np.array(in_rare)), pa.array(rare, kind), pa.array(times, kind)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

        for batch in chunks(batches):
            h, sizes = tokens_of(batch)
            found, c, share = words.look(h)
            at, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            total = lambda x: np.bincount(doc, x, len(sizes))
            unknown = c < 0
            out = np.flatnonzero(unknown)
            cuts = np.searchsorted(out, np.append(at, len(h)))
            known, base = total(c > 0).astype(np.int64).tolist(), total(np.log10(np.maximum(c, 0) + 1)).tolist()
            inside = (total(share) - total(unknown) * rare_log).tolist()
            for i, (d, a, n) in enumerate(zip(batch.column("doc_id").to_pylist(), at.tolist(), sizes.tolist(), strict=True)):
                rare, times = np.unique(h[out[cuts[i] : cuts[i + 1]]].view(np.int64), return_counts=True)
                facts.append((d, n, known[i], base[i], inside[i], rare, times))
                ids.append(found[a : a + n])
            held += len(h)
            if held >= POOL:
                yield told()
                ids, facts, held = [], [], 0
        if ids:
            yield told()

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<long>"
    scored = written(docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    # Words outside the frequent ones: at most as often as the least of those, so their joins have no hot key in training words.
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    known = rare.join(counts.where(F.col("c") <= least), "h").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log"))
    out = scored.drop("rare", "times").join(known, "row", "left").na.fill(0, ["more", "log"])
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("log")).alias("base_score"), (F.col("score") + F.col("log")).alias("score"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, docs.where(crc_of_id() % 7 != 2))
    return out.withColumn("held_out", crc_of_id() % 7 == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
