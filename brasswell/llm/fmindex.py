"""Benchmark decontamination by an FM-index for each shard of the training documents.

A shard is a bounded run of documents. Its words become symbols: the benchmark's words are numbered, runs of others and document ends are
one separator. Suffixes are ordered by prefix doubling; the transform goes into a wavelet tree of bit ranks. All phrases walk backwards through it at once, occurrences are located by
walking to sampled suffix positions, and the spans of each document are merged.

Phrases are taken in blocks of about ``BLOCK`` words, so the benchmark may have any size; each block is a pass over the documents, and what a
pass found is written before the next one.
Null and empty texts have no words and are never hit; items without words have no phrase; items of one id count once, with the phrases of all of them;
rows of one id are searched each. A benchmark id that is null is left out of items_sha256 but its phrases count. Very long texts are one shard.
Columns that clash with results are replaced. Empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brasswell.llm.common import Scratch, chunks, restored, sheltered, table, texts_of
from brasswell.llm.wordhash import NOT_ALNUM, words_of

WINDOW = 10
SAMPLED = 8
BLOCK = 1 << 20


class Wavelet:
    """Ranks of symbols in a sequence: a bit row for each level, the sequence being stably parted by that bit from level to level."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of each symbol stand before the places."""
        low, high = np.zeros_like(at), at
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places and how many of the same stand before each."""
        symbol, low, high = np.zeros_like(place), np.zeros_like(place), place
        for k in range(self.levels):
            ones = self.ones[k]
            one = ones[high + 1] > ones[high]
            symbol = symbol * 2 + one
            a, b = ones[low], ones[high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return symbol, high - low


class FmIndex:
    """Index of a sequence of symbols below size. 0 separates: each separator sorts as a symbol of its own, by its place, so
    repeats end there and prefix doubling soon has every suffix apart."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        text = np.concatenate((symbols, [0])).astype(np.int64)
        self.n, span = len(text), 1
        gaps = np.cumsum(text == 0)
        rank = np.unique(np.where(text == 0, gaps - 1, text + gaps[-1]), return_inverse=True)[1]
        while int(rank.max()) + 1 < self.n:
            rank = np.unique(rank * (int(rank.max()) + 1) + np.roll(rank, -span), return_inverse=True)[1]
            span *= 2
        self.order = np.empty(self.n, np.int64)
        self.order[rank] = np.arange(self.n)
        before = text[self.order - 1]
        self.tree = Wavelet(before, size)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.kept = (self.order % SAMPLED == 0) | (before == 0)  # no walk crosses a separator

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (rows of a matrix, filled from the left)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            c = phrases[live, lengths[live] - back]
            low[live] = self.starts[c] + self.tree.rank(c, low[live])
            high[live] = self.starts[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in the rows: steps back to a sampled place, whose position is kept."""
        place, steps, now = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64), rows.copy()
        live = np.arange(len(rows))
        while len(live):
            done = self.kept[now[live]]
            place[live[done]] = self.order[now[live[done]]] + steps[live[done]]
            live = live[~done]
            symbol, before = self.tree.at(now[live])
            now[live] = self.starts[symbol] + before
            steps[live] += 1
        return place


def blocks_of(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """item_id, text and block, dealt by digest into so many blocks that one holds about BLOCK words (no more than its bytes)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // (BLOCK * 4)))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def phrases_of(items: DataFrame) -> list[tuple[str, np.ndarray]]:
    """Item ids with their word hashes, of one block."""
    return [(r.item_id, words_of([r.text or ""], NOT_ALNUM).hashes) for r in items.toLocalIterator()]


def _prepared(rows: list[tuple[str, np.ndarray]], window: int):
    """Vocabulary (sorted hashes), phrases as a matrix of symbols, their lengths, and which items have each phrase."""
    vocab = np.unique(np.concatenate([w for _, w in rows])) if rows else np.zeros(0, np.uint64)
    items: dict[tuple[int, ...], set[str]] = {}
    for item, w in rows:
        ids = (np.searchsorted(vocab, w) + 1).tolist()
        width = min(window, len(ids))
        for i in range(len(ids) - width + 1 if width else 0):
            items.setdefault(tuple(ids[i : i + width]), set()).add(item)
    phrases = np.zeros((len(items), window), np.int64)
    for k, p in enumerate(items):
        phrases[k, : len(p)] = p
    return vocab, phrases, np.array([len(p) for p in items], np.int64), [sorted(x for x in v if x is not None) for v in items.values()]


HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(texts: list[str], prepared) -> tuple[list[int], list[list[tuple[int, int]]], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text its number of words, hit spans in words and in bytes (ends exclusive, merged), and the items found."""
    vocab, phrases, lengths, items = prepared
    w = words_of(texts, NOT_ALNUM)
    counts = np.diff(w.bounds)
    spans, raw, found = [[] for _ in texts], [[] for _ in texts], [set() for _ in texts]
    if len(phrases) and len(w.hashes):
        k = np.minimum(np.searchsorted(vocab, w.hashes), len(vocab) - 1)
        symbols = np.where(vocab[k] == w.hashes, k + 1, 0)
        doc = np.repeat(np.arange(len(texts)), counts)
        known = (symbols > 0)
        known_next = np.concatenate((known[1:], [False]))
        same = np.concatenate((doc[1:] == doc[:-1], [False]))
        # one separator for each run of other words, and one behind each document
        keep = known | (known_next & same & ~known)
        at = np.flatnonzero(keep)
        new_doc = np.concatenate(([False], doc[at][1:] != doc[at][:-1])) if len(at) else np.zeros(0, bool)
        text = np.insert(symbols[at], np.flatnonzero(new_doc), 0)
        back = np.insert(at, np.flatnonzero(new_doc), -1)
        if len(text):
            index = FmIndex(text, len(vocab) + 1)
            low, high = index.find(phrases, lengths)
            number = high - low
            which = np.repeat(np.arange(len(phrases)), number)
            if len(which):
                rows = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number) + low[which]
                place = back[index.locate(rows)]
                mark = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(mark, place, 1)
                np.add.at(mark, place + lengths[which], -1)
                hit = np.concatenate(([False], np.cumsum(mark[:-1]) > 0, [False]))
                edges = np.flatnonzero(hit[1:] != hit[:-1])
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    while a < b:
                        d = int(doc[a])
                        e = min(b, int(w.bounds[d + 1]))
                        spans[d].append((a - int(w.bounds[d]), e - int(w.bounds[d])))
                        raw[d].append((int(w.starts[a] - w.offsets[d]), int(w.ends[e - 1] - w.offsets[d])))
                        a = e
                for p, d in set(zip(which.tolist(), doc[place].tolist(), strict=True)):
                    found[d].update(items[p])
    return counts.tolist(), spans, raw, [sorted(f) for f in found]


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, then: Callable | None = None, then_schema: T.StructType | None = None) -> DataFrame:
    """docs with n_words, hits and byte_hits (spans in words and in bytes) and items. No shuffle; a pass for each block.
    then: what the last pass does with these rows in the same worker, and the schema of what it gives."""
    added = {"n_words": T.LongType(), "hits": HITS, "byte_hits": HITS, "items": T.ArrayType(T.StringType())}
    out = docs.select(*[c for c in docs.columns if c not in added])
    schema = T.StructType([*out.schema.fields, *(T.StructField(k, v) for k, v in added.items())])
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one_pass(rows, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            prepared = _prepared(rows, window)
            for batch in chunks(batches):
                counts, spans, raw, items = scan(texts_of(batch), prepared)
                columns = batch.columns
                if not first:
                    spans, raw = ([_merged(x, [(p["start"], p["end"]) for p in y]) for x, y in zip(new, batch.column(c).to_pylist(), strict=True)] for new, c in ((spans, "hits"), (raw, "byte_hits")))
                    items = [sorted({*x, *y}) for x, y in zip(items, batch.column("items").to_pylist(), strict=True)]
                    columns = columns[:-4]
                told = [pa.array([[{"start": a, "end": b} for a, b in x] for x in y], pairs) for y in (spans, raw)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), *told, pa.array(items, pa.list_(pa.string()))], schema.names)

        return run

    items, n = blocks_of(benchmark)
    scratch = Scratch(docs.sparkSession)
    for k in range(n):  # the driver and the tasks hold one block at a time; rows are written between passes
        step = one_pass(phrases_of(items.where(F.col("block") == k)), k == 0)
        if k < n - 1:
            out = scratch.keep("pass", out.mapInArrow(step, schema))
        elif then:
            out = out.mapInArrow(lambda batches, step=step: then(step(batches)), then_schema)
        else:
            out = out.mapInArrow(step, schema)
    return out


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same columns; hit words, with what stands between them, are cut out of the text, and n_chars follows where it is there."""
    own = [c for c in ("text", "n_chars") if c in docs.columns]
    inner = sheltered(docs, *own)
    names = inner.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            hits = batch.column("byte_hits").to_pylist()
            for i, spans in enumerate(hits):
                if spans:
                    raw, out, at = texts[i].encode(), [], 0
                    for s in spans:
                        out.append(raw[at : s["start"]])
                        at = s["end"]
                    texts[i] = b"".join([*out, raw[at:]]).decode()
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                n_chars = columns["n_chars"]
                columns["n_chars"] = pa.array([n if not h else len(t) for n, h, t in zip(n_chars.to_pylist(), hits, texts, strict=True)], n_chars.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return find_leaks(inner, benchmark, window, run, inner.schema).select(*restored(docs, *own))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
