"""Order-preserving packing of token streams by dynamic programming.

Each task takes its documents in their order, encodes them with an end id each and joins the ids to one stream. Windows of at most
``size`` ids are cut from it: a cut at a document's end is free, one behind a sentence costs ``SENTENCE``, one at a forced place
(only where no boundary stands within half a window) ``FORCED``; a window costs its padding. The cheapest cuts come from one pass with a monotone queue.
Memory is bounded: a stream is packed whenever it holds ``STREAM`` ids, and what its last window would leave open is carried on.

What is left at a task's end, less than a window, isn't padded there: the rests of ``TOGETHER`` tasks in a row are joined in their order and packed
the same way, so many small tasks pad no more than a few large ones. The last window of those is padded.

A null or empty text is the end id alone; ids are whole numbers or null; repeated rows are packed each; ties between cuts go to the earliest.
Extra columns are not returned; an empty table gives an empty result. Texts of any length are packed whole, cut where needed.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.llm.common import chunks, table, texts_of, written
from brasswell.llm.tokens import encode_all, encoder

SIZE = 2048
END = 1
SENTENCE, FORCED = 16, 512
STREAM = 1 << 18
TOGETHER = 64
#: Longer texts are encoded in chunks.
CHUNK_CHARS = 1 << 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def _sentence_ids(ranks: str) -> np.ndarray:
    e = encoder(ranks)
    return np.array([e.decode_single_token_bytes(i).rstrip(b" \"')")[-1:] in (b".", b"!", b"?", b"\n") for i in range(e.n_vocab)])


def cuts_of(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, size: int = SIZE) -> list[int]:
    """Ends of the cheapest windows over the stream, up to the last boundary from which a full window no longer fits."""
    n = len(ids)
    price = np.full(n + 1, -1, np.int32)
    price[1:][sentence] = SENTENCE
    price[doc_ends] = 0
    price[[0, n]] = 0
    at = np.flatnonzero(price >= 0)
    for gap in np.flatnonzero(np.diff(at) > size // 2):  # no boundary for long: any place in steps of half a window
        price[np.arange(at[gap] + size // 2, at[gap + 1], size // 2)] = FORCED
    at = np.flatnonzero(price >= 0).tolist()
    cost = price[at].tolist()
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # places by growing best - position
    for j in range(1, len(at)):
        while at[queue[0]] < at[j] - size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        best[j] = best[i] + size - (at[j] - at[i]) + (cost[j] if at[j] < n else 0)
        key = best[j] + at[j]
        while queue and best[queue[-1]] + at[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    j = len(at) - 1
    low = at[j] - size
    tail = [k for k in range(max(0, j - size), j + 1) if at[k] > low]
    j = min(tail, key=lambda k: (best[k] + at[k], -at[k]))  # as few windows as there can be, then the shortest rest, which stays open
    found = []
    while j:
        found.append(at[j])
        j = back[j]
    return found[::-1]


class _Stream:
    """Documents that wait for their windows. docs: doc_id, its ids before those here, its place here, all its ids."""

    def __init__(self, base: int, ranks: str, size: int) -> None:
        self.next, self.ranks, self.size = base, ranks, size
        self.parts: list[np.ndarray] = []
        self.held, self.docs = 0, []

    def add(self, doc_id, before: int, total: int, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.docs.append((doc_id, before, self.held, total))
        self.held += len(ids)

    def rows(self, last: bool = False) -> Iterator[tuple]:
        """The pieces of the cheapest windows, which leave the stream; if last, of all ids."""
        ids = np.concatenate([np.zeros(0, np.uint32), *self.parts])
        n = len(ids)
        ends = np.array([p + t - b for _, b, p, t in self.docs], np.int64)
        cuts = cuts_of(ids, ends, _sentence_ids(self.ranks)[ids], self.size) if n > self.size else []
        if last and n > (cuts[-1] if cuts else 0):
            cuts.append(n)
        k, low = 0, 0
        for high in cuts:
            at = low
            while at < high:
                doc_id, before, place, total = self.docs[k]
                stop = min(high, int(ends[k]))
                yield doc_id, before + at - place, stop - at, zlib.crc32(ids[at:stop].astype("<u4").tobytes()), total, self.next, at - low
                if stop == ends[k]:
                    k += 1
                at = stop
            self.next += 1
            low = high
        self.parts, self.held = [ids[low:]], n - low
        self.docs = [(d, b + max(0, low - p), max(0, p - low), t) for d, b, p, t in self.docs[k:]]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)


def pack(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", size: int = SIZE) -> DataFrame:
    """A row for each piece of a document in a sequence. Texts aren't shuffled, only the rests of tasks, less than ``size`` ids of each."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rest_schema = "task long, rest binary, rest_id array<long>, rest_before array<long>, rest_total array<long>"
    kinds = (pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        stream = _Stream(task << 40, ranks, size)
        rest_names = [x.split()[0] for x in rest_schema.split(", ")]

        def told(rows: list[tuple], rest: list) -> pa.RecordBatch:
            both = [*_batch(rows, names).columns, *(pa.nulls(len(rows), k) for k in kinds)] if rows else [*(pa.nulls(1, pa.int64()) for _ in names), *(pa.array([v], k) for v, k in zip(rest, kinds, strict=True))]
            return pa.RecordBatch.from_arrays(both, [*names, *rest_names])

        for batch in chunks(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_all(texts_of(batch), ranks, CHUNK_CHARS), strict=True):
                stream.add(doc_id, 0, len(ids) + 1, np.append(ids, np.uint32(END)))
            if stream.held >= STREAM and (rows := list(stream.rows())):
                yield told(rows, [])
        if rows := list(stream.rows()):
            yield told(rows, [])
        if stream.held:
            ids, before, _, total = zip(*stream.docs, strict=True)
            yield told([], [task, np.concatenate(stream.parts).astype("<u4").tobytes(), ids, before, total])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, group = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["task"] // TOGETHER != group:
                    if stream:
                        yield _batch(list(stream.rows(last=True)), names)
                    group = r["task"] // TOGETHER
                    stream = _Stream((1 << 62) + (group << 20), ranks, size)
                ids, at = np.frombuffer(r["rest"], "<u4"), 0
                for d, b, t in zip(r["rest_id"], r["rest_before"], r["rest_total"], strict=True):
                    stream.add(d, b, t, ids[at : at + t - b])
                    at += t - b
        if stream:
            yield _batch(list(stream.rows(last=True)), names)

    made = written(docs.select("doc_id", "text").mapInArrow(run, f"{SCHEMA}, {rest_schema}"))
    rests = made.where("task is not null").select("task", "rest", "rest_id", "rest_before", "rest_total")
    joined = rests.repartition(F.floor(F.col("task") / TOGETHER)).sortWithinPartitions("task").mapInArrow(join_up, SCHEMA)
    return made.where("task is null").select(*names).union(joined)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
