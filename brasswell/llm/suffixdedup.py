"""Substring dedup by a suffix array in blocks with a difference cover: bytes that lie in a string of ``LEAST`` bytes which starts anywhere else too go.

Only suffixes that may have a partner are sorted. In each window of ``LEAST`` bytes the gram of least hash is its key, so equal windows have one key at one
distance; neighbouring windows with the same key are a record. Keys that occur once are dropped in one partial aggregate, and only
texts that hold others are read again. Texts that are equal are one text before anything else.

The suffixes of one key are a bucket, and a task sorts a few buckets at a time (``BATCH`` bytes). Places are counted from the key's gram backwards.
Those whose count is in a difference cover modulo 57 are the sample: any two suffixes reach places of the sample after the same number of bytes, at most 18.
Sample suffixes are sorted first, the gram's own by their bytes, those of each next place by the few bytes before the last one and its ranks; beside
the order stands how much neighbours have in common. A suffix is then told by the bytes up to the sample and, for ties however long, by the sample's order, cut where
neighbours share less than what is left of the window. So memory is that of the bucket's text and some ranks, not of its suffixes times their length. Buckets of
more than ``HOT`` records are not sorted in one task: of records with equal content (128-bit digests in a partial aggregate) one stays, and those are cut to
fewer distances of the start before the gram (``STEPS``), whose common bytes are part of their key, until a bucket can be sorted. That finds the same strings.

A text counts as UTF-8 bytes, null as empty; no string crosses texts. Rows that repeat, with or without an id, are texts of their own: if LEAST bytes or longer,
all of them go. Order and ties don't matter, since no occurrence stays. Very long texts are marked in slices; an empty table gives an empty result; columns
that clash with results are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.llm.common import Scratch, chunks, table, unused
from brasswell.llm.wordhash import mix

LEAST, GRAM = 200, 48
#: Farthest that a gram stands behind the start of its window.
AHEAD = LEAST - GRAM
#: Bytes of a long text that are marked at once; content of the buckets that are sorted at once; records of the largest bucket that a task sorts.
SLICE, BATCH, HOT = 1 << 22, 1 << 21, 1 << 10
#: Bytes of short texts that are marked at once (hashes take some dozens of bytes for each); tables of powers grow by as many.
STRIDE = 1 << 18
#: Distances of a bucket's windows, from step to step of cutting buckets that are too large; at one distance, all contents of a key are equal.
STEPS = (39, 10, 3, 1)
#: A difference cover (fixed values): each residue modulo 57 is a difference of two of these.
MODULO, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
SAMPLE = [d for d in range(AHEAD + 1) if d % MODULO in COVER]
FACTORS = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95)
SPANS = "array<struct<start: long, end: long>>"


#: Of each factor the powers that were asked for last, and more if they are there: one table, whatever sizes texts have.
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to size of the factor and of its inverse, at least."""
    if factor not in POWERS or len(POWERS[factor][0]) <= size:
        steps = -(-size // STRIDE) * STRIDE
        POWERS[factor] = tuple(np.cumprod(np.append(np.uint64(1), np.full(steps, f, np.uint64))) for f in (factor, pow(factor, -1, 1 << 64)))
    return POWERS[factor]


class Sums:
    """Prefix sums of a polynomial hash over bytes."""

    def __init__(self, data: np.ndarray, factor: int) -> None:
        ahead, self.back = _powers(factor, len(data))
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(factor))
        self.sums = np.append(np.uint64(0), np.cumsum(values[data] * ahead[: len(data)]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def windowed_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    least, w = values, 1
    while 2 * w <= width:
        least, w = np.minimum(least[:-w], least[w:]), 2 * w
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - w : width - w + n])


def records_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts in a row: number of the text, first and last window and gram (places in data), key of each record, and its content's digest (two words)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    if len(data) < LEAST:
        return none
    sums = Sums(data, FACTORS[0])
    starts = np.arange(len(data) - GRAM + 1)
    grams = sums.of(starts, starts + GRAM)
    low = np.uint64((1 << 24) - 1)
    # Of equal grams the first: their place is in the low bits.
    at = (windowed_least((grams & ~low) | starts.astype(np.uint64), AHEAD + 1) & low).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    window = np.flatnonzero(np.arange(len(at)) + LEAST <= bounds[1:][text])
    if not len(window):
        return none
    at, text = at[window], text[window]
    begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    first, last = window[begin], window[np.append(begin[1:], len(window)) - 1]
    other = Sums(data, FACTORS[1])
    return text[begin], first, last, at[begin], grams[at[begin]], sums.of(first, last + LEAST), other.of(first, last + LEAST)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans as few as possible, by start; those that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def marks_of(raw: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text: key, first, last, at of the records that don't repeat one of the same text, and starts and ends of what repeats in it."""
    kept: list[list[tuple]] = [[] for _ in raw]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.cumsum([0, *map(len, raw)])
    if len(data) <= SLICE:
        parts = [(records_of(data, bounds), 0)]
    else:  # texts one by one, long ones in slices
        parts = []
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            for s in range(a, max(a + 1, b - LEAST + 1), SLICE):
                e = min(s + SLICE + LEAST - 1, b)
                _, *x = records_of(data[s:e], np.array([0, e - s]))
                parts.append(((np.full(len(x[0]), k), *x), s))
    for (text, first, last, at, key, a, b), s in parts:
        cuts = np.searchsorted(text, np.arange(len(raw) + 1))
        for k in range(int(text[0]), int(text[-1]) + 1) if len(text) else ():
            i, j, zero = cuts[k], cuts[k + 1], bounds[k] - s
            kept[k].append((key[i:j], first[i:j] - zero, last[i:j] - zero, at[i:j] - zero, a[i:j], b[i:j]))
    for k, (own, some) in enumerate(zip(raw, kept, strict=True)):
        if not sum(len(x[0]) for x in some):
            yield (np.zeros(0, np.int64),) * 6
            continue
        key, first, last, at, a, b = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.lexsort((b, a))
        same = np.append(False, (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]))
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        again, gone, whence = np.zeros(len(order), bool), np.zeros(len(order), bool), order[same]
        for x, y in zip(whence.tolist(), lead[same].tolist(), strict=True):
            if own[first[x] : last[x] + LEAST] == own[first[y] : last[y] + LEAST]:
                again[[x, y]], gone[x] = True, True
        yield (key[~gone].view(np.int64), first[~gone], last[~gone], at[~gone], *merged(first[again], last[again] + LEAST))


MARKS = {"key": "long", "first": "int", "last": "int", "at": "int", "own_start": "int", "own_end": "int"}


def marks(docs: DataFrame) -> DataFrame:
    """digest (of the text) and row with the arrays of marks_of(). docs: digest, row, text."""
    kinds = {"long": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=STRIDE):
            raw = [x.encode() for x in batch.column("text").to_pylist()]
            columns = list(zip(*marks_of(raw), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("row"), *(pa.array(list(c), pa.list_(kinds[k])) for c, k in zip(columns, MARKS.values(), strict=True))], ["digest", "row", *MARKS])

    return docs.select("digest", "row", "text").mapInArrow(run, "digest binary, row long, " + ", ".join(f"{c} array<{k}>" for c, k in MARKS.items()))


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Bytes in rows as big-endian words, whose order is that of the bytes (the last word is filled up with zeros)."""
    n = -(-rows.shape[1] // 8)
    full = np.zeros((len(rows), 8 * n), np.uint8)
    full[:, : rows.shape[1]] = rows
    return list(full.view(">u8").astype(np.uint64).T)


def _common(rows: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """How many leading bytes each row has in common with the one before; -1 where that is of another bucket."""
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.append(-1, np.where(bucket[1:] == bucket[:-1], n, -1)).astype(np.int16)


def shared_suffixes(bucket: np.ndarray, content: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which suffixes of each record share their first LEAST bytes with another of the bucket: one row for each record, one column for each distance of the
    start before the gram. content: bytes from AHEAD before the gram on to LEAST behind its start, zeros where a record has none; low, high: the record's distances."""
    m = len(bucket)
    found = np.zeros((m, AHEAD + 1), bool)
    alive, ranks = np.arange(m), None
    for j, d in enumerate(SAMPLE):
        alive = alive[high[alive] >= d] if ranks is None else alive
        if ranks is not None:
            stay = high[alive] >= d
            alive, ranks = alive[stay], ranks[stay]
        if not len(alive):
            break
        rows, b = content[alive], bucket[alive]
        zero = AHEAD - d
        # The order of the sample suffixes d before the gram: the bytes down to the place before, then that one's ranks.
        if ranks is None:
            order = np.lexsort((*_words(rows[:, zero : zero + LEAST])[::-1], b))
        else:
            order = np.lexsort((ranks, *_words(rows[:, zero : zero + d - SAMPLE[j - 1]])[::-1], b))
        ranks = np.empty(len(alive), np.int64)
        ranks[order] = np.arange(len(alive))
        ahead = _common(rows[order, zero : zero + LEAST], b[order])
        upto = (SAMPLE[j + 1] if j + 1 < len(SAMPLE) else AHEAD + 1) - d
        if upto > 1:
            behind = rows[:, zero - upto + 1 : zero][:, ::-1]
            left = np.lexsort((*_words(behind)[::-1], b))
            back = _common(behind[left], b[left])
        for s in range(upto):
            here = (low[alive] <= d + s) & (high[alive] >= d + s)
            if not here.any():
                continue
            name = np.empty(len(alive), np.int64)
            name[order] = np.cumsum(ahead < LEAST - s)
            if s:
                other = np.empty(len(alive), np.int64)
                other[left] = np.cumsum(back < s)
                name += other * (len(alive) + 1)
            mine = np.flatnonzero(here)
            by = mine[np.argsort(name[mine])]
            same = name[by][1:] == name[by][:-1]
            found[alive[by[1:][same]], d + s] = True
            found[alive[by[:-1][same]], d + s] = True
    return found


RECORDS = {"key": pa.int64(), "n": pa.int64(), "num": pa.int64(), "first": pa.int32(), "last": pa.int32(), "at": pa.int32(), "content": pa.binary()}


def records(held: DataFrame) -> DataFrame:
    """The records of held (num, text, places) with their content, from the first window's start to the last one's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 18):
            for i in range(batch.num_rows):
                raw, places = batch.column("text")[i].as_py().encode(), batch.column("places")[i].values
                if places is None or not len(places):
                    continue
                x = {c: places.field(c).to_numpy() for c in ("key", "n", "first", "last", "at")}
                for a in range(0, len(places), 1 << 14):
                    part = {c: y[a : a + (1 << 14)] for c, y in x.items()}
                    content = [raw[f : l + LEAST] for f, l in zip(part["first"].tolist(), part["last"].tolist(), strict=True)]
                    part |= {"num": np.full(len(content), batch.column("num")[i].as_py()), "content": content}
                    yield pa.RecordBatch.from_arrays([pa.array(part[c], k) for c, k in RECORDS.items()], list(RECORDS))

    return held.select("num", "text", "places").mapInArrow(run, "key long, n long, num long, first int, last int, at int, content binary")


def _laid_out(batch: pa.Table) -> tuple[np.ndarray, ...]:
    """Bucket, content matrix, least and greatest distance of the records."""
    x = {c: batch.column(c).to_numpy() for c in ("key", "first", "last", "at")}
    bucket = np.cumsum(np.append(0, x["key"][1:] != x["key"][:-1]))
    low, high = (x["at"] - x["last"]).astype(np.int64), (x["at"] - x["first"]).astype(np.int64)
    size = (x["last"] - x["first"]).astype(np.int64) + LEAST
    content = np.zeros((len(bucket), AHEAD + LEAST), np.uint8)
    flat = np.frombuffer(b"".join(batch.column("content").to_pylist()), np.uint8)
    begin = np.arange(len(bucket)) * (AHEAD + LEAST) + AHEAD - high
    content.ravel()[np.arange(len(flat)) + np.repeat(begin - (np.cumsum(size) - size), size)] = flat
    return bucket, content, low, high


def sorted_buckets(cold: DataFrame) -> DataFrame:
    """num, start, end of the spans that the sorted buckets of cold (records) show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def spans() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            found = np.zeros((rows.num_rows, AHEAD + 3), np.int8)
            found[:, 1:-1] = shared_suffixes(*_laid_out(rows))
            change = np.diff(found, axis=1)
            row, near = np.nonzero(change == 1)
            far = np.nonzero(change == -1)[1] - 1
            at = rows.column("at").to_numpy()[row].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(rows.column("num").to_numpy()[row]), pa.array(at - far), pa.array(at - near + LEAST)], ["num", "start", "end"])

        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
            sizes = pc.binary_length(batch.column("content")).to_numpy()
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if size >= BATCH and keys[a] != last:
                    yield spans()
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(sizes[a:b].sum())
                last = keys[a]
        if held:
            yield spans()

    return cold.repartition("key").sortWithinPartitions("key").select("key", "num", "first", "last", "at", "content").mapInArrow(run, "num long, start long, end long")


def narrowed(hot: DataFrame, step: int) -> DataFrame:
    """The records of hot, cut into those of ``step`` distances each. Windows of a range hold the bytes from its least distance before the gram to the
    end of its farthest window, so these, hashed with the key, are the new key: equal windows keep one key, and others part."""
    names = [c for c in RECORDS if c != "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "content"):
            out = []
            for key, num, first, last, at, content in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                low, high = at - last, at - first
                for a in range(low // step * step, high + 1, step):
                    b = a + step - 1
                    near, far = max(low, a), min(high, b)
                    core = hashlib.blake2b(struct.pack("<qi", key, a) + content[high - a : high - b + LEAST], digest_size=8).digest()
                    out.append((int.from_bytes(core, "little", signed=True), num, at - far, at - near, at, content[high - far : high - near + LEAST]))
            for i in range(0, len(out), 1 << 13):
                yield pa.RecordBatch.from_arrays([pa.array(c, RECORDS[k]) for c, k in zip(zip(*out[i : i + (1 << 13)], strict=True), names, strict=True)], names)

    return hot.select(names).mapInArrow(run, "key long, num long, first int, last int, at int, content binary")


def hot_spans(hot: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """num, start, end of the spans that the buckets of hot (records) show. Records of equal content are one class: if it has several, all their windows
    occur twice, and one record stands for them. What is left is cut to fewer distances, until each bucket can be sorted or holds one content."""
    spans = []
    for level, step in enumerate((*STEPS, 0)):
        if hot.isEmpty():
            break
        told = hot.select("*", (F.col("at") - F.col("first")).alias("high"), F.unhex(F.md5("content")).alias("same"))
        alike = ["key", "high", "same"]
        one = scratch.keep("one of hot", told.groupBy(*alike).agg(F.count("*").alias("times"), F.first(F.struct("num", "first", "last", "at", "content")).alias("x")))
        whole = told.select(*alike, "num", "first", "last").join(one.where("times > 1").select(*alike), alike)
        found = whole.select("num", F.col("first").cast("long").alias("start"), (F.col("last").cast("long") + LEAST).alias("end"))
        if step:
            parts = scratch.keep("parts", narrowed(one.select("key", "x.*"), step))
            parts = parts.join(parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
            parts = scratch.keep(f"parts {level}", parts)
            found = found.unionByName(sorted_buckets(parts.where(F.col("n") <= HOT)))
        spans.append(scratch.keep(f"spans {level}", found))
        if step:
            scratch.drop("one of hot", "parts", f"parts {level - 1}")
            hot = parts.where(F.col("n") > HOT)
    scratch.drop("one of hot", "parts", *(f"parts {k}" for k in range(len(STEPS))))
    return spans


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest of the text, row (a hash of the id, to tell copies apart) and text (null: empty)."""
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = F.coalesce(F.xxhash64("doc_id"), F.lit(0))
    return docs.select(F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"), row.alias("row"), plain.alias("text"))


def _spans_of(text: str, spans: list[tuple[int, int]]) -> tuple:
    return ([{"start": a, "end": b} for a, b in spans],)


#: What removals() tells of a text: names and types.
LISTED = {"spans": (pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), SPANS)}


def removals(docs: DataFrame, told: Callable[[str, list[tuple[int, int]]], tuple] = _spans_of, fields: dict[str, tuple[pa.DataType, str]] = LISTED) -> tuple[DataFrame, DataFrame]:
    """For the distinct texts of docs: digest, copies (how many rows have it); and, of those that lose something, digest and the fields, which ``told`` derives from
    the text and its spans (merged, in bytes) where they are merged, so that texts go to one worker only.
    Texts of LEAST bytes or more of which there are copies lose all; that isn't said again in the second table."""
    scratch = Scratch(docs.sparkSession)
    texts = with_digest(docs)
    marked = scratch.keep("marked", marks(texts))
    classes = scratch.keep("classes", marked.groupBy("digest").agg(F.count("*").alias("copies"), F.min("row").alias("row")))
    one = marked.join(classes.select("digest", "row"), ["digest", "row"]).dropDuplicates(["digest", "row"]).withColumn("num", F.monotonically_increasing_id())
    one = scratch.keep("one", one)
    scratch.drop("marked")
    places = one.select("num", F.explode(F.arrays_zip("key", "first", "last", "at")).alias("x")).select("num", "x.*")
    several = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = places.join(several, "key").groupBy("num").agg(F.collect_list(F.struct("key", "n", "first", "last", "at")).alias("places"))
    own = F.arrays_zip(F.col("own_start").cast("array<long>").alias("start"), F.col("own_end").cast("array<long>").alias("end")).cast(SPANS)
    need = one.select("num", "digest", "row", own.alias("own")).join(shared, "num", "left").where("places is not null or size(own) > 0")
    held = scratch.keep("held", texts.join(need, ["digest", "row"]).dropDuplicates(["digest", "row"]))
    scratch.drop("one")
    all_records = scratch.keep("records", records(held))
    found = sorted_buckets(all_records.where(F.col("n") <= HOT))
    for spans in hot_spans(all_records.where(F.col("n") > HOT), scratch):
        found = found.unionByName(spans)
    found = scratch.keep("found", found.groupBy("num").agg(F.collect_list(F.struct("start", "end")).alias("found")))
    scratch.drop("records", *(f"spans {k}" for k in range(len(STEPS) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = []
            for i in range(batch.num_rows):
                both = [batch.column(c)[i].values for c in ("own", "found")]
                start, end = (np.concatenate([np.zeros(0, np.int64), *(x.field(c).to_numpy() for x in both if x is not None)]) for c in ("start", "end"))
                start, end = merged(start, end)
                out.append(told(batch.column("text")[i].as_py(), list(zip(start.tolist(), end.tolist(), strict=True))))
            columns = [pa.array(c, k) for c, (k, _) in zip(zip(*out, strict=True), fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *columns], ["digest", *fields])

    spans = held.select("num", "digest", "text", "own").join(found, "num", "left").where("found is not null or size(own) > 0")
    schema = ", ".join(("digest binary", *(f"{c} {k}" for c, (_, k) in fields.items())))
    return classes.select("digest", "copies"), spans.select("digest", "text", "own", "found").mapInArrow(run, schema)


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(end for _, end in spans)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(start for start, _ in spans), len(raw)], strict=True))


def _joined(rows: DataFrame, classes: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (digest) with all (the text goes whole: there is a copy) and the columns of spans; one join, whose hot digests Spark can split."""
    known = classes.where("copies > 1").select("digest", F.lit(True).alias("all")).join(spans, "digest", "full")
    return rows.join(known, "digest", "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with removed (spans in bytes, by start) and kept (the other bytes of the text, as binary)."""
    classes, spans = removals(docs)
    key, whole = unused("digest", docs.columns), unused("all", docs.columns)
    base = docs.drop("removed", "kept").withColumn(key, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)))
    told = classes.where("copies > 1").select("digest", F.lit(True).alias(whole)).join(spans.select("digest", F.col("spans").alias("removed")), "digest", "full")
    joined = base.join(told.withColumnRenamed("digest", key), key, "left")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"))).cast(SPANS)
    removed = F.when(F.col(whole) & (size >= LEAST), everything).otherwise(F.coalesce("removed", F.array().cast(SPANS)))
    joined = joined.withColumn("removed", removed).drop(key, whole)
    schema = joined.withColumn("kept", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            spans = [[(s["start"], s["end"]) for s in x] for x in batch.column("removed").to_pylist()]
            kept = [kept_bytes((t or "").encode(), s) for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], schema.names)

    return joined.mapInArrow(run, schema)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def facts(text: str, spans: list[tuple[int, int]]) -> tuple:
        return sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(text.encode(), spans)).hexdigest()

    # Texts that lose nothing aren't moved: their digest is known.
    classes, told = removals(docs, facts, {"n_removed": (pa.int64(), "long"), "n_spans": (pa.int64(), "long"), "kept": (pa.string(), "string")})
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", n_bytes.alias("n_bytes"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
    whole = F.col("all") & (F.col("n_bytes") >= LEAST)
    return _joined(rows, classes, told).select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"))


#: All windows of all texts, as hexadecimal digits.
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS num, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
c AS (SELECT num, b, substr(x, 2048 * b + 1, {2048 + 2 * LEAST - 2}) AS y FROM (SELECT num, x, unnest(range(length(x) // 2048 + 1)) AS b FROM d)),
w AS (SELECT num, 1024 * b + i AS i, md5(substr(y, 2 * i + 1, {2 * LEAST})) AS h FROM (SELECT num, b, y, unnest(range(length(y) // 2 - {LEAST - 1})) AS i FROM c)),
r AS (SELECT num, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
k AS (
  SELECT num, i, sum(new) OVER (PARTITION BY num ORDER BY i) AS island
  FROM (SELECT num, i, CASE WHEN i - lag(i) OVER (PARTITION BY num ORDER BY i) <= {LEAST} THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT num, min(i) AS low, max(i) + {LEAST} AS high FROM k GROUP BY num, island),
p AS (SELECT s.*, coalesce(lag(high) OVER (PARTITION BY num ORDER BY low), 0) AS before FROM s),
o AS (
  SELECT p.num, count(*) AS n, sum(high - low) AS size, max(high) AS upto, string_agg(substr(x, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS head
  FROM p JOIN d ON p.num = d.num GROUP BY p.num)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(size, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN o ON d.num = o.num
"""
