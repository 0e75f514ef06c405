"""Substring dedup by hashing lines and runs of words: the earliest occurrence stays, all others go, and original offsets are retained.

Removed are all passages of ``RUN`` words or more that occurred before: in a document of smaller id, or in the same document if they begin
behind the end of the first. Words are lower case and parted by any white space, so it doesn't matter how a passage is wrapped and what stands
around it; shorter lines that repeat stay. Two steps find them.

Lines: a unit is a line with words, its digest that of the words with one blank between them. Digests are grouped with partial
sums, so a line that all documents share is a row a task, and the earliest occurrence (by doc_id, then place) is joined to the others. Lines in a
row whose earliest occurrences stand in a row too make a block; blocks of ``least`` words or more go. That takes most copies.

Runs: each run of ``RUN`` words holds the least hash of its grams of ``GRAM`` words, so two equal runs share a
chosen gram (winnowing): grams that are chosen twice are found first, and only the runs around those are hashed (128 bits) and grouped.
Grams and runs whose surroundings lie in a block count with the earliest occurrence only.

Null text counts as empty: no units, nothing removed. Rows with a null id are passed through with nothing removed. Repeated rows with one id
are one document: all lose what the id loses. Texts of any length are handled whole; an empty table gives an empty result; columns that
clash with results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.llm.common import chunks, table, texts_of, unused, written
from brasswell.llm.wordhash import mix, words_of

RUN, GRAM = 50, 24
LEAST = RUN
#: Odd factors of the two rolling hashes.
FACTORS = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95)
SPANS = "array<struct<start: long, end: long>>"


def lowered(text: str) -> str:
    """The text in lower case, as long as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def units_of(text: str) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Index of the first word, words, start and end (characters, exclusive) and digest of each line that has words."""
    start = word = 0
    for line in lowered(text).split("\n"):
        words = line.split()
        if words:
            first = start + len(line) - len(line.lstrip())
            yield word, len(words), first, first + len(line.strip()), hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
            word += len(words)
        start += len(line) + 1


def units(docs: DataFrame) -> DataFrame:
    """A row for each line with words: doc_id, line (its number among those), word, words, start, end, digest."""
    kinds = {"doc_id": pa.int64(), "line": pa.int64(), "word": pa.int64(), "words": pa.int64(), "start": pa.int64(), "end": pa.int64(), "digest": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [(d, k, *u) for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True) if d is not None for k, u in enumerate(units_of(t))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, line long, word long, words long, start long, end long, digest binary")


def line_blocks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and blocks (start, end, word, stop), by start: lines in a row, ``least`` words or more, that occurred in a row before."""
    all_units = units(docs)
    place = F.struct("doc_id", "line")
    first = all_units.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    again = all_units.join(first.select("digest", "first"), "digest").where("struct(doc_id, line) <> first").drop("digest").distinct()
    lines = again.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "word", "words", "start", "end", "first"))).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "word", "stop")]))
        for batch in batches:
            found = [blocks_of(x, least) for x in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "blocks"])

    return lines.mapInArrow(run, "doc_id long, blocks array<struct<start: long, end: long, word: long, stop: long>>").where("size(blocks) > 0")


class Running:
    """Words of texts, lower case and parted by any white space: hashes, first and last character (exclusive) and the bounds of each text."""

    def __init__(self, texts: list[str]) -> None:
        w = words_of([re.sub(r"[^\S ]", " ", lowered(t)) for t in texts])
        chars = np.cumsum(np.append(0, (np.frombuffer(w.data, np.uint8) & 0xC0) != 0x80))
        zero = chars[np.repeat(w.offsets[:-1], np.diff(w.bounds))]
        self.hashes, self.bounds, self.starts, self.ends = w.hashes, w.bounds, chars[w.starts] - zero, chars[w.ends] - zero

    def rolled(self, width: int, factor: int) -> np.ndarray:
        """The hash of the ``width`` words from each word on (all texts in a row)."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, np.uint64)
        powers = np.cumprod(np.append(np.uint64(1), np.full(n - 1, factor, np.uint64)))
        back = np.cumprod(np.append(np.uint64(1), np.full(n - width, pow(factor, -1, 1 << 64), np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(mix(self.hashes ^ np.uint64(factor)) * powers))
        return mix((sums[width:] - sums[:-width]) * back)


def chosen(grams: np.ndarray, run: int = RUN, gram: int = GRAM) -> np.ndarray:
    """Places of the grams of one text that are the least of some run's."""
    around = run - gram + 1
    if len(grams) < around:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, around)
    least, pick = views.min(axis=1), np.zeros(len(grams), bool)
    # A gram is chosen where it equals the least of any run that holds it.
    changes = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    for a, b in zip(changes.tolist(), [*changes[1:].tolist(), len(least)], strict=True):
        held = grams[a : b + around - 1]
        pick[a : b + around - 1] |= held == least[a]
    return np.flatnonzero(pick)


def blocks_of(lines: list[dict], least: int = LEAST) -> list[dict]:
    """Lines in a row whose earliest occurrences are in a row too, of ``least`` words or more: start, end, word (the first's index) and stop."""
    out, last = [], None
    for x in lines:
        f = x["first"]
        if last and last["line"] + 1 == x["line"] and (last["first"]["doc_id"], last["first"]["line"] + 1) == (f["doc_id"], f["line"]):
            out[-1] |= {"end": x["end"], "stop": x["word"] + x["words"]}
        else:
            out.append({"start": x["start"], "end": x["end"], "word": x["word"], "stop": x["word"] + x["words"]})
        last = x
    return [b for b in out if b["stop"] - b["word"] >= least]


def inside(low: np.ndarray, high: np.ndarray, blocks: list[dict] | None) -> np.ndarray:
    """Which spans of words, from low to before high, lie in a block."""
    if not blocks:
        return np.zeros(len(low), bool)
    word, stop = np.array([(b["word"], b["stop"]) for b in blocks]).T
    k = np.searchsorted(word, low, side="right") - 1
    return (k >= 0) & (high <= stop[np.maximum(k, 0)])


def grams(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, h, place (word) of the chosen grams, and inside: all runs around it lie in a block."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w, rows = Running(texts_of(batch)), []
            h = w.rolled(GRAM, FACTORS[0])
            for d, a, b in zip(batch.column("doc_id").to_pylist(), w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
                if d is not None and b - a >= RUN:
                    at = chosen(h[a : b - GRAM + 1])
                    rows.append((d, b - a, h[a + at].view(np.int64), at.astype(np.int32)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "h", "place"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]]
            for d, n, h, place, blocks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "h", "place", "blocks")), strict=True):
                at = np.array(place, np.int64)
                held = inside(np.maximum(at - (RUN - GRAM), 0), np.minimum(at + RUN, n), blocks)
                for c, v in zip(out, (np.full(len(h), d, np.int64), np.array(h, np.int64), at, held), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["doc_id", "h", "place", "inside"])

    found = docs.select("doc_id", "text").mapInArrow(pick, "doc_id long, n long, h array<long>, place array<int>")
    return found.join(blocks, "doc_id", "left").select("doc_id", "n", "h", "place", "blocks").mapInArrow(part, "doc_id long, h long, place long, inside boolean")


def run_repeats(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id and runs, the spans (start, end), by start, of the runs of words outside the blocks that occurred before."""
    found = written(grams(docs, blocks))
    several = found.where("not inside").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    near = found.join(several, "h").groupBy("doc_id").agg(F.collect_set("place").alias("near")).join(blocks, "doc_id", "left")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w, rows = Running(texts_of(batch)), []
            a64, b64 = (w.rolled(RUN, f).view(np.int64) for f in FACTORS)
            for d, near, blocks, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "near", "blocks")), w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
                wanted = np.unique((np.array(near)[:, None] - np.arange(RUN - GRAM + 1)).ravel())
                wanted = wanted[(wanted >= 0) & (wanted <= b - a - RUN)]
                wanted = wanted[~inside(wanted, wanted + RUN, blocks)]
                at = a + wanted
                # The first of equal runs in this document, for those that begin behind its end.
                _, first, which = np.unique(a64[at], return_index=True, return_inverse=True)
                first = first[which]
                own = (wanted >= wanted[first] + RUN) & (b64[at] == b64[at[first]])
                rows.append((np.full(len(at), d, np.int64), w.starts[at], w.ends[at + RUN - 1], own, a64[at], b64[at]))
            kinds = (np.int64, np.int32, np.int32, bool, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "end", "own", "a", "b"])

    runs = docs.select("doc_id", "text").join(near, "doc_id").select("doc_id", "text", "near", "blocks").mapInArrow(hashed, "doc_id long, start int, end int, own boolean, a long, b long")
    runs = written(runs)
    first = runs.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("a", "b", "first")
    again = runs.join(first, ["a", "b"]).where("doc_id > first").select("doc_id", "start", "end").union(runs.where("own").select("doc_id", "start", "end"))
    return again.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))


def merged(spans: list[dict]) -> list[dict]:
    """The spans by start, those that overlap as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] < out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append({"start": s["start"], "end": s["end"]})
    return out


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and removed (start, end), by start, the passages that occurred before."""
    docs = docs.where("doc_id is not null")
    blocks = written(line_blocks(docs, least))
    both = blocks.join(run_repeats(docs, blocks), "doc_id", "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [merged([*(x or []), *(y or [])]) for x, y in zip(batch.column("blocks").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "removed"])

    return both.select("doc_id", "blocks", "runs").mapInArrow(run, f"doc_id long, removed {SPANS}")


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with kept_text, the text without what occurred before (a passage goes with the character behind it), and removed, its spans in the text."""
    base = docs.select(*[c for c in docs.columns if c not in ("removed", "kept_text")])
    key = unused("doc", base.columns)
    joined = base.join(repeats(docs, least).withColumnRenamed("doc_id", key), F.col("doc_id") == F.col(key), "left").drop(key)
    schema = joined.withColumn("kept_text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(texts_of(batch), batch.column("removed").to_pylist(), strict=True):
                at, parts = 0, []
                for s in spans or []:
                    parts.append(t[at : s["start"]])
                    at = min(s["end"] + 1, len(t))
                out.append("".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [f.name for f in schema])

    return joined.mapInArrow(run, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", F.greatest(F.size(F.coalesce("removed", F.expr("array()"))), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(told, F.lit("")).alias("removed"),
        F.length("kept_text").cast("long").alias("kept_chars"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The same from all runs of words as they are.
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[^{_SPACE}]+') AS ws, regexp_split_to_array(t, '[^{_SPACE}]+') AS gaps FROM d),
w AS (
  SELECT doc_id, i, start, start + size AS stop FROM (
    SELECT doc_id, i, length(ws[i]) AS size,
      CAST(sum(length(gaps[i]) + length(ws[i])) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(ws[i]) AS start
    FROM (SELECT doc_id, ws, gaps, unnest(range(1, len(ws) + 1)) AS i FROM s))),
r AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {RUN - 1}], ' ')) AS run
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {RUN - 2})) AS i FROM s WHERE len(ws) >= {RUN})),
a AS (SELECT run, doc_id, min(i) AS i FROM r GROUP BY run, doc_id),
f AS (SELECT run, min(doc_id) AS doc_id FROM a GROUP BY run),
g AS (
  SELECT DISTINCT r.doc_id, r.i FROM r JOIN f ON r.run = f.run JOIN a ON r.run = a.run AND r.doc_id = a.doc_id
  WHERE r.doc_id > f.doc_id OR r.i >= a.i + {RUN}),
k AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {RUN - 1} THEN 0 ELSE 1 END AS new FROM g)),
p AS (
  SELECT x.doc_id, x.island, b.start, e.stop FROM (SELECT doc_id, island, min(i) AS low, max(i) + {RUN - 1} AS high FROM k GROUP BY doc_id, island) x
  JOIN w b ON b.doc_id = x.doc_id AND b.i = x.low JOIN w e ON e.doc_id = x.doc_id AND e.i = x.high),
q AS (
  SELECT p.doc_id, p.start, p.stop, least(p.stop + 1, length(t)) AS upto, substr(t, from_ + 1, p.start - from_) AS piece FROM (
    SELECT doc_id, start, stop, coalesce(lag(stop + 1) OVER (PARTITION BY doc_id ORDER BY start), 0) AS from_ FROM p) p JOIN d ON d.doc_id = p.doc_id),
o AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start) AS removed,
    string_agg(piece, '' ORDER BY start) AS pieces, max(upto) AS upto FROM q GROUP BY doc_id),
z AS (
  SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(removed, '') AS removed, coalesce(pieces, '') || substr(t, coalesce(upto, 0) + 1) AS kept
  FROM d LEFT JOIN o ON d.doc_id = o.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_removed, removed, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM z
"""
