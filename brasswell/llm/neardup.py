"""MinHash near-dedup with SuperMinHash signatures, banding, verification on full sets and union-find grouping.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one class before anything else, so copies
never meet each other. Each class gets a SuperMinHash signature: every element walks a random permutation of the slots, its step number
is part of its rank, and walking stops when no slot can get lower (all elements of a chunk walk together). Bands of the signature
are buckets.

Candidates never are all pairs of a bucket. First the sets of a bucket meet its lead only, the one that shares most buckets
with others, which stands in the middle of its near copies. Sets whose buckets still hold several groups then meet by their rarest
elements (``prefixes``), which loses no link between groups: with the lead of each such element first, and those of different groups that
sizes and places leave possible at last. Every link is verified on full sets. Groups come from repeated smallest-neighbour steps over
written tables, never on the driver.

With BANDS bands of ROWS slots, two sets at the limit of 0.85 share no bucket with probability under 1e-6; a lower limit takes more bands
(``bands_for``). Ids are whole numbers. Null or empty texts have no set and link with nothing; rows with a null id stay and are in no group
(null component and kept). Repeated rows with one id are one document in the links and one row each in the result. Ties go to the
smallest id. Very long texts are handled whole, one at a time. Columns beside id and text aren't used. An empty table gives an empty result.
Tables that nothing reads any more are deleted; those that the result reads stay in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brasswell.llm.common import Scratch, chunks, table, texts_of
from brasswell.llm.wordhash import mix, shingled, words_of

SLOTS, ROWS = 80, 4
BANDS = SLOTS // ROWS
WIDTH, PERCENT = 3, 85
#: Bits of the filter by which documents are told that surely share no bucket; it is sent to all tasks in words, 2**20 rows at most.
FILTER = 1 << 26


def _times_gold(n: int) -> np.uint64:
    return np.uint64(0x9E3779B97F4A7C15 * n % (1 << 64))


def bands_for(percent: int) -> int:
    """The fewest bands, BANDS at least, with which two sets at the limit share no bucket with probability under 1e-6."""
    return max(BANDS, math.ceil(math.log(1e-6) / math.log(1 - (percent / 100) ** ROWS)))


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n, slots) of n sets given as elements and the set each belongs to. Step j gives the slot that the
    element's permutation has there the rank j + r, r in [0, 1); a set is done when all its slots have ranks below the next step."""
    ranks = np.full(n * slots, np.inf)
    alive, places = np.arange(len(elements)), None
    for j in range(slots):
        x = elements[alive]
        r = (mix(x + _times_gold(2 * j + 1)) >> np.uint64(11)).astype(float) * 2.0**-53
        k = j + ((mix(x + _times_gold(2 * j + 2)) >> np.uint64(11)).astype(float) * 2.0**-53 * (slots - j)).astype(np.int64)
        if j == 0:
            slot = first = k
        else:
            if places is None:  # most sets are done by now
                places = np.tile(np.arange(slots, dtype=np.uint8), (len(alive), 1))
                rows = np.arange(len(alive))
                places[rows, first[alive]] = 0
                places[:, 0] = first[alive]
            rows = np.arange(len(alive))
            slot = places[rows, k].astype(np.int64)
            places[rows, k] = places[:, j]
            places[:, j] = slot
        np.minimum.at(ranks, owner[alive] * slots + slot, j + r)
        more = ranks.reshape(n, slots).max(axis=1) > j + 1
        keep = more[owner[alive]]
        if not keep.any():
            break
        alive = alive[keep]
        places = places[keep] if places is not None else None
    return ranks.reshape(n, slots)


def shingle_sets(docs: DataFrame, full: bool, width: int = WIDTH, n_bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles and digest of the set; with the bands' hashes or, if full, the sorted set as little-endian bytes."""
    schema = "doc_id long, n_shingles long, digest binary, " + ("shingles binary" if full else "bands array<long>")
    names = ["doc_id", "n_shingles", "digest", "shingles" if full else "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in chunks(batches):
            w = words_of(texts_of(batch))
            sets = [np.unique(shingled(w.hashes[a:b], width)) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
            sizes = np.array([len(s) for s in sets])
            raw = [s.astype("<u8").tobytes() for s in sets]
            if full:
                last = pa.array(raw, pa.binary())
            else:
                ranks = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), n_bands * ROWS)
                bits = ranks.view(np.uint64).reshape(len(sets), n_bands, ROWS)
                band = np.zeros((len(sets), n_bands), np.uint64)
                for i in range(ROWS):
                    band = mix(band * np.uint64(3) + bits[:, :, i] + np.arange(1, n_bands + 1, dtype=np.uint64))
                last = pa.array(list(band.view(np.int64)), pa.list_(pa.int64()))
            digests = pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), digests, last], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The distinct pairs (a, b) whose sets are alike: 100 * intersection >= percent * union. sets: doc_id, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.distinct().join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node that is reachable): alternating large-star and small-star steps until nothing changes."""
    edges = scratch.keep("edges", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    said = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep("stars", large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = scratch.keep("edges", large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == said:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        said = now


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (doc_id, text) whose id is among ids. A filter of a bit for each id's hash goes before the join, so that few texts of others are shuffled;
    the more ids there are, the more of those pass it, at last all."""
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("mask"))
    marked = docs.withColumns({"word": F.shiftright(bit, 6), "own": F.expr(f"shiftleft(1L, int(pmod(xxhash64(cast(doc_id AS bigint)), {FILTER}L) & 63))")})
    passed = marked.join(F.broadcast(words), "word").where(F.col("mask").bitwiseAND(F.col("own")) != 0)
    # No semi-join: Spark would push it below the filter, so that all texts are shuffled.
    return passed.select("doc_id", "text").join(ids.distinct(), "doc_id")


def grouped(rows: DataFrame, group: DataFrame) -> DataFrame:
    """rows (doc_id) with g, the document's group so far."""
    return rows.join(group, rows.doc_id == group.node, "left").withColumn("g", F.coalesce("component", "doc_id")).drop("node", "component")


def meeting(rows: DataFrame) -> DataFrame:
    """The rows (key, doc_id, g, size, cap) whose key holds a row of another group that is no larger than their cap and whose own cap
    they don't exceed. Sums over a key's groups; the other groups' best is the best one, or the second where the best is one's own."""
    per = rows.groupBy("key", "g").agg(F.min("size").alias("low"), F.max("cap").alias("top"))
    first = per.groupBy("key").agg(F.min(F.struct("low", "g")).alias("low1"), F.max(F.struct("top", "g")).alias("top1"), F.count("*").alias("groups")).where("groups > 1")
    second = per.join(first, "key").groupBy("key").agg(F.first("low1").alias("low1"), F.first("top1").alias("top1"), F.min(F.when(F.col("g") != F.col("low1.g"), F.col("low"))).alias("low2"), F.max(F.when(F.col("g") != F.col("top1.g"), F.col("top"))).alias("top2"))
    low = F.when(F.col("low1.g") != F.col("g"), F.col("low1.low")).otherwise(F.col("low2"))
    top = F.when(F.col("top1.g") != F.col("g"), F.col("top1.top")).otherwise(F.col("top2"))
    return rows.join(second, "key").where((low <= F.col("cap")) & (top >= F.col("size"))).select(*rows.columns)


def lead_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of each row (key, doc_id, g, size, cap, rank) with its key's lead, the row of highest rank, if the lead is of another group."""
    lead = rows.groupBy("key").agg(F.max(F.struct("rank", F.negate("doc_id").alias("minus"), "g", "size", "cap")).alias("lead"))
    fits = (F.col("g") != F.col("lead.g")) & (F.col("size") <= F.col("lead.cap")) & (F.col("lead.size") <= F.col("cap"))
    return rows.join(lead, "key").where(fits).select(F.least("doc_id", F.negate("lead.minus")).alias("a"), F.greatest("doc_id", F.negate("lead.minus")).alias("b"))


def cross_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of the rows (key, doc_id, g, size, cap) that are of different groups and within each other's cap."""
    other = rows.select("key", F.col("doc_id").alias("b"), F.col("g").alias("g2"), F.col("size").alias("size2"), F.col("cap").alias("cap2"))
    return rows.join(other, "key").where("g < g2 and size <= cap2 and size2 <= cap").select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """key, doc_id, size, cap, rank of the rarest elements of the sets (num, doc_id, shingles), by which alike sets must meet.

    Elements are ordered by the number of these sets that hold them. If the first common element of two sets stands behind i others
    in one of size s, at most s - i are common, so the other's size can't exceed the cap (s - i) * (100 + percent) / percent - s. That cap is
    no less than percent of s for the first elements only: these are the keys. Elements that one set alone holds are no keys."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "shingles"):
            raw = [np.frombuffer(x.as_buffer(), "<u8").view(np.int64) for x in batch.column("shingles")]
            times = np.array([len(r) for r in raw])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("num").to_numpy(), times)), pa.array(np.repeat(times, times)), pa.array(np.concatenate(raw))], ["num", "size", "key"])

    held = sets.select("num", "shingles").mapInArrow(spread, "num long, size long, key long")
    shared = held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mine = Window.partitionBy("num")
    placed = held.join(shared, "key").withColumns({"k": F.row_number().over(mine.orderBy("n", "key")), "common": F.count("*").over(mine)})
    before = F.col("size") - F.col("common") + F.col("k") - 1
    cap = F.floor((F.col("size") - before) * (100 + percent) / percent - F.col("size") + 1e-6).cast("long")
    placed = placed.select("key", "num", "size", cap.alias("cap"), F.negate(before).alias("rank")).where(F.col("cap") * 100 >= F.col("size") * percent)
    return placed.join(sets.select("num", "doc_id"), "num").select("key", "doc_id", "size", "cap", "rank")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs: linked where the sets of ``width`` words are alike to ``percent``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    all_sets = scratch.keep("all", shingle_sets(docs, full=False, width=width, n_bands=bands_for(percent)))
    classes = scratch.keep("classes", all_sets.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    sets = all_sets.join(classes, [all_sets.digest == classes.digest, all_sets.doc_id == classes.rep], "left_semi").dropDuplicates(["doc_id", "digest"])
    buckets = sets.select("doc_id", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "h")).select("doc_id", "size", F.xxhash64("band", "h").alias("key"))
    several = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = scratch.keep("buckets", buckets.join(several, "key"))
    # The more sets a set meets in all its buckets, the nearer it is to the middle of its copies.
    rank = buckets.groupBy("doc_id").agg(F.sum("n").alias("rank"))
    buckets = buckets.join(rank, "doc_id").select("key", "doc_id", "size", F.floor(F.col("size") * 100 / percent + 1e-6).cast("long").alias("cap"), "rank")
    buckets = scratch.keep("ranked", buckets)
    scratch.drop("buckets")
    met = of_ids(docs.select("doc_id", "text"), buckets.select("doc_id").distinct())
    sets = scratch.keep("sets", shingle_sets(met, full=True, width=width).dropDuplicates(["doc_id", "digest"]).select("doc_id", "shingles", F.monotonically_increasing_id().alias("num")))
    links = spark.createDataFrame([], "a long, b long")
    group = spark.createDataFrame([], "node long, component long")

    def join_up(pairs: DataFrame) -> None:
        nonlocal links, group
        found = scratch.keep("found", verified(pairs, sets, percent))
        if not found.isEmpty():
            links = scratch.keep("links", links.union(found))
            group = scratch.keep("group", components(links, scratch))

    join_up(lead_pairs(buckets.withColumn("g", F.col("doc_id"))))
    rest = sets.join(meeting(grouped(buckets, group)).select("doc_id").distinct(), "doc_id", "left_semi")
    keys = scratch.keep("keys", prefixes(rest, percent))
    scratch.drop("ranked")
    join_up(lead_pairs(grouped(keys, group)))
    join_up(cross_pairs(meeting(grouped(keys, group))))
    scratch.drop("keys", "sets", "found", "edges", "stars")
    member = all_sets.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    out = member.join(group, F.when(F.col("n_shingles") > 0, F.col("rep")) == group.node, "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
