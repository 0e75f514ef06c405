"""Search in a Hamming radius by multi-index hashing: hashes are cut into pieces, and two hashes within the radius have a piece that differs in few bits.

With m pieces, one of them differs in at most radius // m bits, so each asked hash looks for its pieces and for those that differ by up to that many bits,
in an equal-key join by piece; the exact distance verifies, and a pair that meets in several pieces counts once. More pieces mean fewer variants to ask for and shorter,
less telling pieces. Pieces that many stored hashes share are hot keys: their rows are dealt over parts, and an asked piece goes to each part of its own key only."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasswell.functions.hashes import hamming

#: Stored rows of a piece in a part, by expectation.
PART = 4096


def bounds_of(bits: int, pieces: int) -> list[tuple[int, int]]:
    """First bit and width of pieces of about equal width, none over 62 bits."""
    return [(bits * k // pieces, bits * (k + 1) // pieces - bits * k // pieces) for k in range(pieces)]


def piece(hashed: Column, start: int, width: int) -> Column:
    """The bits of an array of longs from one on, as a number."""
    word, shift = start // 64, start % 64
    low = F.shiftrightunsigned(F.element_at(hashed, word + 1), shift)
    if shift + width > 64:
        low = low.bitwiseOR(F.shiftleft(F.element_at(hashed, word + 2), 64 - shift))
    return low.bitwiseAND(F.lit((1 << width) - 1))


def variants(value: Column, width: int, most: int) -> Column:
    """The numbers that differ from value in up to ``most`` bits."""
    flips = [sum(1 << b for b in some) for n in range(most + 1) for some in combinations(range(width), n)]
    return F.transform(F.array(*(F.lit(f).cast("long") for f in flips)), lambda f: value.bitwiseXOR(f))


def pieces_for(bits: int, radius: int) -> int:
    """As many as let one bit differ in a piece; more where pieces would be wider than 62 bits."""
    return max(1, -(-bits // 62), min(bits, (radius + 2) // 2))


def candidates(stored: DataFrame, asked: DataFrame, bits: int, radius: int, pieces: int | None = None) -> DataFrame:
    """Pairs (all columns of both), once each, that share a piece up to the bits that may differ. stored: id, hash; asked: query, asked (arrays of longs)."""
    m = pieces or pieces_for(bits, radius)
    bounds = bounds_of(bits, m)

    def keyed(rows: DataFrame, column: str, variants_of: Callable[[Column, int], Column]) -> DataFrame:
        named = lambda k, s, w: F.transform(variants_of(piece(F.col(column), s, w), w), lambda v: F.struct(F.lit(k).alias("_k"), v.alias("_v")))
        return rows.withColumn("_x", F.explode(F.concat(*(named(k, *b) for k, b in enumerate(bounds))))).select(*rows.columns, "_x._k", "_x._v")

    right = keyed(asked, "asked", lambda p, w: variants(p, w, radius // m))
    left = keyed(stored, "hash", lambda p, w: F.array(p))
    parts = left.groupBy("_k", "_v").agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts")).where("_parts > 1")
    left = left.join(parts, ["_k", "_v"], "left").withColumn("_part", F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1))).cast("int"))
    right = right.join(parts, ["_k", "_v"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    met = left.drop("_parts").join(right.drop("_parts"), ["_k", "_v", "_part"])
    return met.groupBy("id", "query").agg(F.first("hash").alias("hash"), F.first("asked").alias("asked"))


def within(stored: DataFrame, asked: DataFrame, bits: int, radius: int, pieces: int | None = None) -> DataFrame:
    """id, query and distance of all pairs whose hashes differ in at most ``radius`` bits. Rows without a hash or an id match nothing; ids name rows."""
    usable = lambda df, i, h: df.where(F.col(i).isNotNull() & F.col(h).isNotNull() & (F.size(h) * 64 >= bits))
    met = candidates(usable(stored.select("id", "hash"), "id", "hash"), usable(asked.select("query", "asked"), "query", "asked"), bits, radius, pieces)
    return met.select("id", "query", hamming(F.col("hash"), F.col("asked")).cast("long").alias("distance")).where(F.col("distance") <= radius)
