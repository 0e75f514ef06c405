"""Perceptual hashes as bit arrays, longs and hex text, and their distances; everything is a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The distance of hashes of unequal length.
FAR = 2147483647


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def bits_hex(bits: Column) -> Column:
    """An array of 0 and 1 as hex text, four bits a digit."""

    def told(b: Column) -> Column:
        one = lambda k, i, w: F.element_at(b, (4 * k + i).cast("int")) * w
        digit = lambda k: F.lower(F.hex((one(k, 1, 8) + one(k, 2, 4) + one(k, 3, 2) + one(k, 4, 1)).cast("long")))
        return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(b) / 4 - 1).cast("int")), digit), "")

    return once(bits, told)


def bits_longs(bits: Column) -> Column:
    """An array of 0 and 1 as longs, 64 bits each."""

    def told(b: Column) -> Column:
        shifted = lambda s, x: F.shiftleft(s, 1).bitwiseOR(x.cast("long"))
        packed = lambda k: F.aggregate(F.slice(b, (64 * k + 1).cast("int"), F.lit(64)), F.lit(0).cast("long"), shifted)
        return F.transform(F.sequence(F.lit(0), (F.size(b) / 64 - 1).cast("int")), packed)

    return once(bits, told)


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two arrays of longs; FAR where their lengths differ."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), both).otherwise(F.lit(FAR))


def hamming_hex(a: Column, b: Column) -> Column:
    """Different bits of two hex texts, eight digits at a time; FAR where their lengths differ."""
    part = lambda h, k: F.conv(F.substr(h, (8 * k + 1).cast("int"), F.lit(8)), 16, 10).cast("long")
    steps = F.sequence(F.lit(0), F.ceil(F.length(a) / 8).cast("int") - 1)
    both = F.aggregate(steps, F.lit(0), lambda s, k: s + F.bit_count(part(a, k).bitwiseXOR(part(b, k))))
    return F.when(F.length(a) != F.length(b), F.lit(FAR)).when(F.length(a) == 0, F.lit(0)).otherwise(both)
