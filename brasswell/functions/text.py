"""Text, code and number rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERSIAN = "۰۱۲۳۴۵۶۷۸۹"
ASK = "ask for the price"


def digits(value: Column) -> Column:
    """All digits of a text as one number, without sign and point; 0 where there are none."""
    return F.coalesce(F.regexp_replace(value, "[^0-9]", "").try_cast("long"), F.lit(0).cast("long"))


def padded_names(name: Column) -> Column:
    """A file name with its bracketed number as it is and padded to two and three digits: e(7), e(07), e(007)."""
    number, head, tail = F.regexp_extract(name, r"\((\d+)\)", 1), F.regexp_extract(name, r"^([^(]*)\(", 1), F.regexp_extract(name, r"\)(.*)$", 1)
    short = F.regexp_replace(number, r"^0+(?=\d)", "")
    told = [F.concat(head, F.lit("("), n, F.lit(")"), tail) for n in (short, F.lpad(short, F.greatest(F.length(short), F.lit(2)), F.lit("0")), F.lpad(short, F.greatest(F.length(short), F.lit(3)), F.lit("0")))]
    return F.when(number != "", F.array_distinct(F.array(name, *told))).otherwise(F.array(name))


def price_text(amount: Column) -> Column:
    """A price in Persian digits with thousands marks; a request to ask where there is none."""
    return F.when(amount > 0, F.translate(F.format_number(amount, 0), "0123456789", PERSIAN)).otherwise(F.lit(ASK))


def first_object(text: Column) -> Column:
    """The first to the last brace of a reply, code fences gone; empty where there is none."""
    return F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)


def string_hash(text: Column) -> Column:
    """The 32-bit hash that takes 31 times itself plus the next character's code."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    wrapped = lambda s, c: (s * 31 + c) % 4294967296
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), wrapped)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sku(code: Column, mark: str = "AT-") -> Column:
    return F.when(F.startswith(code, F.lit(mark)), code).otherwise(F.concat(F.lit(mark), code))


def natural(text: Column) -> Column:
    """A sort key in which runs of digits count as numbers of up to 18 digits."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 18, "0")).otherwise(p)), "")


def falsy(value: Column, other: Column) -> Column:
    """The value unless it is null or 0."""
    return F.coalesce(F.nullif(value, F.lit(0)), other)


#: Fixed value: mixed into the second half of a point's id.
POINT_MIX = 0x9E3779B9


def signed_hash(text: Column) -> Column:
    """The signed 32-bit hash that takes 31 times itself plus the next UTF-16 unit."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))
    unsigned = F.aggregate(units, F.lit(0).cast("long"), lambda s, u: (s * 31 + F.conv(u, 16, 10).cast("long")) % 4294967296)
    return _signed(unsigned)


def _signed(value: Column) -> Column:
    return F.pmod(value + 2147483648, F.lit(4294967296)) - 2147483648


def point_id(text: Column) -> Column:
    """The stable id, in the form of a UUID, under which a vector database keeps a text's point."""
    h = signed_hash(text)
    hex_of = lambda v, n: F.lpad(F.lower(F.hex(F.abs(v))), n, "0")
    return F.concat(hex_of(h, 8), F.lit("-0000-4000-8000-"), hex_of(_signed(h.bitwiseXOR(F.lit(POINT_MIX))), 12))


def collated(text: Column, locale: str = "fa") -> Column:
    """A sort key in a language's own order of letters, with runs of digits as numbers."""
    return F.collate(natural(text), locale)
