"""Temporal list join: dated entries of a URL list become validity intervals, and each capture meets the entry in force when it was fetched.

All DataFrame operations. An entry names a domain, which holds for all hosts under it, and may name a path (column ``path``), which holds for that
path and all below it. Entries of one name are ordered by time and then action; of several at one time only the last action counts
('allow' before 'block'). An interval runs from its entry to the next one, end exclusive; the last one is open. A capture is exploded into its
host's domains (only itself for an address) and, if paths are listed, its path's beginnings, a list as long as its URL has parts.

The captures' time is dealt into ``BUCKETS`` equal spans. An interval stands in each span that it touches, a capture in its own, and both meet in an
equal-key join by name and span with the time test: a name that a third of all captures have is spread over the spans, and a capture meets
only what its name has in its span. At most one interval of a name holds; the longest domain, then the longest path, decides by a partial aggregate.

Times are numbers, dates or timestamps, of one kind in captures and entries (those of entries are cast to the captures'). Names that no entry can have, by their
number of labels or parts, aren't shuffled, and a capture's other columns are joined back by its row number.

Null hosts, times or actions in entries leave the entry out; a null path is the whole domain. A capture with a null host or time, or before the first entry, has
no entry (null action, not blocked). Repeated captures are judged each; an empty table gives an empty result. Columns of captures that clash with
results are replaced. Very long URLs are handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brasswell.llm.common import table, unused, written

#: In the query, the list has so many dated entries for each host, and days are counted up to this one.
ENTRIES, DAYS = 4, 365
#: Spans of time that captures are dealt into.
BUCKETS = 32
#: Hosts that are addresses, not names.
ADDRESS = r"^(\[.*\]|[0-9.]+)$"


def host_of(url: str) -> Column:
    """The host of a URL column, in lower case, without user, port and final dot; null where there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.$", ""), F.lit(""))


def path_of(url: str) -> Column:
    """The path of a URL column, without query and fragment."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def registered(host: str) -> Column:
    """The domain one registers: the last two labels, three under endings such as co.uk; null for addresses."""
    short = F.regexp_extract(host, r"([^.]+\.(?:(?:com?|org|net|ac|gov|edu)\.[a-z]{2}|[^.]+))$", 1)
    return F.when(~F.col(host).rlike(ADDRESS), F.nullif(short, F.lit("")))


def domains(host: str) -> Column:
    """The host and all domains above it; an address alone."""
    labels = F.split(host, r"\.")
    return F.when(F.col(host).rlike(ADDRESS), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))


def beginnings(path: str) -> Column:
    """The path and all paths above it, the empty one too, without final strokes."""
    clean = F.regexp_replace(F.coalesce(F.col(path), F.lit("")), r"/+$", "")
    parts = F.split(clean, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def intervals(entries: DataFrame) -> DataFrame:
    """host, path ('': all), valid_from, valid_to (null: still), action from host, at, action and path, if there is one."""
    path = F.regexp_replace(F.coalesce(F.col("path"), F.lit("")), r"/+$", "") if "path" in entries.columns else F.lit("")
    named = entries.where("host is not null and at is not null and action is not null").select(F.regexp_replace(F.lower("host"), r"\.$", "").alias("host"), path.alias("path"), "at", "action")
    one = named.groupBy("host", "path", "at").agg(F.max("action").alias("action"))
    upto = F.lead("at").over(Window.partitionBy("host", "path").orderBy("at"))
    return one.select("host", "path", F.col("at").alias("valid_from"), upto.alias("valid_to"), "action")


def _scale(at: Column, kind: T.DataType) -> Column:
    """A time as a number: of days for dates, of microseconds for timestamps."""
    if isinstance(kind, T.DateType):
        return F.unix_date(at)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(at.cast("timestamp"))
    return at


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (with host, fetched and path, if entries have one) and the valid_from, action and blocked of the entry then in force."""
    kept = [c for c in captures.columns if c not in ("valid_from", "valid_to", "action", "blocked")]
    row = unused("_row", kept)
    # Written first: a lost task must not number the rows otherwise.
    base = written(captures.select(*(F.col(f"`{c}`") for c in kept), F.monotonically_increasing_id().alias(row)))
    kind = base.schema["fetched"].dataType
    number = lambda at: _scale(at, kind)
    low, high = base.agg(F.min(number(F.col("fetched"))), F.max(number(F.col("fetched")))).first()
    width = ((high or 0) - (low or 0)) / BUCKETS or 1
    span = lambda at: F.least(F.lit(BUCKETS - 1), F.floor((number(at) - F.lit(low or 0)) / F.lit(width)))
    known = intervals(entries).select("host", "path", F.col("valid_from").cast(kind).alias("valid_from"), F.col("valid_to").cast(kind).alias("valid_to"), "action")
    first, last = F.greatest(F.lit(0), span(F.col("valid_from"))), F.coalesce(span(F.col("valid_to")), F.lit(BUCKETS - 1))
    known = known.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    spans = known.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "valid_from", "valid_to", "action", F.explode(F.sequence("_first", "_last")).alias("_span"))
    # Names of fewer labels or more parts than any listed one can't meet an entry: they aren't shuffled.
    labels, parts = known.agg(F.coalesce(F.min(F.when(~F.col("host").rlike(ADDRESS), F.size(F.split("host", r"\.")))), F.lit(1)), F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(1))).first()
    paths = F.slice(beginnings("path"), 1, parts) if "path" in entries.columns and "path" in kept else F.array(F.lit(""))
    names = F.when(F.col("host").rlike(ADDRESS), domains("host")).otherwise(F.filter(domains("host"), lambda d: F.size(F.split(d, r"\.")) >= labels))
    named = base.where("host is not null and fetched is not null").select(F.col(row).alias("_row"), F.col("fetched").alias("_at"), F.explode(names).alias("_d"), paths.alias("_paths"))
    named = named.select("_row", "_at", "_d", F.explode("_paths").alias("_p"), span(F.col("_at")).alias("_s"))
    same = (F.col("_d") == F.col("_host")) & (F.col("_p") == F.col("_path")) & (F.col("_s") == F.col("_span"))
    met = named.join(spans, same & (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    best = met.groupBy("_row").agg(F.max(F.struct(F.length("_host").alias("h"), F.length("_path").alias("p"), "valid_from", "action")).alias("_entry"))
    told = best.select(F.col("_row").alias(row), "_entry.valid_from", "_entry.action")
    return base.join(told, row, "left").select(*(F.col(f"`{c}`") for c in kept), "valid_from", "action", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"))


def _number(text: Column) -> Column:
    """The first seven hex digits of the digest, as a number."""
    return F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("long")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages``: fetch day and the list's entries (hosts, registered domains, some first parts of paths) are derived from digests."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path"), (_number(F.col("url")) % DAYS).alias("fetched"))
    found = captures.where("host is not null")
    top = found.select("host", F.regexp_extract("path", "^(/[^/]+)", 1).alias("path")).where((F.col("path") != "") & (_number(F.concat("host", "path")) % 8 == 0))
    names = found.select("host", F.lit("").alias("path")).union(found.select(registered("host").alias("host"), F.lit("").alias("path")).where("host is not null")).union(top).distinct()
    mark = _number(F.concat("host", "path", F.lit("|"), F.col("k").cast("string")))
    entries = names.select("host", "path", F.explode(F.sequence(F.lit(1), F.lit(ENTRIES))).alias("k")).select("host", "path", (mark % DAYS).alias("at"), F.when(mark % 2 == 0, "block").otherwise("allow").alias("action"))
    return judge(captures, entries).select("page_id", "host", "fetched", "valid_from", "action", "blocked")


_NUMBER = "('0x' || substr(md5({}), 1, 7))::BIGINT"
_ADDRESS = "regexp_matches(host, '^(\\[.*\\]|[0-9.]+)$')"

#: The same by an as-of join for each name of a capture.
OP2_SQL = f"""
WITH u AS (
  SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]+)', 1)), '\\.$', ''), '') AS host,
    coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '') AS path, {_NUMBER.format("url")} % {DAYS} AS fetched FROM pages),
n AS (
  SELECT host, '' AS path FROM u WHERE host IS NOT NULL
  UNION SELECT regexp_extract(host, '([^.]+\\.(?:(?:com?|org|net|ac|gov|edu)\\.[a-z]{{2}}|[^.]+))$', 1), '' FROM u WHERE host IS NOT NULL AND NOT {_ADDRESS} AND contains(host, '.')
  UNION SELECT host, regexp_extract(path, '^(/[^/]+)', 1) FROM u WHERE host IS NOT NULL AND regexp_extract(path, '^(/[^/]+)', 1) <> '' AND {_NUMBER.format("host || regexp_extract(path, '^(/[^/]+)', 1)")} % 8 = 0),
m AS (SELECT host, path, {_NUMBER.format("host || path || '|' || k::VARCHAR")} AS mark FROM n, range(1, {ENTRIES + 1}) r(k)),
e AS (SELECT host, path, mark % {DAYS} AS since, max(CASE WHEN mark % 2 = 0 THEN 'block' ELSE 'allow' END) AS action FROM m GROUP BY ALL),
d AS (SELECT page_id, host, path, fetched, unnest(CASE WHEN {_ADDRESS} THEN [host] ELSE list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.')) END) AS name FROM u WHERE host IS NOT NULL),
p AS (SELECT *, string_split(regexp_replace(path, '/+$', ''), '/') AS parts FROM d),
c AS (SELECT page_id, name, fetched, unnest(list_transform(range(1, len(parts) + 1), lambda k: array_to_string(parts[:k], '/'))) AS part FROM p),
a AS (SELECT c.page_id, c.name, c.part, e.since, e.action FROM c ASOF JOIN e ON c.name = e.host AND c.part = e.path AND c.fetched >= e.since),
b AS (SELECT page_id, since, action FROM a QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(name) DESC, length(part) DESC) = 1)
SELECT u.page_id, u.host, u.fetched, b.since AS valid_from, b.action, coalesce(b.action = 'block', false) AS blocked FROM u LEFT JOIN b ON u.page_id = b.page_id
"""
