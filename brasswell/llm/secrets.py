"""Secret scans: one combined deterministic automaton finds all rules' matches in one pass over the bytes.

Null and empty texts have no spans. Texts of any length are scanned whole. Ties (spans that begin together) are ordered as
the rules are listed. Repeated rows are scanned each on its own. Extra columns of the input pass through untouched; a column that
clashes with a result column is replaced by it. Rows with a null id are scanned like others; an empty table gives an empty result.

In the combined automaton only one rule counts repetitions, since the counters of several rules would multiply its states: it finds where matches
can end, in one pass over the bytes, and the rules' own automata settle the spans there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brasswell.llm.automaton import accepting, compile_rules
from brasswell.llm.common import chunks, restored, sha256_hex, sheltered, table, texts_of

#: kind, expression, letters in either case, least length of the match (0: any), least length of the value at its end.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "keyword", 12),
    ("access", r"AKIA[A-Z0-9]{14,}", "", 0),
    ("hex", r"[0-9a-f]{16,}", "", 0),
    ("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}", "", 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", "", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "", 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 0),
)
BASE = ("assign", "access", "hex")
VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


@lru_cache(maxsize=1)
def _machines():
    """The combined search automaton, and for each rule one that runs back to a start and one that runs on to the end."""
    rules = [(pattern, fold == "keyword") for _, pattern, fold, _ in RULES]
    # Counters of several rules multiply in one automaton, so there only the hex rule counts; the rules' own automata count all.
    loose = [(re.sub(r"\{\d+,\}", "+", pattern) if kind != "hex" else pattern, fold) for (kind, *_), (pattern, fold) in zip(RULES, rules, strict=True)]
    return compile_rules(loose, search=True), [(compile_rules([r], search=False, back=True), compile_rules([r], search=False)) for r in rules]


def _spans(data: bytes, low: int, high: int, ends: dict[int, np.ndarray], machines) -> list[tuple[int, int, int]]:
    """(start, rule, end) of one text, data[low:high]: leftmost, longest and not overlapping within a rule. ends: by rule, where
    the pass over the bytes saw matches, or short forms of them, end; no match of these rules begins before and ends after another one's first end."""
    found = []
    for rule, at in ends.items():
        back, on = machines[rule]
        k, free = 0, low
        while k < len(at):
            state, i, start = 0, int(at[k]) - 1, -1
            while i >= free:
                state = int(back.step[state * back.width + back.byte_class[data[i]]])
                if state == back.dead:
                    break
                if state >= back.first_accept:
                    start = i
                i -= 1
            if start < 0:
                k += 1
                continue
            state, i, end = 0, start, -1
            while i < high:
                state = int(on.step[state * on.width + on.byte_class[data[i]]])
                if state == on.dead:
                    break
                i += 1
                if state >= on.first_accept:
                    end = i
            least, value = RULES[rule][3], end
            while least and value > start and end - value < least and data[value - 1] in VALUE:
                value -= 1
            if not least or end - value >= least and _value_start(data, start, end) <= end - least:
                found.append((start, rule, end))
            free = end
            k = int(np.searchsorted(at, free, side="right"))
    return sorted(found)


def _value_start(data: bytes, start: int, end: int) -> int:
    """Where the value of an assignment begins: behind the first colon or equals sign, blanks and one quote."""
    i = start
    while data[i] not in b":=":
        i += 1
    i += 1
    while data[i] == 32:
        i += 1
    return i + (data[i] in b"\"'")


def scan_texts(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule, end) in code points, by start and then rule."""
    whole, machines = _machines()
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n"  # no rule takes a line feed, so none crosses texts
    stops = np.cumsum([len(r) + 1 for r in raw])
    ends, states = accepting(whole, np.frombuffer(data, np.uint8))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(stops, ends, side="left")
    bits = whole.accepts[states]
    cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)] if len(owner) else [0]
    for a, b in zip(cuts, cuts[1:]):
        doc = int(owner[a])
        low, high = int(stops[doc]) - len(raw[doc]) - 1, int(stops[doc]) - 1
        by_rule = {r: ends[a:b][(bits[a:b] >> r) & 1 == 1] for r in range(len(RULES)) if ((bits[a:b] >> r) & 1).any()}
        spans = _spans(data, low, high, by_rule, machines)
        if len(raw[doc]) == len(texts[doc]):
            out[doc] = [(s - low, r, e - low) for s, r, e in spans]
        else:  # bytes that continue a code point don't count
            starts = np.concatenate(([0], np.cumsum((np.frombuffer(raw[doc], np.uint8) & 0xC0) != 0x80)))
            out[doc] = [(int(starts[s - low]), r, int(starts[e - low])) for s, r, e in spans]
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an array of (kind, start, end) in code points, end exclusive, in column ``out``. No shuffle."""
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(out, SPAN)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            spans = [[{"kind": RULES[r][0], "start": s, "end": e} for s, r, e in x] for x in scan_texts(texts_of(batch, text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, out])

    return docs.select(*kept).mapInArrow(run, schema)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The same columns; every span of the text is replaced by the mask, overlapping spans by one, and n_chars follows where it is there."""
    own = [c for c in ("text", "n_chars") if c in docs.columns]
    found = find_secrets(sheltered(docs, *own), out="_secrets")
    merged = F.expr("""aggregate(_secrets, cast(array() as array<struct<a: bigint, b: bigint>>), (m, s) ->
        if(size(m) > 0 and s.start < element_at(m, -1).b,
           concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, s.end)))),
           concat(m, array(named_struct('a', s.start, 'b', s.end)))))""")
    clean = F.expr(f"""concat(
        array_join(transform(_merged, (s, i) -> concat(substring(text, cast(if(i = 0, 0, _merged[i - 1].b) as int) + 1,
            cast(s.a - if(i = 0, 0, _merged[i - 1].b) as int)), '{mask}')), ''),
        substring(text, cast(element_at(_merged, -1).b as int) + 1))""")
    out = found.withColumn("_merged", merged).withColumn("text", F.when(F.size("_secrets") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("_secrets") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*restored(docs, *own))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts by base kind, digest of the base spans, all spans."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told("secrets").alias("spans"))


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    return sha256_hex(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
