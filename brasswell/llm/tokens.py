"""Token counts by overlap resynchronisation.

A text of more than ``chunk`` characters is encoded in overlapping chunks with offsets. Two neighbours are spliced at a place
inside their overlap where both encodings have a token boundary and that is proven stable: the vocabulary's split begins a piece there whatever
stands around it, so no merge and no special string reaches across. Such places are those before white space and, between characters that are not, those where
letters end (before digits and signs) or digits end. A chunk reaches as far as such a place: where it holds none it doubles before it is encoded, so text
without any place costs one encoding. Where the two encodings don't meet at the place, the overlap doubles.

Null and empty texts have no tokens. Whole texts are counted, whatever their length. Repeated rows are counted each. Columns of the
input that clash with a result column are replaced by it; an empty table gives an empty result. The encoder takes the same
vocabulary from its rank file, which gives the ids of the merge file's library (a test compares them) at four times its speed;
the special string is one id, as that library has it by default.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.llm.common import chunks, table, texts_of

CHUNK_CHARS = 1 << 12
OVERLAP_CHARS = 1 << 7
SPECIAL = "<|endoftext|>"
LIMIT = 512


@lru_cache(maxsize=4)
def encoder(ranks: str):
    """The encoder of a rank file; one for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={SPECIAL: len(table_)})


@lru_cache(maxsize=4)
def _sizes(ranks: str) -> np.ndarray:
    e = encoder(ranks)
    sizes = np.zeros(e.n_vocab, np.int64)
    for token in range(e.n_vocab):
        sizes[token] = len(e.decode_single_token_bytes(token))
    return sizes


def _ids(text: str, ranks: str) -> np.ndarray:
    return encoder(ranks).encode_to_numpy(text, allowed_special="all")


def _with_ends(text: str, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and where each one ends in the bytes of the text."""
    ids = _ids(text, ranks)
    return ids, np.cumsum(_sizes(ranks)[ids])


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """L(etter), N(umber) or another sign; "" for characters whose class isn't the same in all versions of Unicode, and for white space."""
    old, new = unicodedata.ucd_3_2_0.category(c)[0], unicodedata.category(c)[0]
    return "" if old != new or old == "C" or c.isspace() else old if old in "LN" else "S"


def _begins(text: str, at: int) -> bool:
    """Whether a piece begins at the place (not the first) whatever stands around it."""
    before, here = text[at - 1], text[at]
    if here in " \t\n\r\u3000":
        return not before.isspace()
    if here == "|":  # the special string has a letter before it
        return False
    x, y = _kind(before), _kind(here)
    return x == "L" and y in ("N", "S") or x == "N" and y in ("L", "S")


def _stable(text: str, low: int, high: int) -> int | None:
    """The last place behind low and before high where a piece begins."""
    return next((at for at in range(min(high, len(text)) - 1, low, -1) if _begins(text, at)), None)


def _reach(text: str, begin: int, behind: int, chunk: int) -> tuple[int, int | None]:
    """Where a chunk from ``begin`` ends, and the last stable place in it behind ``behind``; none where it takes the rest of the text."""
    end, low = max(begin, behind) + chunk, behind
    while end < len(text):
        place = _stable(text, low, end)
        if place:
            return end, place
        low, end = end - 1, begin + 2 * (end - begin)
    return len(text), None


def encode_long(text: str, ranks: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of the whole text from chunks of about ``chunk`` characters."""
    return spliced(text, ranks, chunk, overlap).tolist()


def spliced(text: str, ranks: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """encode_long() as an array."""
    if len(text) <= chunk:
        return _ids(text, ranks)
    out: list[np.ndarray] = []
    start = 0
    end, place = _reach(text, 0, 0, chunk)
    left, left_ends = _with_ends(text[:end], ranks)
    while place:
        reach = overlap
        while True:
            begin = max(start, place - reach)
            stop, later = _reach(text, begin, place, chunk)
            right, right_ends = _with_ends(text[begin:stop], ranks)
            lead = len(text[start:begin].encode("utf-8", "surrogatepass"))
            b = len(text[begin:place].encode("utf-8", "surrogatepass"))
            i, j = np.searchsorted(left_ends, lead + b), np.searchsorted(right_ends, b)
            if i < len(left_ends) and left_ends[i] == lead + b and j < len(right_ends) and right_ends[j] == b:
                break
            if begin == start:  # the chunk grows over the place instead
                i, j = -1, -1
                break
            reach *= 2
        out.append(left[: i + 1])
        base = int(right_ends[j]) if j >= 0 else 0
        start = place if j >= 0 else begin
        left, left_ends, place = right[j + 1 :], right_ends[j + 1 :] - base, later
    return np.concatenate([*out, left])


def encode_all(texts: list[str], ranks: str, chunk: int = CHUNK_CHARS) -> list[np.ndarray]:
    return [spliced(t, ranks, chunk) for t in texts]


def count_tokens(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of every whole text in column ``out``. No shuffle."""
    kept = docs.select(*[c for c in docs.columns if c != out])
    schema = kept.withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in encode_all(texts_of(batch, text), ranks)], pa.int64())], schema.names)

    return kept.mapInArrow(run, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return count_tokens(sized).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
