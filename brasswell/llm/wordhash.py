"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from brasswell.llm.common import LOWER

#: Bytes that end a word: blanks only, or everything but letters, digits and bytes of other scripts.
BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
NOT_ALNUM = (np.arange(256) < 48) | ((np.arange(256) > 57) & (np.arange(256) < 97)) | ((np.arange(256) > 122) & (np.arange(256) < 128))

_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """hashes, starts and ends (bytes of data, exclusive) of the words in order; bounds[i]:bounds[i + 1] are those of text i."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray


def words_of(texts: list[str], breaks: np.ndarray = BLANKS) -> Words:
    """A-Z lower-cased words of the texts; no word crosses texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = (b" ".join(raw) + b" ").translate(LOWER)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    codes = np.frombuffer(data, np.uint8)
    inside = ~breaks[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if len(starts):
        at = np.flatnonzero(inside)
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(at)) - np.repeat(first, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _STEP | np.uint64(1), np.uint64))
        hashes = mix(np.add.reduceat(_BYTE[codes[at]] * powers[place], first) + lengths.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, hashes, starts, ends, np.searchsorted(starts, offsets), offsets)


def shingled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence where it is shorter, and none where it is empty."""
    width = min(width, len(hashes))
    if not width:
        return hashes
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(3) + hashes[i : len(hashes) - width + 1 + i] + np.uint64(i + 1))
    return out
