"""Progressive JPEG: scans of spectral selection and successive approximation, gathered into coefficient arrays in numpy.

The payload lies losslessly in the coefficients, this format's unit: 192 bytes are a unit of three blocks (no subsampling), a byte each.
A byte of an AC coefficient lies around the small letters, no nearer to zero than 2, so that its first bits and signs are all in the first scan; a
DC byte is sent as its difference to the block before in the same component, through the whole scan. Sizes have Huffman codes from the text's own
counts, one table for DC and one for AC, and the AC refinements are runs of ended bands. Reading looks up the length of a code at each bit, follows them in one chain
and takes all values at once where the tables allow it (codes of 8 bits at most, no runs of zeros); it reads other progressive files code by code. Reading decodes
every scan, inverse-transforms, brings chroma to full resolution and converts to RGB.

Null text counts as empty: one unit of blanks. Equal texts give equal values. Texts of any length fit: lines of 256 units, up to the
format's height, then wider; units that fill the last line are zero. Columns that clash with results are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswell.llm.common import chunks, table, texts_of

UNIT = 192
BANDS = ((1, 31), (32, 63))


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in order of transmission: along anti-diagonals, turning at each."""
    return np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else -p[0]))])


@lru_cache(maxsize=1)
def _inverse() -> np.ndarray:
    """(coefficient in order of transmission, pixel): the two-dimensional inverse cosine transform."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _signed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category and further bits of each value."""
    size = np.array([int(abs(x)).bit_length() for x in v.tolist()])
    return size, np.where(v < 0, v + (1 << size) - 1, v)


#: Of each byte: the AC coefficient; of that without its last bit, and of each DC difference from -127 on: size category and further bits.
COEFFICIENT = np.where(np.arange(256) < 96, np.arange(256) - 97, np.arange(256) - 94)
OF_AC = _signed(np.sign(COEFFICIENT) * (abs(COEFFICIENT) >> 1))
OF_DC = _signed(np.arange(-127, 128))
#: Most blocks that one run of ended bands covers; symbols that are coded at once; text whose files are written and read side by side.
RUN, PIECE, GROUP = 0x7FFF, 1 << 18, 1 << 18
#: Which of 32 bits are the first n, by n.
BEFORE = np.arange(32) < np.arange(33)[:, None]


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman's code length of each symbol. A symbol that never occurs (-1) takes the longest code, as that of ones alone isn't allowed."""
    out = dict.fromkeys((-1, *counts), 0)
    heap = [(0, -1, [-1]), *((n, k, [k]) for k, n in counts.items())]
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, k, x), (m, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for symbol in x + y:
            out[symbol] += 1
        heapq.heappush(heap, (n + m, k, x + y))
    return {k: n for k, n in out.items() if k >= 0}


@lru_cache(maxsize=64)
def _table(kind: int, counts: tuple[tuple[int, int], ...]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table for symbols that occur so often, and each one's (length, code)."""
    lengths = _lengths(dict(counts))
    symbols = bytes(sorted(lengths, key=lambda k: (lengths[k], k)))
    of = bytearray(16)
    for n in lengths.values():
        of[n - 1] += 1
    return _segment(0xC4, bytes([kind << 4]) + of + symbols), {s: c for c, s in _codes(of, symbols).items()}


def _book(kind: int, of: tuple[np.ndarray, np.ndarray], times: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """For values of given sizes and further bits that occur so many times: the table, and each one's bits (as a number) and how many they are."""
    size, more = of
    counts = np.bincount(size, times).tolist()
    table, codes = _table(kind, tuple((k, int(n)) for k, n in enumerate(counts) if n))
    length, code = np.array([codes.get(k, (0, 0)) for k in range(len(counts))]).T
    return table, code[size] << size | more, length[size] + size


def _books(kind: int, of: tuple[np.ndarray, np.ndarray], file: np.ndarray, values: np.ndarray, files: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The tables of each file, whose rows have these values; bits and their numbers by 256 times the file plus the value."""
    index = (file.reshape(-1, *[1] * (values.ndim - 1)) + values).reshape(-1)
    times = np.bincount(index, minlength=256 * files).reshape(files, 256)[:, : len(of[0])]
    tables, word, n = zip(*(_book(kind, of, t) for t in times), strict=True)
    wide = lambda x: np.pad(np.stack(x), ((0, 0), (0, 256 - len(of[0])))).reshape(-1)
    return list(tables), wide(word), wide(n)


def _coded(index: np.ndarray, word: np.ndarray, n: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bits of all values, as bytes of each file, which has so many values."""
    pieces, size = [], n.take(index)
    for i in range(0, len(index), PIECE):
        k = size[i : i + PIECE]
        wide = -(-int(k.max()) // 8)
        left = (word.take(index[i : i + PIECE]) << 32 - k).astype(">u4").view(np.uint8).reshape(-1, 4)[:, :wide]
        pieces.append(np.unpackbits(left, axis=1)[BEFORE[:, : 8 * wide].take(k, axis=0)])
    return _filled(np.concatenate(pieces), np.add.reduceat(size, np.cumsum(counts) - counts))


def _filled(bits: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Bits as bytes of each file, which has so many bits, filled up with ones."""
    left = -counts % 8
    data = np.packbits(np.insert(bits, np.repeat(np.cumsum(counts), left), 1)).tobytes()
    ends = np.cumsum(counts + left) // 8
    return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _scan(components: list[int], low: int, high: int, before: int, now: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c, 0)), low, high, before << 4 | now])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\0")


def encode(payload: bytes) -> bytes:
    """The payload (a positive multiple of 192 bytes) as a progressive JPEG."""
    return encode_all([payload])[0]


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a file of its own; what is the same for all is done side by side."""
    units = np.array([len(p) // UNIT for p in payloads])
    width = np.minimum(units, np.maximum(256, -(-units // 8191)))
    n = -(-units // width) * width
    b = np.frombuffer(b"".join(p.ljust(UNIT * k, b"\0") for p, k in zip(payloads, n.tolist(), strict=True)), np.uint8).reshape(-1, 3, 64)
    file = np.repeat(256 * np.arange(len(n)), n)
    out = []
    for p, w, h in zip(payloads, width.tolist(), (n // width).tolist(), strict=True):
        frame = bytes([8]) + (h * 8).to_bytes(2, "big") + (w * 8).to_bytes(2, "big") + bytes([3, *(x for c in (1, 2, 3) for x in (c, 0x11, 0))])
        out.append([b"\xff\xd8", _segment(0xFE, f"bytes={len(p)}".encode()), _segment(0xDB, bytes([0, *[1] * 64])), _segment(0xC2, frame)])

    def add(parts: list[bytes], *scan) -> None:
        for x, part in zip(out, parts, strict=True):
            x.append(_scan(*scan, part) if scan else part)

    dc = b[:, :, 0].astype(np.int16) - 96 >> 1
    steps, first = np.diff(dc, axis=0, prepend=np.int16(0)), np.cumsum(n) - n
    steps[first] = dc[first]
    steps += 127
    tables, *book = _books(0, OF_DC, file, steps, len(n))
    add(tables)
    add(_coded((file[:, None] + steps).reshape(-1), *book, 3 * n), [1, 2, 3], 0, 0, 0, 1)
    tables, *book = _books(1, OF_AC, file, b[:, :, 1:], len(n))
    add(tables)
    bands = [(low, high, c) for low, high in BANDS for c in range(3)]
    for low, high, c in bands:
        add(_coded((file[:, None] + b[:, c, low : high + 1]).reshape(-1), *book, (high - low + 1) * n), [c + 1], low, high, 0, 1)
    add(_filled((b[:, :, 0] & 1).reshape(-1), 3 * n), [1, 2, 3], 0, 0, 1, 0)
    heads, begins, more, tables = [], [], np.zeros(len(n), np.int64), []
    for k, (start, blocks) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
        runs = [min(RUN, blocks - i) for i in range(0, blocks, RUN)]
        classes = [r.bit_length() - 1 for r in runs]
        table, codes = _table(1, tuple((x << 4, classes.count(x)) for x in sorted(set(classes))))
        tables.append(table)
        for i, (r, x) in enumerate(zip(runs, classes, strict=True)):
            length, code = codes[x << 4]
            head = code << x | r - (1 << x)
            heads += [head >> j & 1 for j in range(length + x - 1, -1, -1)]
            begins += [start + i * RUN] * (length + x)
            more[k] += length + x
    add(tables)
    last = b & 1 ^ (b < 96)  # of the magnitude: those of negative coefficients are 97 less the byte
    heads, begins = np.array(heads, np.uint8), np.array(begins)
    for low, high, c in bands:
        size = high - low + 1
        add(_filled(np.insert(last[:, c, low : high + 1].reshape(-1), begins * size, heads), size * n + more), [c + 1], low, high, 1, 0)
    return [b"".join([*x, b"\xff\xd9"]) for x in out]


class _Reader:
    """Codes and bits of a scan without stuffing, one by one."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.at = bits.tolist(), 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value * 2 + (self.bits[self.at] if self.at < len(self.bits) else 0)
            self.at += 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code * 2 + self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code *= 2
    return out


def _parts(data: np.ndarray) -> list[np.ndarray]:
    """The bits of each restart interval."""
    mark = np.flatnonzero((data[:-1] == 255) & (data[1:] >= 208) & (data[1:] <= 215)) if len(data) > 1 else np.zeros(0, int)
    out = []
    for a, b in zip([0, *(mark + 2).tolist()], [*mark.tolist(), len(data)], strict=True):
        part = data[a:b]
        out.append(np.unpackbits(np.delete(part, np.flatnonzero(part[:-1] == 255) + 1)))
    return out


def _plain(data: np.ndarray) -> np.ndarray:
    """The bytes of a scan without restarts, without stuffing."""
    return np.frombuffer(data.tobytes().replace(b"\xff\0", b"\xff"), np.uint8)


#: What a reader sees behind the last byte; the places of eight bits in two bytes, from the first bit of the first on.
FILL, SHIFTS = np.full(4, 255, np.uint8), np.arange(8, 0, -1, dtype=np.uint16)


@lru_cache(maxsize=64)
def _lookup(codes: tuple[tuple[tuple[int, int], int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the 8 bits from a place on: length of the code there (0: none), its symbol, and the length with as many further bits."""
    length, symbol = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for (n, code), s in codes:
        length[code << 8 - n : code + 1 << 8 - n] = n
        symbol[code << 8 - n : code + 1 << 8 - n] = s
    return length, symbol, length + symbol


def _values(parts: list[np.ndarray], codes: list[dict[tuple[int, int], int]], counts: np.ndarray) -> np.ndarray:
    """The first values, as many as counts say, of a scan of each file (without stuffing) in which each code's symbol is the size of a value behind it."""
    known = {id(c): c for c in codes}
    known = {k: _lookup(tuple(c.items())) for k, c in known.items()}
    length, symbol, far = (np.concatenate(x) for x in zip(*(known[id(c)] for c in codes), strict=True))
    sizes = np.array([len(p) + len(FILL) for p in parts])
    data = np.concatenate([x for p in parts for x in (p, FILL)])
    two = data[:-1].astype(np.uint16) << 8 | data[1:]
    peek = (two[:, None] >> SHIFTS).astype(np.uint8)
    if len(parts) > 1:
        peek = peek + np.repeat(256 * np.arange(len(parts), dtype=np.int32), sizes)[:-1, None]
    peek = peek.reshape(-1)
    step, ends = far.take(peek).tobytes(), []
    first = 8 * (np.cumsum(sizes) - sizes)
    for place, size, count in zip(first.tolist(), sizes.tolist(), counts.tolist(), strict=True):
        behind = place + 8 * size
        ends += [place := place + step[place] for _ in range(count)]
        if place > behind - 8 * len(FILL):
            raise ValueError("the scan is too short")
    ends = np.array(ends, np.int64)
    begin = np.append(0, ends[:-1])
    begin[np.cumsum(counts) - counts] = first
    seen = peek.take(begin)
    if not length.take(seen).all():
        raise ValueError("no such code")
    size = symbol.take(seen).astype(np.int32)
    begin = ends - size
    first = begin >> 3
    v = two.take(first).astype(np.int32) << 8 | data.take(first + 2)
    full = (1 << size) - 1
    v = v >> 24 - (begin & 7) - size & full
    return np.where(2 * v > full, v, v - full)


def decode(media: bytes, fast: bool = True) -> tuple[list[np.ndarray], dict]:
    """Coefficients of each component (rows of blocks, blocks, 64 in order of transmission), and the header's fields."""
    return decode_all([media], fast)[0]


def decode_all(files: list[bytes], fast: bool = True) -> list[tuple[list[np.ndarray], dict]]:
    """decode() of each file; those with the same scans are read side by side."""
    parsed = [_parsed(media) for media in files]
    alike: dict[tuple, list[int]] = {}
    for i, (shapes, head, scans) in enumerate(parsed):
        plain = fast and all(p[1:3] == (1, 1) for p in head["parts"]) and not any(s[6] for s in scans) and all(n <= 8 for n in {id(c): max((n for n, _ in c), default=0) for s in scans for t in s[1] for c in t if c}.values())
        alike.setdefault((len(shapes), *((tuple(s[0]), *s[2:6]) for s in scans)) if plain else (i,), []).append(i)
    out: list = [None] * len(files)
    for key, mine in alike.items():
        blocks = np.array([[r * k for r, k, _ in parsed[i][0]] for i in mine])
        planes = [np.zeros((n, 64), np.int32) for n in blocks.sum(axis=0).tolist()]
        ends = np.cumsum(blocks, axis=0).tolist()
        for i, end, size in zip(mine, ends, blocks.tolist(), strict=True):
            out[i] = ([p[e - n : e].reshape(shape) for p, e, n, shape in zip(planes, end, size, parsed[i][0], strict=True)], parsed[i][1])
        for scans in zip(*(parsed[i][2] for i in mine), strict=True):
            if len(key) == 1 or not _scan_at_once(planes, blocks[:, 0], scans):
                for i, scan in zip(mine, scans, strict=True):
                    _scan_by_codes(*out[i], *scan)
    return out


def _parsed(media: bytes) -> tuple[list[tuple[int, int, int]], dict, list[tuple]]:
    """The shape of each component's coefficients, the header's fields, and the scans as they are read by codes."""
    raw = np.frombuffer(media, np.uint8)
    at, head, codes, quant, restart = 2, {"comment": b""}, {}, {}, 0
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0) & ((raw[1:] < 208) | (raw[1:] > 215)))
    shapes: list[tuple[int, int, int]] = []
    scans: list[tuple] = []
    while media[at + 1] != 0xD9:
        marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            head["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC2:
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
            mw, mh = -(-w // (8 * hm)), -(-h // (8 * vm))
            head |= {"size": (h, w), "parts": parts, "most": (hm, vm)}
            shapes = [(mh * p[2], mw * p[1], 64) for p in parts]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            end = int(marks[np.searchsorted(marks, at)])
            n = body[0]
            which = [next(i for i, p in enumerate(head["parts"]) if p[0] == body[1 + 2 * k]) for k in range(n)]
            tables = [(codes.get(body[2 + 2 * k] >> 4), codes.get(16 | body[2 + 2 * k] & 15)) for k in range(n)]
            low, high, before, now = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            scans.append((which, tables, low, high, before, now, restart, raw[at:end]))
            at = end
    head["quant"] = quant
    return shapes, head, scans


def _scan_at_once(planes: list[np.ndarray], blocks: np.ndarray, scans: list[tuple]) -> bool:
    """Reads a scan of files whose values all can be placed before they are read; says whether it was one. planes: of each component the blocks of all files;
    blocks: of each file; scans: as they are read by codes."""
    which, _, low, high, before, now = scans[0][:6]
    parts = [_plain(s[-1]) for s in scans]
    if low == 0 and before:
        counts = (blocks * len(which)).tolist()
        bits = np.concatenate([np.unpackbits(p)[:n] for p, n in zip(parts, counts, strict=True)]).reshape(-1, len(which))
        for k, c in enumerate(which):
            planes[c][:, 0] |= bits[:, k].astype(np.int32) << now
        return True
    codes = [s[1][0][1 if low else 0] for s in scans]
    if low == 0:
        if any(t[0] != c for s, c in zip(scans, codes, strict=True) for t in s[1]) or max(max(c.values()) for c in codes) > 15:
            return False
        values = _values(parts, codes, blocks * len(which)).reshape(-1, len(which)).cumsum(axis=0)
        ends = np.cumsum(blocks)
        values -= np.repeat(np.concatenate((values[:1] * 0, values[ends[:-1] - 1])), blocks, axis=0)
        for k, c in enumerate(which):
            planes[c][:, 0] = values[:, k] << now
        return True
    block = planes[which[0]][:, low : high + 1]
    width = block.shape[1]
    if not before and all(0 < s < 16 for c in codes for s in c.values()):
        block[:] = (_values(parts, codes, blocks * width) << now).reshape(block.shape)
        return True
    if before and all(s < 240 and not s & 15 for c in codes for s in c.values()) and block.all():
        pieces = []
        for part, code, n in zip(parts, codes, blocks.tolist(), strict=True):
            bits, at, place = np.unpackbits(part), 0, 0
            while at < n:
                read = _Reader(bits[place : place + 32])
                k = read.symbol(code) >> 4
                run = min((1 << k) + read.take(k), n - at)
                place += read.at
                pieces.append(bits[place : place + run * width])
                at, place = at + run, place + run * width
        more = np.concatenate(pieces).reshape(block.shape).astype(np.int32) << now
        block += np.where(block < 0, -more, more)
        return True
    return False


def _scan_by_codes(coefficients, head, which, tables, low, high, before, now, restart, data) -> None:
    """Reads any progressive scan code by code."""
    parts = _parts(data)
    h, w = head["size"]
    hm, vm = head["most"]
    if len(which) == 1:
        p, c = head["parts"][which[0]], coefficients[which[0]]
        rows, columns = -(-(-(-h * p[2] // vm)) // 8), -(-(-(-w * p[1] // hm)) // 8)
        units = [[(0, c[r, k])] for r in range(rows) for k in range(columns)]
    else:
        mh, mw = -(-h // (8 * vm)), -(-w // (8 * hm))
        units = [[(i, coefficients[c][r * head["parts"][c][2] + y, k * head["parts"][c][1] + x]) for i, c in enumerate(which) for y in range(head["parts"][c][2]) for x in range(head["parts"][c][1])] for r in range(mh) for k in range(mw)]
    each = restart or len(units)
    for start, bits in zip(range(0, len(units), each), parts):
        read, last, run = _Reader(bits), [0] * len(which), 0
        for unit in units[start : start + each]:
            for i, block in unit:
                if low == 0 and before:
                    block[0] |= read.take(1) << now
                elif low == 0:
                    last[i] += read.signed(read.symbol(tables[i][0]))
                    block[0] = last[i] << now
                elif not before:
                    run = _ac_first(read, tables[i][1], block, low, high, now, run)
                else:
                    run = _ac_refine(read, tables[i][1], block, low, high, now, run)


def _ac_first(read: _Reader, codes, block, low: int, high: int, now: int, run: int) -> int:
    if run:
        return run - 1
    k = low
    while k <= high:
        skip, size = divmod(read.symbol(codes), 16)
        if size:
            k += skip
            block[k] = read.signed(size) * (1 << now)
        elif skip < 15:
            return (1 << skip) + read.take(skip) - 1
        else:
            k += 15
        k += 1
    return 0


def _ac_refine(read: _Reader, codes, block, low: int, high: int, now: int, run: int) -> int:
    k = low
    while k <= high and not run:
        skip, size = divmod(read.symbol(codes), 16)
        if not size and skip < 15:
            run = (1 << skip) + read.take(skip)
            break
        new = (1 if read.take(1) else -1) << now if size else 0
        while k <= high:
            if block[k]:
                block[k] += np.sign(block[k]) * (read.take(1) << now)
            elif skip:
                skip -= 1
            else:
                block[k] = new
                k += 1
                break
            k += 1
    if run:
        for k in range(k, high + 1):
            if block[k]:
                block[k] += np.sign(block[k]) * (read.take(1) << now)
        run -= 1
    return run


def pixels(coefficients: list[np.ndarray], head: dict) -> np.ndarray:
    """RGB of full resolution, (height, width, 3) unsigned bytes."""
    (h, w), (hm, vm), planes = head["size"], head["most"], []
    for c, p in zip(coefficients, head["parts"], strict=True):
        rows, columns, _ = c.shape
        plane = ((c * head["quant"][p[3]]).reshape(-1, 64).astype(np.float32) @ _inverse()).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        planes.append(plane.repeat(vm // p[2], axis=0).repeat(hm // p[1], axis=1)[:h, :w])
    y = planes[0] + 128
    if len(planes) == 1:
        planes = [planes[0], np.zeros_like(y), np.zeros_like(y)]
    cb, cr = planes[1:3]
    rgb = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def payload_of(coefficients: list[np.ndarray], head: dict) -> bytes:
    """The bytes that encode() put into the coefficients."""
    v = np.stack([c.reshape(-1, 64) for c in coefficients], axis=1)
    out = v + np.where(v < 0, 97, 94)
    out[:, :, 0] = v[:, :, 0] + 96
    return out.astype(np.uint8).tobytes()[: int(head["comment"].removeprefix(b"bytes="))]


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b" " * (-len(data) % unit if data else unit)


FIELDS = (("media", pa.binary(), "binary"), ("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"),
    ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"), ("height", pa.int64(), "long"), ("width", pa.int64(), "long"), ("rgb", pa.binary(), "binary"))


def media_columns(docs: DataFrame, text: str = "text", wanted: tuple[str, ...] = tuple(f[0] for f in FIELDS)) -> DataFrame:
    """docs, without the text, and the wanted ones of: the stored file, digests of what is read back, a feature (means and deviations of RGB), and the RGB tensor."""
    fields = [f for f in FIELDS if f[0] in wanted]
    kept = [c for c in docs.columns if c not in wanted and c != text]
    base = docs.select(*kept, text)
    schema = docs.select(*kept, *(F.lit(None).cast(k).alias(n) for n, _, k in fields)).schema

    def row(data: bytes, media: bytes, coefficients: list[np.ndarray], head: dict) -> tuple:
        back, rgb = payload_of(coefficients, head), pixels(coefficients, head)
        flat = rgb.reshape(-1, 3)
        feature = ",".join(f"{x:.3f}" for x in (*flat.mean(axis=0), *flat.std(axis=0, dtype=np.float32)))
        all_ = (media, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, *head["size"], rgb.tobytes())
        return tuple(v for v, f in zip(all_, FIELDS, strict=True) if f[0] in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text, GROUP):
            data = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch, text)]
            files = encode_all([padded(d) for d in data])
            rows = zip(*(row(d, media, *read) for d, media, read in zip(data, files, decode_all(files), strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, f[1]) for c, f in zip(rows, fields, strict=True))], schema.names)

    return base.mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), wanted=wanted)
