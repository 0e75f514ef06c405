"""Progressive files as other encoders write them: end-of-band runs, runs of zeros, refinements, subsampled chroma, restarts."""

import numpy as np
import pytest

from brasswell.llm import jpeg

DC = list(range(12))
AC = [r << 4 | s for r in range(16) for s in range(11)]


class Bits:
    def __init__(self):
        self.out = []

    def put(self, value, n):
        self.out += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def code(self, symbols, symbol):
        self.put(symbols.index(symbol), 8)

    def signed(self, v, size):
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def bytes(self):
        data = np.packbits(self.out + [1] * (-len(self.out) % 8)).astype(np.uint8)
        return np.insert(data, np.flatnonzero(data == 255) + 1, 0).tobytes()


def size_of(v):
    return int(abs(v)).bit_length()


def shifted(v, now):
    return int(np.sign(v)) * (abs(int(v)) >> now)


def ac_scan(blocks, low, high, before, now):
    out, run, waiting = Bits(), 0, []

    def end_run():
        nonlocal run, waiting
        if run:
            n = run.bit_length() - 1
            out.code(AC, n << 4)
            out.put(run - (1 << n), n)
            for b in waiting:
                out.put(b, 1)
        run, waiting = 0, []

    for block in blocks:
        values = [shifted(v, now) for v in block[low : high + 1]]
        zeros, fix = 0, []
        last = max([k for k, v in enumerate(values) if abs(v) == 1], default=-1)
        for k, v in enumerate(values):
            if not v:
                zeros += 1
                continue
            while zeros > 15 and (not before or k <= last):
                end_run()
                out.code(AC, 0xF0)
                zeros -= 16
                for b in fix:
                    out.put(b, 1)
                fix = []
            if before and abs(v) > 1:
                fix.append(abs(v) & 1)
                continue
            end_run()
            if before:
                out.code(AC, zeros << 4 | 1)
                out.put(int(v > 0), 1)
                for b in fix:
                    out.put(b, 1)
                fix = []
            else:
                out.code(AC, zeros << 4 | size_of(v))
                out.signed(v, size_of(v))
            zeros = 0
        if zeros or fix:
            run += 1
            waiting += fix
            if run == 0x7FFF or len(waiting) > 900:
                end_run()
    end_run()
    return out.bytes()


def dc_scan(units, now, restart):
    """units: a list of (component, block) for each unit."""
    parts, out, last = [], Bits(), {}
    for i, unit in enumerate(units):
        if restart and i and i % restart == 0:
            parts.append(out.bytes())
            out, last = Bits(), {}
        for c, block in unit:
            v = int(block[0]) >> now
            d = v - last.get(c, 0)
            last[c] = v
            out.code(DC, size_of(d))
            if d:
                out.signed(d, size_of(d))
    parts.append(out.bytes())
    return b"".join(p if not i else bytes([0xFF, 0xD0 + (i - 1) % 8]) + p for i, p in enumerate(parts))


def table(kind, number, symbols):
    return jpeg._segment(0xC4, bytes([kind << 4 | number, *[0] * 7, len(symbols), *[0] * 8, *symbols]))


@pytest.mark.parametrize(("h", "w", "sampled", "restart", "share"), [(24, 40, (2, 2), 0, 0.1), (17, 33, (2, 1), 3, 0.4), (16, 16, (1, 1), 0, 0.02), (8, 64, (1, 1), 1, 0.9), (30, 30, (2, 2), 2, 0.0)])
def test_other_progressive_files(h, w, sampled, restart, share):
    rng = np.random.default_rng(h * w)
    parts = [(1, *sampled, 0), (2, 1, 1, 0), (3, 1, 1, 0)]
    hm, vm = sampled
    mw, mh = -(-w // (8 * hm)), -(-h // (8 * vm))
    planes, seen = [], []
    for _, a, b, _ in parts:
        plane = np.where(rng.random((mh * b, mw * a, 64)) < share, rng.integers(-90, 91, (mh * b, mw * a, 64)), 0).astype(np.int32)
        plane[:, :, 0] = rng.integers(-400, 401, plane.shape[:2])
        rows, columns = -(-(-(-h * b // vm)) // 8), -(-(-(-w * a // hm)) // 8)
        plane[rows:, :, 1:] = 0  # blocks that only fill units have no more than their first coefficient
        plane[:, columns:, 1:] = 0
        planes.append(plane)
        seen.append([plane[r, k] for r in range(rows) for k in range(columns)])
    units = [[(i, planes[i][r * b + y, k * a + x]) for i, (_, a, b, _) in enumerate(parts) for y in range(b) for x in range(a)] for r in range(mh) for k in range(mw)]
    frame = bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, *(x for c, a, b, q in parts for x in (c, a << 4 | b, q))])
    scan = lambda cs, low, high, before, now, data: jpeg._segment(0xDA, bytes([len(cs), *(x for c in cs for x in (c, 0)), low, high, before << 4 | now])) + data
    fix = Bits()
    for unit in units:
        for _, block in unit:
            fix.put(int(block[0]) & 1, 1)
    out = [b"\xff\xd8", jpeg._segment(0xDB, bytes([0, *[2] * 64])), jpeg._segment(0xC2, frame), table(0, 0, DC), table(1, 0, AC)]
    if restart:
        out.append(jpeg._segment(0xDD, restart.to_bytes(2, "big")))
    out.append(scan([1, 2, 3], 0, 0, 0, 1, dc_scan(units, 1, restart)))
    if restart:
        out.append(jpeg._segment(0xDD, (0).to_bytes(2, "big")))
    for c in (1, 2, 3):
        for low, high in ((1, 5), (6, 63)):
            out.append(scan([c], low, high, 0, 2, ac_scan(seen[c - 1], low, high, 0, 2)))
            out.append(scan([c], low, high, 2, 1, ac_scan(seen[c - 1], low, high, 2, 1)))
    out.append(scan([1, 2, 3], 0, 0, 1, 0, fix.bytes()))
    for c in (3, 1, 2):
        out.append(scan([c], 1, 63, 1, 0, ac_scan(seen[c - 1], 1, 63, 1, 0)))
    media = b"".join([*out, b"\xff\xd9"])
    for fast in (True, False):
        got, head = jpeg.decode(media, fast=fast)
        assert all((a == b).all() for a, b in zip(got, planes, strict=True))
        rgb = jpeg.pixels(got, head)
        assert rgb.shape == (h, w, 3)
    # the pixel at a corner, from the cosine sum itself
    y = sum(planes[0][0, 0, k] * 2 * jpeg._inverse()[k, 0] for k in range(64)) + 128
    cr = sum(planes[2][0, 0, k] * 2 * jpeg._inverse()[k, 0] for k in range(64))
    assert abs(int(rgb[0, 0, 0]) - min(255, max(0, round(float(y + 1.402 * cr))))) <= 1


def marks_of(media, marker):
    """The bodies of all segments of a kind, and of the scans' heads the data behind them."""
    at, out = 2, []
    while media[at + 1] != 0xD9:
        size = int.from_bytes(media[at + 2 : at + 4], "big")
        body, end = media[at + 4 : at + 2 + size], at + 2 + size
        if media[at + 1] == 0xDA:
            while media[end] != 255 or media[end + 1] == 0 or 208 <= media[end + 1] <= 215:
                end += 1
        if media[at + 1] == marker:
            out.append((body, media[at + 2 + size : end]))
        at = end
    return out


def test_prediction_and_codes_have_effect():
    """DC goes by differences through the whole scan (no restarts), and frequent sizes have shorter codes, so that what is written depends on both."""
    text = ("It was the best of times, it was the worst of times. " * 400).encode()
    payload = jpeg.padded(text)
    media = jpeg.encode(payload)
    assert len(media) < 0.95 * len(payload)
    assert not marks_of(media, 0xDD)
    tables = [body for body, _ in marks_of(media, 0xC4)]
    assert all(len({n for n, k in enumerate(t[1:17], 1) if k}) > 1 for t in tables[:2])  # codes of several lengths
    # A unit's DC is told by what stands before it: after another first unit, the same second unit has other bits.
    units = [bytes([65 + i]) * 192 for i in (0, 9, 20)]
    scans = [marks_of(jpeg.encode(a + units[1]), 0xDA)[0][1] for a in (units[0], units[2])]
    assert scans[0] != scans[1]
    same = [len(marks_of(jpeg.encode(units[1] * n), 0xDA)[0][1]) for n in (64, 128)]
    assert same[1] - same[0] <= 64 * 3 // 8 + 1  # a difference of 0 is one bit


@pytest.mark.parametrize("payload", [bytes(range(256)) * 3, bytes(192), b"\xff" * 192 * 3, b" " * 192, bytes(np.random.default_rng(3).integers(0, 256, 192 * 700, np.uint8)), b"e" * 192 * 300])
def test_own_files_by_both_ways(payload):
    media = jpeg.encode(payload)
    for fast in (True, False):
        got, head = jpeg.decode(media, fast=fast)
        assert jpeg.payload_of(got, head) == payload
    assert all((c[..., 1:] != 0).all() for c in got)


def test_runs_of_ended_bands_and_pieces(monkeypatch):
    """As for very long texts: several runs, and values coded in pieces."""
    payload = bytes(np.random.default_rng(4).integers(32, 127, 192 * 77, np.uint8))
    one = jpeg.encode(payload)
    monkeypatch.setattr(jpeg, "RUN", 9)
    monkeypatch.setattr(jpeg, "PIECE", 50)
    media = jpeg.encode(payload)
    assert media != one
    for fast in (True, False):
        assert jpeg.payload_of(*jpeg.decode(media, fast=fast)) == payload


def test_files_side_by_side(monkeypatch):
    """Files of one group are written and read in as many steps as one file, and each is what it is alone."""
    rng = np.random.default_rng(9)
    payloads = [bytes(rng.integers(lowest, 127, 192 * n, np.uint8)) for n, lowest in ((1, 32), (300, 97), (7, 0), (2, 32), (513, 60))] + [b" " * 192, bytes(192 * 3)]
    monkeypatch.setattr(jpeg, "RUN", 200)
    alone = [jpeg.encode(p) for p in payloads]
    assert jpeg.encode_all(payloads) == alone
    steps, values = [], jpeg._values
    monkeypatch.setattr(jpeg, "_values", lambda *args: steps.append(1) or values(*args))
    read = jpeg.decode_all(alone)
    assert len(steps) == 7  # scans of values, not scans times files
    for payload, media, (got, head) in zip(payloads, alone, read, strict=True):
        want, fields = jpeg.decode(media, fast=False)
        assert all(a.shape == b.shape and (a == b).all() for a, b in zip(got, want, strict=True)) and str(head) == str(fields)
        assert jpeg.payload_of(got, head) == payload


def test_short_scan_doesnt_run_into_the_next_file():
    files = [jpeg.encode(bytes(np.random.default_rng(k).integers(32, 127, 192 * 9, np.uint8))) for k in range(2)]
    data = marks_of(files[0], 0xDA)[1][1]
    files[0] = files[0].replace(data, data[:-12])
    with pytest.raises(ValueError, match="too short"):
        jpeg.decode_all(files)
