"""Media columns as progressive JPEG: payloads in coefficients, tensors out.

``encode_media`` stores a payload losslessly as a progressive JPEG file with
4:2:0 chroma. The format's unit is the quantised coefficient: each payload
byte, as a signed 8-bit number, is one coefficient (quantisation tables are
all ones), 64 bytes a block in zigzag order, luma blocks first, then the two
chroma planes. (Samples would not do: an 8-bit JPEG does not give samples back
exactly.) The payload's length stands in a comment segment. The coefficients
are written in seven scans, by spectral selection (DC, and luma AC 1-5 and
6-63) and successive approximation (DC and luma AC 1-5: all but the last bit
first, then the last bit), with restart markers.

``decode_media`` reads any such file back: it accumulates the scans into
coefficient arrays (DC and AC, first and refining, interleaved or not, with
end-of-band runs), takes the payload from them, inverse-transforms all blocks
in numpy with exact integer arithmetic, upsamples chroma by repetition and
converts to a full-resolution RGB tensor. Entropy decoding walks all restart
intervals of a batch of files in step, so the work per symbol is vectorised.

Defined cases: a null or empty payload is 64 zero bytes once padded; equal
payloads give equal files, tensors and features; every row gives a row; extra
columns are ignored by the encoder and kept by the decoder. A null or broken
file gives null results and the parser's message in ``error``. Work is
done about ``PIECE`` or ``FILES`` bytes at a time, a longer payload alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, read_table

#: Bytes worked on at a time: encoding likes the cache, decoding in step likes many intervals.
PIECE, FILES = 300_000, 5_000_000
RESTART = 8
#: Fixed values of the format: the zigzag order of an 8x8 block.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8)))
#: Scans: components, first and last coefficient, high and low bit.
SCANS = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0), ((0,), 6, 63, 0, 0), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 5, 1, 0)]
SAMPLING = [(2, 2), (1, 1), (1, 1)]


# ---- Huffman tables -------------------------------------------------------


def table_bytes(lengths: dict[int, int]) -> bytes:
    """BITS and HUFFVAL of a table with the given code lengths."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17)) + bytes(order)


DC_TABLE = table_bytes({s: 4 for s in range(12)})
AC_TABLE = table_bytes({**{s: 10 for s in range(256)}, 6: 2, 7: 2, 0: 4, 5: 4})


@lru_cache(maxsize=64)
def codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of each symbol."""
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    value, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            code[table[at]], length[table[at]] = value, n
            value += 1
            at += 1
        value <<= 1
    return code, length


@lru_cache(maxsize=64)
def lookup(table: bytes) -> np.ndarray:
    """For 16 bits ahead: length * 256 + symbol; 0 where no code fits."""
    out = np.zeros(65536, np.int32)
    code, length = codes(table)
    for s in np.flatnonzero(length).tolist():
        n = int(length[s])
        a = int(code[s]) << (16 - n)
        out[a : a + (1 << (16 - n))] = n * 256 + s
    return out


# ---- Geometry -------------------------------------------------------------


class Plane:
    """Where a component's blocks lie: ``base`` + row * ``wide`` + column in the image's blocks."""

    def __init__(self, base: int, h: int, v: int, wide: int, high: int, real_wide: int, real_high: int):
        self.base, self.h, self.v, self.wide, self.high, self.real_wide, self.real_high = base, h, v, wide, high, real_wide, real_high


@lru_cache(maxsize=512)
def planes(width: int, height: int, sampling: tuple[tuple[int, int], ...]) -> tuple[list[Plane], int]:
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
    out, base = [], 0
    for h, v in sampling:
        out.append(Plane(base, h, v, mw * h, mh * v, -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)))
        base += mw * h * mh * v
    return out, base


@lru_cache(maxsize=512)
def scan_order(width: int, height: int, sampling: tuple[tuple[int, int], ...], parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in coding order, the scan component of each, and blocks an MCU."""
    where, _ = planes(width, height, sampling)
    if len(parts) == 1:
        p = where[parts[0]]
        order = p.base + (np.arange(p.real_high)[:, None] * p.wide + np.arange(p.real_wide)).ravel()
        return order, np.zeros(len(order), np.int64), 1
    mw, mh = where[0].wide // where[0].h, where[0].high // where[0].v
    columns, comp = [], []
    for k, c in enumerate(parts):
        p = where[c]
        for y in range(p.v):
            for x in range(p.h):
                columns.append(p.base + ((np.arange(mh) * p.v + y)[:, None] * p.wide + np.arange(mw) * p.h + x).ravel())
                comp.append(k)
    order = np.stack(columns, axis=1).ravel()
    return order, np.tile(np.array(comp), mw * mh), len(comp)


def shape_for(n_blocks: int) -> tuple[int, int]:
    """Width and height in pixels of an image with room for so many blocks."""
    mcus = -(-n_blocks // 6)
    high = -(-mcus // 64) if mcus <= 64 * 4095 else -(-mcus // 4095)
    return 16 * -(-mcus // high), 16 * high


# ---- Encoding -------------------------------------------------------------


def size_of(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return SIZES[np.abs(v)]


SIZES = np.array([int(i).bit_length() for i in range(4096)], np.int64)


class Bits:
    """Bit strings given as (interval, value, length) in order, packed per interval."""

    def __init__(self, interval: np.ndarray, value: np.ndarray, length: np.ndarray, n: int):
        total = np.bincount(interval, weights=length, minlength=n).astype(np.int64)
        self.bytes = -(-total // 8)
        start = np.concatenate([[0], np.cumsum(self.bytes)])
        ends = np.cumsum(length)
        first = np.searchsorted(interval, np.arange(n))
        before = np.concatenate([[0], ends])[first]
        at = ends - length - before[interval] + 8 * start[:-1][interval]
        words = np.zeros(int(start[-1]) // 4 + 3, np.uint64)
        some = length > 0
        at, value, length = at[some], value[some].astype(np.uint64), length[some]
        word, off = at >> 5, at & 31
        both = value << (64 - off - length).astype(np.uint64)
        if len(word):
            cut = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            words[word[cut]] += np.add.reduceat(both >> np.uint64(32), cut)
            words[word[cut] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), cut)
        flat = words.astype(">u4").view(np.uint8)[: int(start[-1])].copy()
        pad = 8 * self.bytes - total
        last = start[1:][pad > 0] - 1
        flat[last] |= ((1 << pad[pad > 0]) - 1).astype(np.uint8)
        self.flat, self.start = flat, start

    def piece(self, a: int, b: int) -> bytes:
        """Intervals a..b-1 with byte stuffing and restart markers between them."""
        if b - a == 1:
            return self.flat[self.start[a] : self.start[b]].tobytes().replace(b"\xff", b"\xff\x00")
        raw, at = self.flat[self.start[a] : self.start[b]].tobytes(), (self.start[a : b + 1] - self.start[a]).tolist()
        out = []
        for k in range(b - a):
            out.append(raw[at[k] : at[k + 1]].replace(b"\xff", b"\xff\x00"))
            if k + 1 < b - a:
                out.append(bytes((0xFF, 0xD0 + k % 8)))
        return b"".join(out)


def dc_first(coef: np.ndarray, comp: np.ndarray, interval: np.ndarray, low: int, n: int) -> Bits:
    dc = coef[:, 0].astype(np.int64) >> low
    diff = dc.copy()
    for c in range(int(comp.max(initial=0)) + 1):
        mine = np.flatnonzero(comp == c)
        same = interval[mine[1:]] == interval[mine[:-1]]
        diff[mine[1:][same]] -= dc[mine[:-1][same]]
    size = size_of(diff)
    code, length = codes(DC_TABLE)
    extra = np.where(diff >= 0, diff, diff + (1 << size) - 1).astype(np.uint64)
    return Bits(interval, (code[size] << size.astype(np.uint64)) | extra, length[size] + size, n)


def dc_refine(coef: np.ndarray, interval: np.ndarray, low: int, n: int) -> Bits:
    return Bits(interval, (coef[:, 0].astype(np.int64) >> low & 1).astype(np.uint64), np.ones(len(coef), np.int64), n)


@lru_cache(maxsize=1)
def direct() -> tuple[np.ndarray, np.ndarray]:
    """Code with sign and size bits, and its length, of a coefficient -128..127 that follows no zeros."""
    v = np.arange(256).astype(np.uint8).view(np.int8).astype(np.int64)
    size = size_of(v)
    code, length = codes(AC_TABLE)
    return (code[size] << size.astype(np.uint64)) | np.where(v >= 0, v, v + (1 << size) - 1).astype(np.uint64), length[size] + size


def ac_first(coef: np.ndarray, interval: np.ndarray, ss: int, se: int, low: int, n: int) -> Bits:
    band = coef[:, ss : se + 1]
    if low:
        band = (np.sign(band) * (np.abs(band.astype(np.int16)) >> low)).astype(np.int8)
    width = se - ss + 1
    flat = np.ascontiguousarray(band).ravel()
    at = np.flatnonzero(flat)
    v = flat[at].view(np.uint8)
    ready, bits_of = direct()
    value, bits = ready[v], bits_of[v]
    blk = at // width
    gap = np.diff(at, prepend=-1) - 1
    first = np.ones(len(at), dtype=bool)
    first[1:] = blk[1:] != blk[:-1]
    gap[first] = at[first] - blk[first] * width
    code, length = codes(AC_TABLE)
    late = np.flatnonzero(gap)
    if len(late):
        run, w = gap[late], v[late].view(np.int8).astype(np.int64)
        size = size_of(w)
        symbol = (run & 15) << 4 | size
        value[late] = (code[symbol] << size.astype(np.uint64)) | np.where(w >= 0, w, w + (1 << size) - 1).astype(np.uint64)
        bits[late] = length[symbol] + size
    last = np.full(len(coef), -1)
    last[blk] = at - blk * width
    eob = np.flatnonzero(last < width - 1)
    if not len(eob) and not (gap > 15).any():
        return Bits(interval[blk], value, bits, n)
    key = (blk * 64 + at - blk * width) * 4 + 3
    zrl = np.repeat(key - 3, gap >> 4)
    keys = np.concatenate([key, zrl, (eob * 64 + 63) * 4 + 3])
    values = np.concatenate([value, np.full(len(zrl), code[0xF0]), np.full(len(eob), code[0])])
    lengths = np.concatenate([bits, np.full(len(zrl), length[0xF0]), np.full(len(eob), length[0])])
    order = np.argsort(keys, kind="stable")
    return Bits(interval[keys[order] // 256], values[order], lengths[order], n)


def ac_refine(coef: np.ndarray, interval: np.ndarray, ss: int, se: int, low: int, n: int) -> Bits:
    band = np.abs(coef[:, ss : se + 1].astype(np.int64)) >> low
    negative = coef[:, ss : se + 1] < 0
    width = se - ss + 1
    old, new, zero = band > 1, band == 1, band == 0
    # terminators: newly nonzero coefficients, and each 16th zero since the last one that a newly nonzero one follows
    zeros = np.cumsum(zero, axis=1)
    at_new = np.where(new, zeros, 0)
    since = zeros - np.maximum.accumulate(np.concatenate([np.zeros((len(band), 1), np.int64), at_new[:, :-1]], axis=1), axis=1)
    later = np.cumsum(new[:, ::-1], axis=1)[:, ::-1] > 0
    ends = new | (zero & (since % 16 == 0) & later)
    group = np.cumsum(ends, axis=1) - ends
    code, length = codes(AC_TABLE)
    nb, nk = np.nonzero(new)
    symbol = ((since[nb, nk] & 15) << 4) | 1
    zb, zk = np.nonzero(ends & ~new)
    ob, ok = np.nonzero(old)
    last = np.where(new.any(axis=1), width - 1 - np.argmax(new[:, ::-1], axis=1), -1)
    eob = np.flatnonzero(last < width - 1)
    # within a block: group by group, first the terminator's code, then the correction bits
    place = lambda b, g, k: (b * 66 + g) * 66 + k
    keys = np.concatenate([place(nb, group[nb, nk], 0), place(zb, group[zb, zk], 0), place(ob, group[ob, ok], ok + 1), place(eob, ends.sum(axis=1)[eob], 0)])
    values = np.concatenate([(code[symbol] << np.uint64(1)) | (~negative[nb, nk]).astype(np.uint64), np.full(len(zb), code[0xF0]), (band[ob, ok] & 1).astype(np.uint64), np.full(len(eob), code[0])])
    lengths = np.concatenate([length[symbol] + 1, np.full(len(zb), length[0xF0]), np.ones(len(ob), np.int64), np.full(len(eob), length[0])])
    order = np.argsort(keys, kind="stable")
    return Bits(interval[keys[order] // (66 * 66)], values[order], lengths[order], n)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def head(width: int, height: int, n_bytes: int) -> bytes:
    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + b"".join(bytes((c + 1, h << 4 | v, 0)) for c, (h, v) in enumerate(SAMPLING))
    return b"".join([
        b"\xff\xd8", _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"), _segment(0xFE, b"payload %d" % n_bytes),
        _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC2, frame), _segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE), _segment(0xDD, RESTART.to_bytes(2, "big")),
    ])


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """One file a payload; each payload is padded with zero bytes to a positive multiple of 64."""
    n_blocks = [max(1, -(-len(p) // 64)) for p in payloads]
    shapes = [shape_for(n) for n in n_blocks]
    counts = [planes(w, h, tuple(SAMPLING))[1] for w, h in shapes]
    base = np.concatenate([[0], np.cumsum(counts)])
    coef = np.zeros((int(base[-1]), 64), np.int8)
    flat = coef.reshape(-1)
    for b, p in zip(base.tolist(), payloads):
        flat[64 * b : 64 * b + len(p)] = np.frombuffer(p, np.int8)
    files = [[head(w, h, 64 * n)] for (w, h), n in zip(shapes, n_blocks)]
    for parts, ss, se, high, low in SCANS:
        orders, comps, intervals, bounds = [], [], [], [0]
        for b, (w, h) in zip(base.tolist(), shapes):
            order, comp, mcu = scan_order(w, h, tuple(SAMPLING), parts)
            orders.append(order + b)
            comps.append(comp)
            intervals.append(np.arange(len(order)) // (mcu * RESTART) + bounds[-1])
            bounds.append(int(intervals[-1][-1]) + 1)
        order, comp, interval = np.concatenate(orders), np.concatenate(comps), np.concatenate(intervals)
        scanned = coef[order]
        n = bounds[-1]
        if ss == 0:
            bits = dc_refine(scanned, interval, low, n) if high else dc_first(scanned, comp, interval, low, n)
        else:
            bits = (ac_refine if high else ac_first)(scanned, interval, ss, se, low, n)
        start = _segment(0xDA, bytes((len(parts),)) + b"".join(bytes((c + 1, 0)) for c in parts) + bytes((ss, se, high << 4 | low)))
        for i, f in enumerate(files):
            f.append(start)
            f.append(bits.piece(bounds[i], bounds[i + 1]))
    return [b"".join(f) + b"\xff\xd9" for f in files]


# ---- Decoding -------------------------------------------------------------

MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


class Image:
    """The parsed segments of a file: frame, tables and, for each scan, its restart intervals."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG file")
        self.payload: int | None = None
        self.quant: dict[int, np.ndarray] = {}
        self.scans: list[tuple] = []
        tables: dict[int, bytes] = {}
        restart, at = 0, 2
        while at + 4 <= len(data) and data[at + 1] != 0xD9:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker, end = data[at + 1], at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : end]
            if marker == 0xFE and body.startswith(b"payload "):
                self.payload = int(body[8:])
            elif marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                    body = body[1 + 64 * wide :]
            elif marker == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
                self.ids = [p[0] for p in parts]
                self.sampling = tuple((p[1] >> 4, p[1] & 15) for p in parts)
                self.quant_of = [p[2] for p in parts]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                n = body[0]
                parts = tuple(self.ids.index(body[1 + 2 * i]) for i in range(n))
                use = [body[2 + 2 * i] for i in range(n)]
                ss, se, bits = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
                found = MARKER.search(data, end)
                stop = found.start() if found else len(data)
                pieces = [p.replace(b"\xff\x00", b"\xff") for p in RESTARTS.split(data[end:stop])]
                known = tuple(tables.get(u >> 4 if ss == 0 else 16 | u & 15, b"") for u in use)
                self.scans.append((parts, ss, se, bits >> 4, bits & 15, known, restart, pieces))
                end = stop
            elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("not a progressive file")
            at = end
        if data[at : at + 2] != b"\xff\xd9":
            raise ValueError("the file ends early")


class Intervals:
    """Restart intervals of many scans of one kind, decoded in step."""

    def __init__(self, pieces: list[bytes], blocks: list[np.ndarray], comps: list[np.ndarray]):
        sizes = np.array([len(p) + 8 for p in pieces])
        self.pos = 8 * (np.cumsum(sizes) - sizes)
        flat = np.frombuffer(b"".join(p + b"\x00" * 8 for p in pieces), np.uint8)
        self.flat = flat
        self.words = np.ndarray(len(flat) - 7, ">u8", flat, strides=(1,)).astype(np.uint64)
        self.end = self.pos + 8 * (sizes - 8)
        self.count = np.array([len(b) for b in blocks])
        self.first = np.cumsum(self.count) - self.count
        self.block, self.comp = np.concatenate(blocks), np.concatenate(comps)

    def ahead(self, who: np.ndarray) -> np.ndarray:
        pos = self.pos[who]
        at = pos >> 3
        if len(at) and int(at.max()) >= len(self.words):
            raise ValueError("a scan ends early")
        return self.words[at] << (pos & 7).astype(np.uint64)

    def take(self, who: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n bits (up to 16 each)."""
        got = np.where(n > 0, self.ahead(who) >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)
        self.pos[who] += n
        return got

    def symbol(self, who: np.ndarray, table: np.ndarray) -> np.ndarray:
        hit = table[(self.ahead(who) >> np.uint64(48)).astype(np.int64)]
        if not hit.all():
            raise ValueError("no such code")
        self.pos[who] += hit >> 8
        return (hit & 255).astype(np.int64)

    def checked(self) -> None:
        if (self.pos > self.end).any():
            raise ValueError("a scan ends early")


def extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)


def read_dc(coef: np.ndarray, at: Intervals, tables: list[np.ndarray], high: int, low: int) -> None:
    before = np.zeros((len(at.count), max(1, len(tables))), np.int64)
    for k in range(int(at.count.max(initial=0))):
        who = np.flatnonzero(at.count > k)
        where = at.first[who] + k
        block, comp = at.block[where], at.comp[where]
        if high:
            coef[block, 0] |= (at.take(who, np.ones(len(who), np.int64)) << low).astype(coef.dtype)
            continue
        size = np.zeros(len(who), np.int64)
        for c, table in enumerate(tables):
            mine = comp == c
            if mine.any():
                size[mine] = at.symbol(who[mine], table)
        before[who, comp] += extend(at.take(who, size), size)
        coef[block, 0] = before[who, comp] << low


@lru_cache(maxsize=64)
def whole(table: bytes) -> np.ndarray:
    """For 16 bits ahead: value * 65536 + run * 256 + kind * 64 + bits used.

    kind 0: a value after ``run`` zeros; 1: zeros only; 2: anything that the
    slow path has to read (an end of band, or more than 16 bits).
    """
    hit = lookup(table).astype(np.int64)
    ahead = np.arange(65536)
    length, symbol = hit >> 8, hit & 255
    run, size = symbol >> 4, symbol & 15
    used = length + size
    extra = (ahead >> np.maximum(16 - used, 0)) & ((1 << size) - 1)
    out = (extend(extra, size) << 16) | run << 8 | used
    out = np.where(size == 0, (run << 8) | 64 | length, out)
    return np.where((length == 0) | (used > 16) | ((size == 0) & (run < 15)), 128, out)


def read_ac_first(coef: np.ndarray, at: Intervals, table: bytes, ss: int, se: int, low: int) -> None:
    fast, slow = whole(table), lookup(table)
    flat = coef.reshape(-1)
    ids = np.flatnonzero(at.count > 0)
    pos, blk, stop = at.pos[ids], at.first[ids], (at.first + at.count)[ids]
    base, k = at.block[blk] * 64, np.full(len(ids), ss)
    limit = len(at.words)
    while len(ids):
        byte = pos >> 3
        if int(byte.max()) >= limit:
            raise ValueError("a scan ends early")
        ahead = at.words[byte] << (pos & 7).astype(np.uint64)
        hit = fast[(ahead >> np.uint64(48)).astype(np.int64)]
        pos = pos + (hit & 63)
        k = k + (hit >> 8 & 255)
        odd = (hit & 192) > 0
        ended = None
        if odd.any():
            value = hit >> 16
            rare = np.flatnonzero(hit & 128)
            ended = np.zeros(len(ids), np.int64)
            place = ~odd
            if len(rare):
                w = ahead[rare]
                code = slow[(w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                if not code.all():
                    raise ValueError("no such code")
                length, run, size = code >> 8, code >> 4 & 15, code & 15
                bits = np.where(size > 0, size, run)
                extra = np.where(bits > 0, (w << length.astype(np.uint64)) >> (64 - np.maximum(bits, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)
                pos[rare] += length + bits
                valued = size > 0
                k[rare[valued]] = k[rare[valued]] - (hit[rare[valued]] >> 8 & 255) + run[valued]
                value[rare[valued]] = extend(extra[valued], size[valued])
                place[rare[valued]] = True
                ended[rare[~valued]] = (1 << run[~valued]) + extra[~valued]
            if (k[place] > se).any():
                raise ValueError("a coefficient lies outside its band")
            flat[(base + k)[place]] = value[place] << low
        else:
            if int(k.max()) > se:
                raise ValueError("a coefficient lies outside its band")
            flat[base + k] = hit >> 16 << low
        k = k + 1
        new = k > se
        if ended is not None:
            new |= ended > 0
        if new.any():
            step = np.ones(len(ids), np.int64) if ended is None else np.maximum(ended, 1)
            blk = np.where(new, blk + step, blk)
            k[new] = ss
            live = blk < stop
            if not live.all():
                at.pos[ids[~live]] = pos[~live]
                ids, pos, blk, stop, k = ids[live], pos[live], blk[live], stop[live], k[live]
            base = at.block[blk] * 64


def read_ac_refine(coef: np.ndarray, at: Intervals, table: np.ndarray, ss: int, se: int, low: int) -> None:
    n = len(at.count)
    blk, k, runs = np.zeros(n, np.int64), np.full(n, ss), np.zeros(n, np.int64)
    column = np.arange(ss, se + 1)
    one = 1 << low
    who = np.flatnonzero(at.count > 0)
    while len(who):
        rest = runs[who] > 0
        target = np.full(len(who), 64)  # how many zeros are passed, the last one ending the step; 64: to the band's end
        value = np.zeros(len(who), np.int64)
        ask = who[~rest]
        if len(ask):
            symbol = at.symbol(ask, table)
            run, size = symbol >> 4, symbol & 15
            if (size > 1).any():
                raise ValueError("a refining scan sets more than one bit")
            new = size == 1
            sign = at.take(ask, np.where(new, 1, np.where(run < 15, run, 0)))
            ended = ~new & (run < 15)
            runs[ask[ended]] = (1 << run[ended]) + sign[ended]
            goes = np.flatnonzero(~rest)
            target[goes[~ended]] = run[~ended] + 1
            value[goes[new]] = np.where(sign[new] == 1, one, -one)
        block = at.block[at.first[who] + blk[who]]
        part = coef[block, ss : se + 1].astype(np.int64)
        open_ = column[None, :] >= k[who][:, None]
        zeros = np.cumsum((part == 0) & open_, axis=1)
        reached = zeros >= target[:, None]
        stop = np.where(reached.any(axis=1), np.argmax(reached, axis=1), se - ss + 1)
        fix = (part != 0) & open_ & (np.arange(se - ss + 1)[None, :] < stop[:, None])
        r, c = np.nonzero(fix)
        many = fix.sum(axis=1)
        bit = at.pos[who][r] + (np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many))
        if len(bit) and int(bit.max()) >> 3 >= len(at.flat):
            raise ValueError("a scan ends early")
        on = (at.flat[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
        at.pos[who] += many
        r, c = r[on], c[on]
        v = part[r, c]
        coef[block[r], ss + c] = np.where(np.abs(v) & one, v, v + np.where(v > 0, one, -one))
        set_ = (value != 0) & (stop <= se - ss)
        coef[block[set_], ss + stop[set_]] = value[set_]
        k[who] = ss + stop + 1
        done = runs[who] > 0
        runs[who[done]] -= 1
        done |= k[who] > se
        blk[who[done]] += 1
        k[who[done]] = ss
        who = who[blk[who] < at.count[who]]


def coefficients(images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of all images, blocks in zigzag order, and where each image's blocks begin."""
    counts = [planes(i.width, i.height, i.sampling)[1] for i in images]
    base = np.concatenate([[0], np.cumsum(counts)])
    coef = np.zeros((int(base[-1]), 64), np.int16)
    for j in range(max((len(i.scans) for i in images), default=0)):
        alike: dict[tuple, list[int]] = defaultdict(list)
        for i, image in enumerate(images):
            if j < len(image.scans):
                parts, ss, se, high, low, known, _, _ = image.scans[j]
                alike[(len(parts), ss, se, high, low, known)].append(i)
        for (_, ss, se, high, low, known), members in alike.items():
            pieces: list[bytes] = []
            blocks: list[np.ndarray] = []
            comps: list[np.ndarray] = []
            for i in members:
                image = images[i]
                parts, restart, own = image.scans[j][0], image.scans[j][6], image.scans[j][7]
                order, comp, mcu = scan_order(image.width, image.height, image.sampling, parts)
                step = restart * mcu or max(1, len(order))
                cuts = range(0, len(order), step)
                if len(cuts) != len(own):
                    raise ValueError("restart intervals are missing")
                pieces += own
                blocks += [order[c : c + step] + base[i] for c in cuts]
                comps += [comp[c : c + step] for c in cuts]
            at = Intervals(pieces, blocks, comps)
            if ss == 0:
                read_dc(coef, at, [lookup(t) for t in known] if not high else [], high, low)
            elif high:
                read_ac_refine(coef, at, lookup(known[0]), ss, se, low)
            else:
                read_ac_first(coef, at, known[0], ss, se, low)
            at.checked()
    return coef, base


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """Row k: what zigzag coefficient k adds to the 64 samples, times 2**16, as whole numbers.

    Sums of products with coefficients stay below 2**53, so double arithmetic
    is exact whatever the order of summation.
    """
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)  # [row u * 8 + column v]
    return np.rint(both * 65536)[ZIGZAG]


def samples(images: list[Image], coef: np.ndarray, base: np.ndarray) -> np.ndarray:
    """All blocks dequantised and inverse-transformed: 64 samples a block, 8 bits each."""
    quant = np.ones((len(coef), 1), np.int64)
    for i, image in enumerate(images):
        if any((q != 1).any() for q in image.quant.values()):
            if quant.shape[1] == 1:
                quant = np.ones((len(coef), 64), np.int64)
            for p, q in zip(planes(image.width, image.height, image.sampling)[0], image.quant_of):
                quant[base[i] + p.base : base[i] + p.base + p.wide * p.high] = image.quant[q]
    out = (coef if quant.shape[1] == 1 else coef * quant).astype(np.float64) @ basis()
    out *= 1 / 65536
    out += 128.5
    np.floor(out, out=out)
    np.clip(out, 0, 255, out=out)
    return out.astype(np.uint8)


def tensor(image: Image, sample: np.ndarray) -> np.ndarray:
    """Height x width x 3 samples, 8 bits each, from the samples of an image's blocks."""
    where, _ = planes(image.width, image.height, image.sampling)
    hm, vm = max(p.h for p in where), max(p.v for p in where)
    full = []
    for c, p in enumerate(where):
        part = sample[p.base : p.base + p.wide * p.high].reshape(p.high, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * p.high, 8 * p.wide)
        if p.v < vm:
            part = np.repeat(part, vm // p.v, axis=0)
        if p.h < hm:
            part = np.repeat(part, hm // p.h, axis=1)
        full.append(part[: image.height, : image.width].astype(np.int32))
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = (full[0] << 16) + 32768, full[1] - 128, full[2] - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    for c, v in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        v >>= 16
        np.clip(v, 0, 255, out=v)
        out[:, :, c] = v
    return out


def payload_of(image: Image, coef: np.ndarray) -> bytes | None:
    if image.payload is None:
        return None
    return coef.astype(np.int8).tobytes()[: image.payload]


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean of each channel in 1/1000, checksum of the tensor."""
    h, w, _ = rgb.shape
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (h * w)
    return f"{w}x{h}:{means[0]}:{means[1]}:{means[2]}:{zlib.crc32(rgb.tobytes()):08x}"


def decode_batch(files: list[bytes]) -> list[tuple[Image, bytes | None, np.ndarray]]:
    images = [Image(f) for f in files]
    coef, base = coefficients(images)
    sample = samples(images, coef, base)
    out = []
    for i, image in enumerate(images):
        own = slice(base[i], base[i + 1])
        out.append((image, payload_of(image, coef[own]), tensor(image, sample[own])))
    return out


# ---- Columns --------------------------------------------------------------


def encode_media(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each row's text as UTF-8, stored as a progressive JPEG file."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for a, b in by_bytes((len(p) + 512 for p in payloads), PIECE):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(p) for p in payloads[a:b]], pa.int64()), pa.array(encode_batch(payloads[a:b]), pa.binary())], names=[key, "n_bytes", "media"]
                )

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame, column: str = "media", keep: bool = True) -> DataFrame:
    """Adds width, height, rgb (the tensor's bytes), payload, feature and error.

    With ``keep`` False, rgb and payload become their digests (payload_sha256,
    tail_crc32, payload_bytes) in the same pass and are not passed on. Input
    columns of these names are replaced.
    """
    names = ["width", "height", "feature", "error", *(["rgb", "payload"] if keep else ["payload_bytes", "payload_sha256", "tail_crc32"])]
    media = media.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)

    def one(files: list[bytes | None]) -> list[tuple]:
        good = [i for i, f in enumerate(files) if f is not None]
        out: list[tuple] = [(None, None)] * len(files)
        try:
            for i, got in zip(good, decode_batch([files[i] for i in good])):
                out[i] = (got, None)
        except (ValueError, IndexError, KeyError, AttributeError):
            for i in good:  # a broken file is found by itself
                try:
                    out[i] = (decode_batch([files[i]])[0], None)
                except (ValueError, IndexError, KeyError, AttributeError) as e:
                    out[i] = (None, str(e) or type(e).__name__)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(batch.schema.get_field_index(column)).to_pylist()
            for a, b in by_bytes((len(f or b"") for f in files), FILES):
                got = one(files[a:b])
                image = [g[0] if g else None for g, _ in got]
                payload = [g[1] if g else None for g, _ in got]
                rgb = [g[2] if g else None for g, _ in got]
                columns = [
                    pa.array([i and i.width for i in image], pa.int32()),
                    pa.array([i and i.height for i in image], pa.int32()),
                    pa.array([None if t is None else feature_of(t) for t in rgb], pa.string()),
                    pa.array([e for _, e in got], pa.string()),
                ]
                if keep:
                    columns += [pa.array([None if t is None else t.tobytes() for t in rgb], pa.binary()), pa.array(payload, pa.binary())]
                else:
                    columns += [
                        pa.array([None if p is None else len(p) for p in payload], pa.int64()),
                        pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in payload], pa.string()),
                        pa.array([None if p is None else zlib.crc32(p[-64:]) for p in payload], pa.int64()),
                    ]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *columns], names=[*batch.schema.names, *names])

    extra = "width int, height int, feature string, error string, " + ("rgb binary, payload binary" if keep else "payload_bytes long, payload_sha256 string, tail_crc32 long")
    return media.mapInArrow(run, f"{fields}, {extra}")


def op1_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = encode_media(read_table(spark, sf_dir, "documents"))
    read = decode_media(stored, keep=False)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")
