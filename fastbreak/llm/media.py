"""Media columns: progressive JPEG, written, read and turned into RGB tensors with numpy.

Reading: the scans of a progressive file (spectral selection and successive approximation) are accumulated into
coefficient arrays. The restart intervals of all files of a slice are decoded side by side: one numpy step decodes
the next Huffman symbol of every interval. Then come the inverse transform (integer basis, so exact and the same in
any batch), chroma upsampling to full resolution and the conversion to RGB.

Writing stores a payload of bytes losslessly, one byte a quantised coefficient (its value plus 2), in 4:2:0 files
with all quantisers 1. Each row is worked on alone: no shuffle, memory bounded by the slice or the longest text.

Defined cases: a null or empty text is a payload of 192 spaces; equal texts give equal files; other columns pass
through, and an existing column named as the output is replaced; a null, broken or non-progressive file decodes to
null.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spread, table, texts

#: Bytes of a unit of the payload: three blocks of 64 coefficients.
UNIT = 192
#: Blocks (in the DC scan: MCUs) between two restart markers of the files written here.
RESTART = 8
#: Stored coefficient = byte + OFFSET, so none first becomes non-zero in a refinement scan.
OFFSET = 2
#: Payload bytes that are worked on at once.
SLICE_BYTES = 2_000_000
#: Bands of AC coefficients, each a scan of its own for each component.
BANDS = ((1, 9), (10, 63))


@lru_cache
def zigzag() -> np.ndarray:
    """Natural position of each coefficient in zigzag order: along anti-diagonals, turning at each."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@lru_cache
def basis() -> np.ndarray:
    """[zigzag coefficient, pixel], scaled by 2**16 and rounded: sums stay exact in float64."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()] * 65536)


# ---------------------------------------------------------------- Huffman tables


def canonical(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each of 256 symbols."""
    code, k = 0, 0
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[k]], lengths[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return codes, lengths


@lru_cache(maxsize=64)
def lookup(spec: bytes) -> np.ndarray:
    """For each 16 bits ahead: symbol + 256 * code length."""
    counts, symbols = list(spec[:16]), list(spec[16:])
    codes, lengths = canonical(counts, symbols)
    out = np.full(65536, 256 * 16, np.int32)
    for s in symbols:
        first = int(codes[s]) << (16 - int(lengths[s]))
        out[first : first + (1 << (16 - int(lengths[s])))] = s + 256 * int(lengths[s])
    return out


def _spec(groups: dict[int, list[int]]) -> bytes:
    return bytes(len(groups.get(i, [])) for i in range(1, 17)) + bytes(s for i in sorted(groups) for s in groups[i])


#: DC: sizes 0-11 with 4 bits. AC: end of block and run 0 with sizes 1-8 take 4 bits, all others 10.
DC_SPEC = _spec({4: list(range(12))})
_SHORT = [0x00, *range(1, 9)]
AC_SPEC = _spec({4: _SHORT, 10: [16 * r + s for r in range(16) for s in range(11) if 16 * r + s not in _SHORT]})


# ---------------------------------------------------------------- writing


@lru_cache(maxsize=512)
def _orders(rows: int, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of Y, Cb, Cr in raster order, by their place in MCU order (four of Y, then Cb, Cr)."""
    at = np.arange(rows * cols * 6).reshape(rows, cols, 6)
    return at[:, :, :4].reshape(rows, cols, 2, 2).transpose(0, 2, 1, 3).reshape(-1), at[:, :, 4].reshape(-1), at[:, :, 5].reshape(-1)


def _grid(blocks: int) -> tuple[int, int]:
    mcus = -(-blocks // 6)
    cols = int(np.ceil(np.sqrt(mcus)))
    return -(-mcus // cols), cols


def _sizes(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, lengths: np.ndarray, segment: np.ndarray, n: int) -> list[bytes]:
    """Concatenate the bits of each segment's tokens (at most 25 bits each), padded with ones, FF bytes stuffed."""
    bits = np.bincount(segment, lengths, n).astype(np.int64)
    size = (bits + 7) // 8
    first = np.cumsum(size) - size
    ahead = np.cumsum(lengths) - lengths
    begin = np.cumsum(bits) - bits
    place = first[segment] * 8 + ahead - begin[segment]
    word, total = place >> 5, int(size.sum())
    window = values.astype(np.uint64) << (64 - lengths - (place & 31)).astype(np.uint64)
    out = np.zeros(total // 4 + 3, np.uint32)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
    if len(starts):
        whole = np.bitwise_or.reduceat(window >> np.uint64(32), starts)
        rest = np.bitwise_or.reduceat(window & np.uint64(0xFFFFFFFF), starts)
        out[word[starts]] = whole
        out[word[starts] + 1] |= rest.astype(np.uint32)
    flat = out.astype(">u4").view(np.uint8)[:total]
    some = size > 0
    flat[(first + size - 1)[some]] |= ((1 << (size * 8 - bits)[some]) - 1).astype(np.uint8)
    raw = flat.tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)]


def _segments(blocks_of: list[int], each: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each unit, and how many segments each file has, when every `each` units begin a new one."""
    counts = np.array(blocks_of)
    pieces = -(-counts // each)
    owner, at = spread(counts)
    return (np.cumsum(pieces) - pieces)[owner] + at // each, pieces


def _size_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _dc_first(v: np.ndarray, mcus: list[int]) -> tuple[list[bytes], np.ndarray]:
    segment, pieces = _segments(mcus, RESTART)
    dc = (v[:, 0] >> 1).reshape(-1, 6)
    fresh = np.r_[True, segment[1:] != segment[:-1]]
    before = np.empty_like(dc)
    before[:, 1:4] = dc[:, :3]
    before[1:, 0], before[1:, 4:] = dc[:-1, 3], dc[:-1, 4:]
    before[fresh, 0] = 0
    before[fresh, 4:] = 0
    diff = (dc - before).reshape(-1)
    size = _sizes(diff)
    codes, lengths = canonical(list(DC_SPEC[:16]), list(DC_SPEC[16:]))
    return _pack((codes[size] << size) | _size_bits(diff, size), lengths[size] + size, np.repeat(segment, 6), int(pieces.sum())), pieces


def _ac_first(v: np.ndarray, blocks: list[int]) -> tuple[list[bytes], np.ndarray]:
    """v: the band's coefficients, a row a block, divided by 2 towards zero."""
    segment, pieces = _segments(blocks, RESTART)
    width = v.shape[1]
    row, col = np.nonzero(v)
    before = np.r_[-1, col[:-1]]
    before[np.r_[True, row[1:] != row[:-1]][: len(row)]] = -1
    run = col - before[: len(col)] - 1
    x = v[row, col]
    size = _sizes(x)
    codes, lengths = canonical(list(AC_SPEC[:16]), list(AC_SPEC[16:]))
    symbol = (run & 15) * 16 + size
    tokens = [(row * 256 + col * 4 + 1, (codes[symbol] << size) | _size_bits(x, size), lengths[symbol] + size, row)]
    for k in range(3):  # runs of 16 and more zeros
        far = np.flatnonzero(run >= 16 * (k + 1))
        if len(far):
            tokens.append((row[far] * 256 + col[far] * 4, np.full(len(far), codes[0xF0]), np.full(len(far), lengths[0xF0]), row[far]))
    ends = np.flatnonzero(v[:, -1] == 0)
    if len(tokens) == 1:  # only ends of blocks come between: each moves what follows by one place
        ended = np.cumsum(v[:, -1] == 0)
        at = np.arange(len(row)) + np.r_[0, ended][row]
        last = np.cumsum(np.bincount(row, minlength=len(v)))[ends] + ended[ends] - 1
        value, length, of = (np.empty(len(row) + len(ends), np.int64) for _ in range(3))
        for out, main, more in ((value, tokens[0][1], codes[0]), (length, tokens[0][2], lengths[0]), (of, row, ends)):
            out[at], out[last] = main, more
    else:
        tokens.append((ends * 256 + width * 4, np.full(len(ends), codes[0]), np.full(len(ends), lengths[0]), ends))
        order, value, length, of = (np.concatenate(x) for x in zip(*tokens, strict=True))
        by = np.argsort(order, kind="stable")
        value, length, of = value[by], length[by], of[by]
    return _pack(value, length, segment[of], int(pieces.sum())), pieces


def _refine(bits: np.ndarray, there: np.ndarray, blocks: list[int], symbol: bool) -> tuple[list[bytes], np.ndarray]:
    """The low bits of coefficients that are already non-zero; with symbol, an end of block before each row's."""
    segment, pieces = _segments(blocks, RESTART)
    if symbol:
        codes, lengths = canonical(list(AC_SPEC[:16]), list(AC_SPEC[16:]))
        n = int(lengths[0])
        head = np.broadcast_to((codes[0] >> np.arange(n - 1, -1, -1)) & 1, (len(bits), n))
        bits, there = np.hstack([head, bits]), np.hstack([np.ones((len(bits), n), bool), there])
    count = np.bincount(segment, there.sum(axis=1), int(pieces.sum())).astype(np.int64)
    size = (count + 7) // 8
    first = np.cumsum(size) - size
    out = np.ones(int(size.sum()) * 8, np.uint8)
    owner, at = spread(count)
    out[first[owner] * 8 + at] = bits[there]
    raw = np.packbits(out).tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)], pieces


def _marker(code: int, body: bytes) -> bytes:
    return bytes((0xFF, code)) + (len(body) + 2).to_bytes(2, "big") + body


def _scan(components: tuple[int, ...], low: int, high: int, before: int, now: int, pieces: list[bytes]) -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c, 0)), low, high, 16 * before + now])
    parts = [_marker(0xDA, head), pieces[0]]
    for k, piece in enumerate(pieces[1:]):
        parts += [bytes((0xFF, 0xD0 + k % 8)), piece]
    return b"".join(parts)


def store(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files that hold the payloads, each a positive multiple of 64 bytes, in their coefficients."""
    grids = [_grid(len(p) // 64) for p in payloads]
    mcus = [r * c for r, c in grids]
    v = np.zeros((6 * sum(mcus), 64), np.int64)
    base = np.cumsum([0, *mcus]) * 6
    for p, b in zip(payloads, base.tolist(), strict=False):
        v[b : b + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int64) + OFFSET
    scans: list[tuple[tuple[int, ...], int, int, int, int, list[bytes], np.ndarray]] = [((1, 2, 3), 0, 0, 0, 1, *_dc_first(v, mcus))]
    orders = [_orders(r, c) for r, c in grids]
    raster = [np.concatenate([o[k] + b for o, b in zip(orders, base.tolist(), strict=False)]) for k in range(3)]
    blocks = [[(4 if k == 0 else 1) * m for m in mcus] for k in range(3)]
    for low, high in BANDS:
        for k in range(3):
            scans.append(((k + 1,), low, high, 0, 1, *_ac_first(v[raster[k], low : high + 1] >> 1, blocks[k])))
    low_bits = (v & 1).astype(np.uint8)
    scans.append(((1, 2, 3), 0, 0, 1, 0, *_refine(low_bits[:, 0].reshape(-1, 6), np.ones((len(v) // 6, 6), bool), mcus, False)))
    for k in range(3):
        scans.append(((k + 1,), 1, 63, 1, 0, *_refine(low_bits[raster[k], 1:], v[raster[k], 1:] != 0, blocks[k], True)))
    tables = _marker(0xC4, b"\x00" + DC_SPEC) + _marker(0xC4, b"\x10" + AC_SPEC) + _marker(0xDD, RESTART.to_bytes(2, "big"))
    frames = [b"\xff\xd8" + _marker(0xDB, b"\x00" + b"\x01" * 64) + _marker(0xC2, b"\x08" + (16 * r).to_bytes(2, "big") + (16 * c).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + tables for r, c in grids]
    parts = [[f] for f in frames]
    for components, low, high, before, now, pieces, counts in scans:
        ends = np.cumsum(counts).tolist()
        for part, end, n in zip(parts, ends, counts.tolist(), strict=True):
            part.append(_scan(components, low, high, before, now, pieces[end - n : end]))
    return [b"".join([*part, b"\xff\xd9"]) for part in parts]


# ---------------------------------------------------------------- reading


class Frame:
    """One file's headers and scans. blocks: the component's blocks across and down, whole MCUs."""

    def __init__(self, data: bytes) -> None:
        self.quantisers: dict[int, np.ndarray] = {}
        self.components: dict[int, dict] = {}
        self.scans: list[dict] = []
        tables: dict[int, bytes] = {}
        restart, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            code, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if code == 0xD9:
                break
            if code == 0xDA and not self.components:
                raise ValueError("no frame")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if code == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    self.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], f">u{wide}").astype(np.float64)
                    body = body[1 + 64 * wide :]
            elif code == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif code == 0xDD:
                restart = int.from_bytes(body, "big")
            elif code == 0xC2:
                self._size(body)
            elif code == 0xDA:
                at = self._scan(body, data, at, tables, restart)
            elif 0xC0 <= code <= 0xCF and code != 0xCC:
                raise ValueError("not progressive")
        if not self.components:
            raise ValueError("no frame")

    def _size(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        raw = [body[6 + 3 * k : 9 + 3 * k] for k in range(body[5])]
        self.h, self.v = max(x[1] >> 4 for x in raw), max(x[1] & 15 for x in raw)
        self.mcus = (-(-self.height // (8 * self.v)), -(-self.width // (8 * self.h)))
        first = 0
        for ident, sampling, q in raw:
            h, v = sampling >> 4, sampling & 15
            size = (self.mcus[0] * v, self.mcus[1] * h)
            real = (-(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8))
            self.components[ident] = {"h": h, "v": v, "q": q, "blocks": size, "real": real, "first": first}
            first += size[0] * size[1]
        self.total = first

    def _scan(self, body: bytes, data: bytes, at: int, tables: dict[int, bytes], restart: int) -> int:
        idents = [body[1 + 2 * k] for k in range(body[0])]
        tail = body[1 + 2 * body[0] :]
        m = _END.search(data, at)
        end = m.start() if m else len(data)
        pieces = [x.replace(b"\xff\x00", b"\xff") for x in _RST.split(data[at:end])]
        ac = tail[0] > 0
        specs = [tables.get((16 + (body[2 + 2 * k] & 15)) if ac else body[2 + 2 * k] >> 4, b"") for k in range(body[0])]
        order, which = self.order(tuple(idents))
        per = restart * (1 if len(idents) == 1 else len(which) // (self.mcus[0] * self.mcus[1])) if restart else len(order)
        before, now, low, high = tail[2] >> 4, tail[2] & 15, tail[0], tail[1]
        level = 1 + max((s["level"] for s in self.scans if set(s["idents"]) & set(idents) and s["low"] <= high and low <= s["high"]), default=-1)
        self.scans.append({"idents": idents, "low": low, "high": high, "before": before, "now": now, "pieces": pieces, "specs": specs, "order": order, "which": which, "per": per, "level": level})
        return end

    def order(self, idents: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of a scan in order, and the place in idents of each one's component."""
        return _scan_order(tuple((c["h"], c["v"], c["blocks"], c["real"], c["first"]) for c in (self.components[i] for i in idents)), self.mcus)


_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RST = re.compile(rb"\xff[\xd0-\xd7]")


@lru_cache(maxsize=1024)
def _scan_order(components: tuple, mcus: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    if len(components) == 1:
        _, _, (_, across), (down, wide), first = components[0]
        order = (first + np.arange(down)[:, None] * across + np.arange(wide)).reshape(-1)
        return order, np.zeros(len(order), np.int64)
    parts, which = [], []
    for k, (h, v, (down, across), _, first) in enumerate(components):
        grid = (first + np.arange(down * across)).reshape(mcus[0], v, mcus[1], h).transpose(0, 2, 1, 3).reshape(mcus[0] * mcus[1], v * h)
        parts.append(grid)
        which.append(np.full(grid.shape, k))
    return np.hstack(parts).reshape(-1), np.hstack(which).reshape(-1)


class Bits:
    """Bit strings side by side, read at any place: 64 bits from each byte on."""

    def __init__(self, pieces: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(x + b"\xff" * 8 for x in pieces) + b"\xff" * 8, np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 8
        self.first = (np.cumsum(size) - size) * 8
        self.raw = raw
        self.windows = np.ndarray(len(raw) - 7, ">u8", raw.tobytes(), 0, (1,)).astype(np.uint64)

    def ahead(self, place: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place on, at the top of a 64-bit word."""
        return self.windows[place >> 3] << (place & 7).astype(np.uint64)

    def bit(self, place: np.ndarray) -> np.ndarray:
        return (self.raw[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1


def _take(word: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits (0 to 32) after `skip` bits of the word."""
    return (((word << skip.astype(np.uint64)) >> np.uint64(32)) >> (32 - n).astype(np.uint64)).astype(np.int64)


def _signed(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((x >> np.maximum(size - 1, 0)) == 0, x - (1 << size) + 1, x)


def _stack(specs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lookup tables end to end, and where the one of each spec begins."""
    places = {s: 65536 * k for k, s in enumerate(dict.fromkeys(specs))}
    return np.concatenate([lookup(s) for s in places]), np.array([places[s] for s in specs])


def _run_scans(scans: list[tuple[dict, int]], coefficients: np.ndarray) -> None:
    """Scans of one level, band and kind, with the place of each one's file in the coefficients."""
    first, low, high = scans[0][0]["before"] == 0, scans[0][0]["low"], scans[0][0]["high"]
    order = np.concatenate([s["order"] + b for s, b in scans])
    which = np.concatenate([s["which"] for s, _ in scans])
    pieces = [p for s, _ in scans for p in s["pieces"]]
    bits = Bits(pieces)
    # Each segment: its blocks are order[begin:begin + size].
    size, begin, shift, spec, at = [], [], [], [], 0
    for s, _ in scans:
        n = len(s["order"])
        for k in range(len(s["pieces"])):
            begin.append(at + k * s["per"])
            size.append(min(s["per"], n - k * s["per"]))
            shift.append(s["now"])
            spec.append(s["specs"])
        at += n
    size, begin, shift = (np.array(x, np.int64) for x in (size, begin, shift))
    owner, place = spread(size)
    block = order[begin[owner] + place]
    if not low:
        if first:
            kinds = max(len(s) for s in spec)
            luts, where = _stack([x for s in spec for x in [*s, *[s[0]] * (kinds - len(s))]])
            coefficients[block, 0] = _dc_values(bits, luts, where.reshape(-1, kinds), size, begin, which) << shift[owner]
        else:
            coefficients[block, 0] |= bits.bit(bits.first[owner] + place).astype(np.int64) << shift[owner]
        return
    # Flat places: every coefficient of the band of every block of every segment.
    width = high - low + 1
    count = size * width
    end = np.cumsum(count)
    luts, where = _stack([s[0] for s in spec])
    if first:
        values = _ac_values(bits, luts, where, end - count, end, width).reshape(-1, width) << shift[owner, None]
    else:
        values = _ac_refined(bits, luts, where, end - count, end, width, coefficients[block, low : high + 1].reshape(-1), 1 << shift).reshape(-1, width)
    coefficients[block, low : high + 1] = values


def _dc_values(bits: Bits, luts, where, size, begin, which) -> np.ndarray:
    """DC values of all segments, a segment after the other: differences decoded side by side, then summed."""
    start = np.cumsum(size) - size
    out, pos, live = np.zeros(int(size.sum()), np.int64), bits.first.copy(), np.arange(len(size))
    for k in range(int(size.max())):
        live = live[size[live] > k]
        word = bits.ahead(pos[live])
        entry = luts[where[live, which[begin[live] + k]] + (word >> np.uint64(48)).astype(np.int64)]
        length, n = (entry >> 8).astype(np.int64), (entry & 15).astype(np.int64)
        out[start[live] + k] = _signed(_take(word, length, n), n)
        pos[live] += length + n
    owner, place = spread(size)
    key = owner * 16 + which[begin[owner] + place]
    by = np.argsort(key, kind="stable")
    total = np.cumsum(out[by])
    fresh = np.flatnonzero(np.r_[True, np.diff(key[by]) != 0])
    runs = np.diff(np.r_[fresh, len(key)])
    values = np.empty_like(out)
    values[by] = total - np.repeat(total[fresh] - out[by][fresh], runs)
    return values


def _block_end(f, run, base, width, end):
    return np.minimum(base + ((f - base) // width + run) * width, end)


def _ac_values(bits: Bits, luts, where, base, end, width) -> np.ndarray:
    """First AC scans: one step decodes the next symbol of every segment that is not at its end."""
    out = np.zeros(int(end[-1]) + 256 if len(end) else 0, np.int64)
    pos, f = bits.first.copy(), base.copy()
    while len(f):
        word = bits.ahead(pos)
        entry = luts[where + (word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, run, n = entry >> 8, (entry >> 4) & 15, entry & 15
        special = np.flatnonzero(n == 0)
        value = _signed(_take(word, length, n), n)
        pos += length + n
        f += run
        out[f] = value
        f += 1
        if len(special):  # 16 zeros, or the end of one or more blocks
            out[f[special] - 1] = 0
            r = run[special]
            g = f[special] - 1 - r
            many = (1 << r) + _take(word[special], length[special], r)
            f[special] = np.where(r == 15, g + 16, _block_end(g, many, base[special], width, end[special]))
            pos[special] += np.where(r == 15, 0, r)
        if (f >= end).any():
            keep = f < end
            pos, f, where, base, end = pos[keep], f[keep], where[keep], base[keep], end[keep]
    return out[: len(out) - 256] if len(out) else out


def _ac_refined(bits: Bits, luts, where, base, end, width, now, one) -> np.ndarray:
    """Refinement of AC coefficients: symbols give new coefficients and skip zeros; a bit corrects each one passed."""
    there = now != 0
    passed = np.r_[0, np.cumsum(there)]
    zeros, known = np.flatnonzero(~there), np.flatnonzero(there)
    zeros = np.r_[zeros, np.full(64, len(now))]
    pos, f, unit = bits.first.copy(), base.copy(), one.copy()
    records: list[tuple] = []
    fresh: list[tuple] = []
    while len(f):
        word = bits.ahead(pos)
        entry = luts[where + (word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, run, n = entry >> 8, (entry >> 4) & 15, entry & 15
        ends = (n == 0) & (run < 15)
        extra = np.where(ends, run, n)
        tail = _take(word, length, extra)
        zero = zeros[np.minimum(f - passed[f] + run, len(zeros) - 1)]
        target = np.where(ends, _block_end(f, (1 << run) + tail, base, width, end), zero)
        target = np.minimum(target, end)
        pos = pos + length + extra
        count = passed[target] - passed[f]
        records.append((passed[f], count, pos, unit))
        new = np.flatnonzero((n > 0) & (zero < end))
        fresh.append((zero[new], np.where(tail[new] == 1, unit[new], -unit[new])))
        pos = pos + count
        f = np.where(ends, target, target + 1)
        if (f >= end).any():
            keep = f < end
            pos, f, where, base, end, unit = pos[keep], f[keep], where[keep], base[keep], end[keep], unit[keep]
    out = now.copy()
    if records:
        c0, count, pos, unit = (np.concatenate(x) for x in zip(*records, strict=True))
        owner, place = spread(count)
        at = known[c0[owner] + place]
        out[at] += np.sign(now[at]) * bits.bit(pos[owner] + place) * unit[owner]
        at, value = (np.concatenate(x) for x in zip(*fresh, strict=True))
        out[at] = value
    return out


def read(files: list[bytes | None]) -> tuple[list[Frame | None], list[int], np.ndarray]:
    """The frames (None: not readable), each one's first block, and all quantised coefficients in zigzag order."""
    frames: list[Frame | None] = []
    for data in files:
        try:
            frames.append(Frame(data) if data else None)
        except (ValueError, IndexError, KeyError):
            frames.append(None)
    base = np.cumsum([0, *(f.total if f else 0 for f in frames)]).tolist()
    coefficients = np.zeros((base[-1], 64), np.int64)
    kinds: dict[tuple, list] = defaultdict(list)
    for f, b in zip(frames, base, strict=False):
        for s in f.scans if f else ():
            kinds[s["level"], s["low"], s["high"], s["before"] > 0].append((s, b))
    for key in sorted(kinds):
        _run_scans(kinds[key], coefficients)
    return frames, base, coefficients


def pixels(frames: list[Frame | None], base: list[int], coefficients: np.ndarray) -> list[np.ndarray | None]:
    """RGB tensors, [height, width, 3] uint8."""
    scale = coefficients.astype(np.float64)
    for f, b in zip(frames, base, strict=False):
        for c in f.components.values() if f else ():
            if (q := f.quantisers[c["q"]]).any() and (q != 1).any():
                n = c["blocks"][0] * c["blocks"][1]
                scale[b + c["first"] : b + c["first"] + n] *= q
    spatial = np.clip(((scale @ basis()).astype(np.int64) + (1 << 15) >> 16) + 128, 0, 255).astype(np.int16)
    out: list[np.ndarray | None] = []
    for f, b in zip(frames, base, strict=False):
        if f is None:
            out.append(None)
            continue
        planes = []
        for c in f.components.values():
            down, across = c["blocks"]
            plane = spatial[b + c["first"] : b + c["first"] + down * across].reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
            up = (f.v // c["v"], f.h // c["h"])
            planes.append((plane.repeat(up[0], 0).repeat(up[1], 1) if up != (1, 1) else plane)[: f.height, : f.width])
        out.append(rgb(planes))
    return out


def rgb(planes: list[np.ndarray]) -> np.ndarray:
    """YCbCr to RGB in 16-bit fixed point; a single plane is grey."""
    if len(planes) < 3:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    channels = (y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half)
    return np.stack([np.clip(c >> 16, 0, 255).astype(np.uint8) for c in channels], 2)


# ---------------------------------------------------------------- operators


def payload(text: str) -> tuple[int, bytes]:
    """The text's UTF-8 bytes, filled up with spaces to a positive multiple of UNIT; and how many it had."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def store_text(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add the binary column `out`: a progressive JPEG file whose coefficients are the text's payload."""

    @F.arrow_udf("binary")
    def write(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([x for part in slices(texts(batch), limit=SLICE_BYTES) for x in store([payload(t)[1] for t in part])], pa.binary())

    return df.withColumn(out, write(F.col(text)))


def stored_payload(frame: Frame, blocks: np.ndarray, size: int) -> bytes:
    """The bytes behind a file of store(), from its coefficients in component order."""
    order, _ = frame.order((1, 2, 3))
    return (blocks[order][: size // 64] - OFFSET).astype(np.uint8).tobytes()


def decode_media(df: DataFrame, media: str = "media", out: str = "tensor") -> DataFrame:
    """Add the struct column `out`: height, width and RGB bytes of each progressive JPEG file."""

    @F.arrow_udf("struct<height:int,width:int,rgb:binary>")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            tensors = [t for part in slices(batch.to_pylist(), lambda x: len(x or b""), SLICE_BYTES) for t in decoded(part)]
            yield pa.array([None if t is None else {"height": t.shape[0], "width": t.shape[1], "rgb": t.tobytes()} for t in tensors], pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())]))

    return df.withColumn(out, decode(F.col(media)))


def decoded(files: list[bytes | None]) -> list[np.ndarray | None]:
    """RGB tensors of files; null where a file is missing or broken."""
    try:
        return pixels(*read(files))
    except (ValueError, IndexError, KeyError, OverflowError, ZeroDivisionError, MemoryError):
        # Some file of these has a good frame and broken scans: the others are decoded without it.
        return [None] if len(files) == 1 else [t for f in files for t in decoded([f])]


def describe(tensor: np.ndarray) -> str:
    """Height, width, and for each channel its sum, its sum of squares and how often it is at either limit."""
    flat = tensor.reshape(-1, 3)
    counts = [np.bincount(flat[:, k], minlength=256) for k in range(3)]
    level = np.arange(256)
    return f"{tensor.shape[0]}x{tensor.shape[1]}" + "".join(f";{c @ level},{c @ (level * level)},{c[0]},{c[255]}" for c in counts)


def media_digests(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add the struct column `out`: sizes and digests of the payload read back from each stored file, and features of its tensor."""
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    @F.arrow_udf("struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for part in slices(texts(batch), limit=SLICE_BYTES):
                sized = [payload(t) for t in part]
                files = store([p for _, p in sized])
                frames, base, coefficients = read(files)
                for (n, p), data, f, b, tensor in zip(sized, files, frames, base, pixels(frames, base, coefficients), strict=False):
                    back = stored_payload(f, coefficients[b : b + f.total], len(p))
                    rows.append((n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), sha256(data).hexdigest(), describe(tensor)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return df.withColumn(out, run(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_progressive_jpeg: every document stored, read back and described."""
    return media_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "media.*")
