"""Lossless WebP: a decoder for the whole VP8L bit stream (RFC 9649), a small encoder, and the operator over texts.

Decoder: prefix codes (simple and normal, meta prefix groups), back-references with the short-distance map, colour cache; then
the predictor, cross-colour, subtract-green and colour-indexing transforms are inverted and RGBA arrays are written.
A stream under one group of codes is decoded for many bit positions at once: for each position the lengths of the four codes there
are looked up, and the chain of literals and cache symbols walks over them from copy to copy.  What a cache symbol stands for is found
afterwards for all of them: the pixel before it in the same slot, by pointer jumping.

Encoder: per image it takes the transform that leaves the least entropy by the histograms (none, prediction from the left or from
above, cross-colour by green, a palette of up to 256 pixels), then copies of the nearest equal stretch before, then a
colour cache if its hits are worth its symbols; prefix codes are fitted to what is left.

Operator: the UTF-8 bytes of a text, filled up with bytes 255 to a positive multiple of 576, are the samples of RGBA
images 144 pixels wide (one row is 576 bytes; 16,384 rows at most, longer payloads go on in another image).  They are decoded again
from the stored bytes.

Cases: a null text counts as empty (one row of 255); repeated rows give equal values; a null doc_id stays null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, fresh, map_arrow, text_blocks

#: Fixed values of the format: order of code length codes; (x, y) of the first 120 distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LEFT, TOP = 1, 2
TILE, WIDE, MOST_ROWS = 576, 144, 16_384


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            chunk = self.data[self.at : self.at + 6]
            self.held |= int.from_bytes(chunk, "little") << self.n
            self.at += 6
            self.n += 48  # zeros follow the end
        return self.held & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.held >>= n
        self.n -= n

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.skip(n)
        return v

    def position(self) -> int:
        return self.at * 8 - self.n

    def slice(self, start: int, n: int) -> int:
        return int.from_bytes(self.data[start // 8 : (start + n + 7) // 8], "little") >> start % 8 & ((1 << n) - 1)

    def seek(self, bit: int) -> None:
        self.at, self.held, self.n = bit // 8, 0, 0
        self.read(bit % 8)


@lru_cache(16)
def reversal(bits: int) -> np.ndarray:
    """Each number of so many bits, its bits reversed."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, their bits reversed for a stream that is read from the least bit."""
    out, order = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if len(order):
        order = order[np.argsort(lengths[order], kind="stable")]
        most = int(lengths[order[-1]])
        share = 1 << (most - lengths[order])  # of the code space; where a symbol's share begins is its code, filled up with zeros
        out[order] = reversal(most)[(np.cumsum(share) - share) % (1 << most)]
    return out


class Code:
    """A prefix code as a table over its longest length: symbol and length at each index."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.symbols, self.lengths = 0, np.array([used[0] if len(used) else 0], np.int32), np.zeros(1, np.uint8)
        else:
            self.bits = int(lengths.max())
            if int((1 << (self.bits - lengths[used])).sum()) != 1 << self.bits:
                raise ValueError("a prefix code is not complete")
            order = used[np.argsort(lengths[used], kind="stable")]  # in the order of their codes, most significant bit first
            table = np.repeat(order, 1 << (self.bits - lengths[order]))[reversal(self.bits)]
            self.symbols, self.lengths = table.astype(np.int32), lengths[table].astype(np.uint8)
        self.pairs = None

    def steps(self) -> list[tuple[int, int]]:
        if self.pairs is None:
            self.pairs = list(zip(self.symbols.tolist(), self.lengths.tolist(), strict=True))
        return self.pairs

    def read(self, bits: Bits) -> int:
        s, n = self.steps()[bits.peek(self.bits)]
        bits.skip(n)
        return s


@lru_cache(64)
def code_of_lengths(packed: int, n: int) -> Code:
    """The code in which lengths are written, from its own lengths: three bits each, in the format's order."""
    lengths = np.zeros(19, np.int64)
    lengths[list(LENGTH_ORDER[:n])] = [packed >> 3 * i & 7 for i in range(n)]
    return Code(lengths)


def read_lengths(bits: Bits, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    n = 4 + bits.read(4)
    first = bits.read(3 * n)
    most = size if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
    code, at, last = code_of_lengths(first, n), 0, 8
    pairs, mask = code.steps(), (1 << code.bits) - 1
    start = bits.position()
    value, read, out = bits.slice(start, 14 * size + 64), 0, []  # 7 bits of code and 7 more for a symbol at most
    while at < size and most:
        most -= 1
        n, step = pairs[value & mask]
        value >>= step
        read += step
        if n < 16:
            out.append(n)
            at, last = at + 1, n or last
            continue
        more, base = ((2, 3), (3, 3), (7, 11))[n - 16]
        count = base + (value & ((1 << more) - 1))
        value >>= more
        read += more
        at += count
        if at > size:
            raise ValueError("code lengths run over the alphabet")
        out += [last if n == 16 else 0] * count
    bits.seek(start + read)
    lengths[: len(out)] = out
    return lengths


def extra(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def copied(out: np.ndarray, at: int, n: int, d: int) -> None:
    """out[at : at + n] from d places before, which may reach into what is written."""
    if d >= n:
        out[at : at + n] = out[at - d : at - d + n]
    else:
        out[at : at + n] = np.resize(out[at - d : at], n)


def back_reference(bits: Bits, symbol: int, far: Code, wide: int, at: int, count: int) -> tuple[int, int]:
    """Length and distance of a copy that begins with this symbol of the green code."""
    n, d = extra(bits, symbol - 256), extra(bits, far.read(bits))
    if d > 120:
        d -= 120
    else:
        x, y = NEAR[d - 1]
        d = max(1, x + y * wide)
    if d > at or at + n > count:
        raise ValueError("a back-reference leaves the image")
    return n, d


def slots_of(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    """Where the colour cache keeps each pixel."""
    return argb * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)


def before_in_slot(slots: np.ndarray) -> np.ndarray:
    """For each pixel the one before it in the same slot, -1 if there is none."""
    order = np.argsort(slots, kind="stable")
    out = np.full(len(slots), -1)
    follows = slots[order[1:]] == slots[order[:-1]]
    out[order[1:][follows]] = order[:-1][follows]
    return out


def from_cache(out: np.ndarray, cached: np.ndarray, copies: list[tuple[int, int, int]], cache_bits: int) -> np.ndarray:
    """Pixels with what their cache symbols stand for.  cached: slots of cache symbols, -1 elsewhere; copies: (at, size, distance) in order."""
    n = len(out)
    slots = np.where(cached >= 0, cached, slots_of(out, cache_bits))
    source = np.arange(n + 1)
    for at, size, d in copies:
        copied(slots, at, size, d)
        copied(cached, at, size, d)
        source[at : at + size] -= d
    symbols = np.flatnonzero((cached >= 0) & (source[:n] == np.arange(n)))
    earlier = before_in_slot(slots)[symbols]
    source[symbols] = np.where(earlier < 0, n, earlier)  # an empty slot holds zero
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return np.append(out, np.uint32(0))[source[:n]]
        source = further


def one_group_pixels(bits: Bits, group: list[Code], count: int, wide: int, cache_bits: int = 0, block: int = 1 << 17) -> np.ndarray:
    """Pixels of a stream under one group of codes.

    For many bit positions at once, the ends of a literal pixel or cache symbol that would start there are looked up; their chain walks over
    these until a copy begins, which is read by itself.
    """
    green, red, blue, alpha, far = group
    data = np.frombuffer(bits.data + bytes(16), np.uint8)
    codes, most = (green, red, blue, alpha), 4 * max(c.bits for c in group[:4])
    top = int(green.symbols.max())
    if not most and top < 256:
        only = [int(c.symbols[0]) for c in codes]
        return np.full(count, only[3] << 24 | only[1] << 16 | only[0] << 8 | only[2], np.uint32)
    mask = (1 << max(c.bits for c in codes)) - 1
    shifts = np.arange(8, dtype=np.uint32)
    out, done = np.empty(count, np.uint32), 0
    cached, copies = (np.full(count, -1, np.int64) if cache_bits else None), []
    while done < count:
        start = bits.position()
        low = start // 8
        n = min(len(data) - 3 - low, (block + most) // 8 + 2)
        if n <= 0:
            raise ValueError("the stream ends early")
        b = data[low : low + n + 3].astype(np.uint32)
        window = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16)[:, None] >> shifts
        window &= mask
        window = window.ravel()
        reach, sizes, known = len(window) - most, [], {}
        for c in codes:
            if id(c) not in known:
                known[id(c)] = c.lengths[window if c.bits and (1 << c.bits) - 1 == mask else window & ((1 << c.bits) - 1)]
            sizes.append(known[id(c)])
        p1 = np.arange(reach) + sizes[0][:reach]
        p2 = p1 + sizes[1].take(p1, mode="clip")
        p3 = p2 + sizes[2].take(p2, mode="clip")
        ends = np.full(reach + most + 1, -1)  # places behind the reach stop the walk too
        p4 = ends[:reach]
        np.add(p3, sizes[3].take(p3, mode="clip"), out=p4)
        if top >= 256:
            first = green.symbols.take(window[:reach] & ((1 << green.bits) - 1), mode="clip")
            if cache_bits:
                np.copyto(p4, p1, where=first >= 280)
                first[first >= 280] = 0
            p4[first >= 256] = -1
        walk, at = memoryview(ends), start - low * 8
        while done < count and at < reach:
            stops = []
            for _ in range(count - done):
                if (to := walk[at]) < 0:
                    break
                stops.append(at)
                at = to
            if stops:
                places = np.array(stops)
                g, r, bl, a = (c.symbols[window[p] & ((1 << c.bits) - 1)].astype(np.uint32) for c, p in zip(codes, (places, p1[places], p2[places], p3[places]), strict=True))
                out[done : done + len(stops)] = a << 24 | r << 16 | (g & 255) << 8 | bl
                if cache_bits:
                    cached[done : done + len(stops)] = np.where(g >= 280, g.astype(np.int64) - 280, -1)
                done += len(stops)
            if done < count and at < reach:
                bits.seek(low * 8 + at)
                size, d = back_reference(bits, green.read(bits), far, wide, done, count)
                copied(out, done, size, d)
                copies.append((done, size, d))
                done += size
                at = bits.position() - low * 8
        if low * 8 + at == start and done < count:
            raise ValueError("the stream ends early")
        bits.seek(low * 8 + at)
    return from_cache(out, cached, copies, cache_bits) if cache_bits else out


def read_image(bits: Bits, wide: int, high: int, main: bool) -> np.ndarray:
    """ARGB pixels of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, meta, meta_bits, across = 1, None, 0, 0
    if main and bits.read(1):
        meta_bits = 2 + bits.read(3)
        across = -(-wide >> meta_bits)
        meta = (read_image(bits, across, -(-high >> meta_bits), False) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
        groups = max(meta) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    tables = []
    for _ in range(groups):
        codes, last = [], None
        for size in (256 + 24 + cache_size, 256, 256, 256, 40):
            start = bits.position()
            if last and last[0] == size and start + last[1] <= 8 * len(bits.data) and bits.slice(start, last[1]) == last[2]:
                bits.seek(start + last[1])  # the same description again
                codes.append(codes[-1])
                continue
            lengths = read_lengths(bits, size)
            n = bits.position() - start
            last = size, n, bits.slice(start, n)
            codes.append(Code(lengths))
        tables.append(codes)
    count = wide * high
    if groups == 1:
        return one_group_pixels(bits, tables[0], count, wide, cache_bits)
    out, cache, filed, at = [0] * count, [0] * cache_size, 0, 0
    while at < count:
        green, red, blue, alpha, far = tables[meta[(at // wide >> meta_bits) * across + (at % wide >> meta_bits)] if meta else 0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n, d = back_reference(bits, s, far, wide, at, count)
            for i in range(at, at + n):
                out[i] = out[i - d]
            at += n
        else:
            for p in out[filed:at]:
                cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            filed = at
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def planes(argb: np.ndarray) -> np.ndarray:
    """(…, 4) bytes in the order blue, green, red, alpha."""
    return np.ascontiguousarray(argb, "<u4")[..., None].view(np.uint8)


def argb_of(bgra: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bgra, np.uint8).view("<u4")[..., 0]


def predicted(mode: int, left, top, corner, right):
    """One pixel's prediction from its neighbours, each a list of four channels."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode in (0, 14, 15):
        return [0, 0, 0, 255]
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode < 10:
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    trunc = lambda v: -((-v) // 2) if v < 0 else v // 2
    return [clamp(m + trunc(m - c)) for m, c in zip(half(left, top), corner, strict=True)]


def modes_at(bits: int, modes: np.ndarray, wide: int, high: int) -> list[list[int]]:
    return [[int(modes[y >> bits][x >> bits]) for x in range(wide)] for y in range(high)]


def neighbours(p: list, x: int, y: int, wide: int):
    row, above = p[y], p[y - 1]
    return row[x - 1], above[x], above[x - 1], above[x + 1] if x + 1 < wide else row[0]


BLACK = np.array([0, 0, 0, 255], np.uint8)


def differences(bgra: np.ndarray, mode: int) -> np.ndarray:
    """Pixels less the one to the left (above in the first column), or above (to the left in the first row); the first one less black."""
    out = bgra.copy()
    out[0, 0] -= BLACK
    out[0, 1:] -= bgra[0, :-1]
    out[1:, 0] -= bgra[:-1, 0]
    out[1:, 1:] -= bgra[1:, :-1] if mode == LEFT else bgra[:-1, 1:]
    return out


def summed(residual: np.ndarray, mode: int) -> np.ndarray:
    """Undo :func:`differences`."""
    out = residual.copy()
    out[0, 0] += BLACK
    if mode == LEFT:
        out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
        return np.cumsum(out, axis=1, dtype=np.uint8)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    return np.cumsum(out, axis=0, dtype=np.uint8)


def predict(bgra: np.ndarray, bits: int, modes: np.ndarray, inverse: bool) -> np.ndarray:
    """The predictor transform: residuals to pixels if ``inverse``, else pixels to residuals.  One mode, left or top, for all goes by sums and differences."""
    high, wide, _ = bgra.shape
    only = int(modes.flat[0])
    if only in (LEFT, TOP) and (modes == only).all():
        return summed(bgra, only) if inverse else differences(bgra, only)
    src, mode = bgra.tolist(), modes_at(bits, modes, wide, high)
    out = [[None] * wide for _ in range(high)]
    p = out if inverse else src
    sign = 1 if inverse else -1
    for y in range(high):
        for x in range(wide):
            if y == 0:
                guess = [0, 0, 0, 255] if x == 0 else p[0][x - 1]
            elif x == 0:
                guess = p[y - 1][0]
            else:
                guess = predicted(mode[y][x], *neighbours(p, x, y, wide))
            out[y][x] = [(a + sign * g) & 255 for a, g in zip(src[y][x], guess, strict=True)]
    return np.array(out, np.uint8).reshape(high, wide, 4)


def cross_colour(bgra: np.ndarray, bits: int, factors: np.ndarray, inverse: bool) -> np.ndarray:
    """factors: (…, 4) bytes; blue is green-to-red, green is green-to-blue, red is red-to-blue."""
    high, wide, _ = bgra.shape
    f = np.repeat(np.repeat(factors, 1 << bits, 0), 1 << bits, 1)[:high, :wide].view(np.int8).astype(np.int32)
    out = bgra.astype(np.int32)
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green, sign = signed(out[..., 1]), 1 if inverse else -1
    before = signed(out[..., 2])
    out[..., 2] += sign * (f[..., 0] * green >> 5)
    red = signed(out[..., 2]) if inverse else before
    out[..., 0] += sign * ((f[..., 1] * green >> 5) + (f[..., 2] * red >> 5))
    return (out & 255).astype(np.uint8)


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def unpalette(argb: np.ndarray, table: np.ndarray, wide: int) -> np.ndarray:
    bits = palette_bits(len(table))
    green = argb >> np.uint32(8) & np.uint32(255)
    each = 8 >> bits
    x = np.arange(wide)
    index = green[:, x >> bits] >> (each * (x & ((1 << bits) - 1))).astype(np.uint32) & np.uint32((1 << each) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode_stream(data: bytes) -> np.ndarray:
    """RGBA pixels (rows, columns, 4) of a VP8L stream."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP stream")
    wide, high = 1 + bits.read(14), 1 + bits.read(14)
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now = [], wide
    while bits.read(1):
        kind = bits.read(2)
        if kind in [u[0] for u in undo]:
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = 2 + bits.read(3)
            across, down = -(-now >> b), -(-high >> b)
            undo.append((kind, b, read_image(bits, across, down, False).reshape(down, across)))
        elif kind == PALETTE:
            size = 1 + bits.read(8)
            table = argb_of(np.cumsum(planes(read_image(bits, size, 1, False)), axis=0, dtype=np.uint8))
            undo.append((kind, now, table))
            now = -(-now >> palette_bits(size))
        else:
            undo.append((kind,))
    argb = read_image(bits, now, high, True).reshape(high, now)
    for kind, *how in reversed(undo):
        if kind == PREDICTOR:
            argb = argb_of(predict(planes(argb), how[0], how[1] >> np.uint32(8) & np.uint32(15), True))
        elif kind == CROSS_COLOUR:
            argb = argb_of(cross_colour(planes(argb), how[0], planes(how[1]), True))
        elif kind == PALETTE:
            argb = unpalette(argb, how[1], how[0])
        else:
            p = planes(argb).copy()
            p[..., 0] += p[..., 1]
            p[..., 2] += p[..., 1]
            argb = argb_of(p)
    return planes(argb)[..., [2, 1, 0, 3]]


def chunks(file: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of one RIFF file after another."""
    at = 0
    while at < len(file):
        tag, size, form = struct.unpack_from("<4sI4s", file, at)
        if tag != b"RIFF" or form != b"WEBP" or at + 8 + size > len(file):
            raise ValueError("not a WebP file")
        end, at = at + 8 + size, at + 12
        while at + 8 <= end:
            name, n = struct.unpack_from("<4sI", file, at)
            yield name, file[at + 8 : at + 8 + n]
            at += 8 + n + (n & 1)
        at = end


def decode(file: bytes) -> list[np.ndarray]:
    """The RGBA images of one or more WebP files in a row."""
    return [decode_stream(body) for name, body in chunks(file) if name == b"VP8L"]


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman lengths of at most ``most`` bits; counts are flattened until they fit."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int64)
    weights = [int(counts[s]) for s in used]
    while len(used) > 1:
        n = len(used)
        by = sorted(range(n), key=weights.__getitem__)
        leaves, made, parent = [weights[i] for i in by] + [math.inf], [], [0] * (2 * n - 1)
        i = j = 0  # the next leaf and the next inner node: both queues ascend
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if j < len(made) and made[j] < leaves[i]:
                    total += made[j]
                    parent[n + j] = k
                    j += 1
                else:
                    total += leaves[i]
                    parent[by[i]] = k
                    i += 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= most:
            lengths[used] = depth[:n]
            break
        weights = [(w + 1) // 2 + 1 for w in weights]
    else:
        lengths[used] = 1
    return lengths


def put_code(out: Writer, lengths: np.ndarray) -> None:
    """A prefix code's description."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1 | (len(used) - 1) << 1 | 1 << 2 | used[0] << 3, 11)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    out.put(15 << 1, 5)  # a normal code, all 19 lengths: four bits for symbols below 13, five above; that is complete
    for s in LENGTH_ORDER:
        out.put(4 if s < 13 else 5, 3)
    out.put(0, 1)
    first, value, size, before = length_codes(), 0, 0, -1
    for at, n in zip(used, lengths[used].tolist(), strict=True):
        if at - before > 1:
            v, k = zeros(at - before - 1)
            value |= v << size
            size += k
        value |= first[n] << size
        size += 4 if n < 13 else 5
        before = at
    v, k = zeros(len(lengths) - before - 1)
    out.put(value | v << size, size + k)


@lru_cache(2048)
def zeros(count: int) -> tuple[int, int]:
    """So many lengths of zero: value and number of bits."""
    first, value, size = length_codes(), 0, 0
    while count >= 3:
        k = min(count, 138)
        value |= (first[18] | (k - 11) << 5 if k > 10 else first[17] | (k - 3) << 5) << size
        size += 12 if k > 10 else 8
        count -= k
    for _ in range(count):
        value |= first[0] << size
        size += 4
    return value, size


@lru_cache(1)
def length_codes() -> list[int]:
    return codes_of(np.array([4] * 13 + [5] * 6)).tolist()


def header(wide: int, high: int, alpha: bool = True) -> Writer:
    out = Writer()
    out.put(0x2F, 8)
    out.put(wide - 1, 14)
    out.put(high - 1, 14)
    out.put(int(alpha), 1)
    out.put(0, 3)
    return out


def riff(stream: bytes) -> bytes:
    pad = bytes(len(stream) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(stream) + len(pad), b"WEBP", b"VP8L", len(stream)) + stream + pad


def put_fields(out: Writer, value: np.ndarray, size: np.ndarray) -> bytes:
    """What ``out`` holds, then fields of 24 bits at most."""
    ends = np.cumsum(size)
    at = ends - size + out.n % 8
    total = (int(ends[-1]) + out.n % 8 + 7) // 8
    value = value << (at & 7)
    at >>= 3
    body = np.bincount(at, value & 255, total + 4)
    for k in (1, 2, 3):
        body[k:] += np.bincount(at, value >> (8 * k) & 255, total + 4 - k)
    body = body[:total].astype(np.uint8)
    head = out.value.to_bytes(out.n // 8 + 1, "little")
    body[0] |= head[-1]
    return head[:-1] + body.tobytes()


def prefix_of(n: int) -> tuple[int, int, int]:
    """Symbol, number of extra bits and their value for a length or distance n."""
    if n <= 4:
        return n - 1, 0, 0
    top = (n - 1).bit_length() - 1
    return 2 * top + ((n - 1) >> (top - 1) & 1), top - 1, (n - 1) & ((1 << (top - 1)) - 1)


#: Copies: the least pixels of one, the most, and the farthest distance of the format.
LEAST, LONGEST, FARTHEST = 4, 4096, (1 << 20) - 120


@lru_cache(1)
def self_information(most: int = 1 << 16) -> np.ndarray:
    """c log2 c for counts up to ``most``."""
    c = np.arange(most + 1)
    return c * np.log2(np.maximum(c, 1))


def entropy(samples: np.ndarray) -> float:
    """Bits a byte of at most 2**16 bytes under a code fitted to them."""
    n = samples.size
    return math.log2(n) - float(self_information()[np.bincount(samples.ravel(), minlength=256)].sum()) / n if n else 8.0


def best_transform(bgra: np.ndarray, rows: int = 8) -> tuple[int | None, object]:
    """The transform that leaves the least entropy on up to ``rows`` rows in a row from the middle, and its parameter."""
    start = max(0, (len(bgra) - rows) // 2)
    some = bgra[start : start + rows]
    n = some.size
    costs = [
        0.98 * n * entropy(some),  # a transform must be worth its description
        n * entropy(some[:, 1:] - some[:, :-1]) + 60,
        n * entropy(some[1:] - some[:-1]) + 60,
        # what the factors of CROSS do, but for rounding: red and blue less green
        n / 2 * (entropy(some[..., 0::2] - some[..., 1:2]) + entropy(some[..., 1::2])) + 60,
    ]
    best = costs.index(min(costs))
    argb = argb_of(some).ravel()
    if 3 * len(table := set(argb[:400].tolist())) < min(400, len(argb)):  # repeats enough to ask for all pixels
        table = np.unique(argb_of(bgra))
        if len(table) <= 256:
            index = len(argb) * entropy(np.searchsorted(table, argb))
            if index + 24.0 * len(table) * len(some) / len(bgra) < costs[best]:
                return PALETTE, table
    return ((None, None), (PREDICTOR, LEFT), (PREDICTOR, TOP), (CROSS_COLOUR, CROSS))[best]


#: Red and blue less green: factors of 32 (one, in fifths of bits), green to red in blue's place, green to blue in green's.
CROSS = (32, 32, 0, 255)


def equal_stretches(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, size, distance) of copies, ascending and apart: stretches whose pairs of pixels all occurred last at one distance."""
    n = len(argb)
    if n <= LEAST:
        return []
    pair = argb[:-1].astype(np.uint64) << np.uint64(32) | argb[1:]
    before = before_in_slot(pair)
    at = np.arange(n - 1)
    d = np.where((before >= 0) & (at - before <= FARTHEST), at - before, 0)
    edge = np.flatnonzero(np.diff(d)) + 1
    starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [n - 1]))
    use = np.flatnonzero((d[starts] > 0) & (ends - starts >= LEAST - 1))
    out, free = [], 0
    for start, end, dist in zip(starts[use].tolist(), ends[use].tolist(), d[starts[use]].tolist(), strict=True):
        start, end = max(start, free), end + 1
        if end - start < LEAST:
            continue
        out += [(i, min(LONGEST, end - i), dist) for i in range(start, end, LONGEST)]
        free = end
    return out


@lru_cache(4)
def distance_codes(wide: int) -> dict[int, int]:
    """Distances that have one of the 120 short codes."""
    out: dict[int, int] = {}
    for i, (x, y) in enumerate(NEAR):
        out.setdefault(max(1, x + y * wide), i + 1)
    return out


def cache_gain(argb: np.ndarray, literal: np.ndarray, bits: int) -> tuple[float, np.ndarray]:
    """Bits that a cache would save, by and large, and which literals it would hit."""
    before = before_in_slot(slots_of(argb, bits))
    hits = literal & (before >= 0) & (argb == argb[before])
    n, m = int(np.count_nonzero(hits)), int(np.count_nonzero(literal))
    if not n:
        return 0.0, hits
    kinds = len(np.unique(argb[hits]))
    each = np.log2(max(2, kinds)) + np.log2(m / n)  # of a symbol; what it takes the place of has some 20 bits
    return n * (20 - each) - 5 * kinds - (m - n) * np.log2(m / max(1, m - n) if m > n else 1), hits


def put_pixels(out: Writer, argb: np.ndarray, wide: int, main: bool) -> Writer:
    """An entropy-coded image: copies, cache symbols and literals under one group of codes."""
    copies = equal_stretches(argb)
    literal = np.ones(len(argb), bool)
    for at, n, _ in copies:
        literal[at : at + n] = False
    cache_bits, hits = 0, None
    some = argb[:512].tolist()
    if main and len(argb) >= 64 and 10 * len(set(some)) < 8 * len(some):  # a fifth of the first pixels repeat
        gain, hits = cache_gain(argb, literal, 8)
        cache_bits = 8 if gain > 0.05 * 20 * len(argb) else 0
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)  # no meta prefix codes
    bgra = planes(argb)
    symbols = bgra[:, [1, 2, 0, 3]].astype(np.int64)
    if cache_bits:
        symbols[hits, 0] = 280 + slots_of(argb[hits], cache_bits).astype(np.int64)
        lone = hits[literal]
    symbols = symbols[literal]
    near = distance_codes(wide)
    tokens = [(*prefix_of(n), *prefix_of(near.get(d, d + 120))) for _, n, d in copies]
    size = 280 + (1 << cache_bits if cache_bits else 0)
    greens = np.bincount(symbols[:, 0], minlength=size)
    fars = np.zeros(40, np.int64)
    for t in tokens:
        greens[256 + t[0]] += 1
        fars[t[3]] += 1
    others = symbols[~lone, 1:] if cache_bits else symbols[:, 1:]
    lengths = code_lengths(greens, 12), code_lengths(np.bincount(others.ravel(), minlength=256), 12), code_lengths(fars, 12)
    one = Writer()
    put_code(out, lengths[0])
    put_code(one, lengths[1])
    for _ in range(3):
        out.put(one.value, one.n)
    put_code(out, lengths[2])
    codes = [(np.where(np.count_nonzero(n) > 1, codes_of(n), 0), np.where(np.count_nonzero(n) > 1, n, 0)) for n in lengths]
    if cache_bits:
        symbols[lone, 1:] = 0
    value, bits = (np.concatenate((codes[0][k][symbols[:, :1]], codes[1][k][symbols[:, 1:]]), axis=1) for k in (0, 1))
    if cache_bits:
        value[lone, 1:] = 0
        bits[lone, 1:] = 0
    value, bits = value.ravel(), bits.ravel()
    if copies:
        # two fields of each copy: its length, then its distance; extra bits follow their symbol
        before = np.cumsum(literal)
        places = np.repeat([4 * int(before[at - 1]) for at, _, _ in copies], 3)
        (gv, gn), (fv, fn) = ([x.tolist() for x in codes[k]] for k in (0, 2))
        fields = [f for s, nb, extra, ds, db, dx in tokens for f in ((gv[256 + s] | extra << gn[256 + s], gn[256 + s] + nb), (fv[ds], fn[ds]), (dx, db))]
        value = np.insert(value, places, [f[0] for f in fields])
        bits = np.insert(bits, places, [f[1] for f in fields])
    if not bits.any():
        return out
    total = out.n + int(bits.sum())
    written = Writer()
    written.value, written.n = int.from_bytes(put_fields(out, value, bits), "little"), total
    return written


def encode_samples(rgba: np.ndarray) -> bytes:
    """A WebP file of RGBA pixels (rows, columns, 4)."""
    high, wide, _ = rgba.shape
    bgra = np.ascontiguousarray(rgba[..., [2, 1, 0, 3]])
    kind, how = best_transform(bgra)
    out = header(wide, high)
    across = wide
    if kind in (PREDICTOR, CROSS_COLOUR):
        blocks = -(-wide >> 9) * -(-high >> 9)  # one parameter for all, in the largest blocks
        out.put(1 | kind << 1 | 7 << 3, 6)
        out = put_pixels(out, np.full(blocks, how << 8 if kind == PREDICTOR else int(argb_of(np.array(how, np.uint8))), np.uint32), -(-wide >> 9), False)
        argb = argb_of(differences(bgra, how) if kind == PREDICTOR else cross_colour(bgra, 9, np.broadcast_to(np.array(how, np.uint8), (-(-high >> 9), -(-wide >> 9), 4)), False)).ravel()
    elif kind == PALETTE:
        steps = planes(how).copy()
        steps[1:] -= planes(how)[:-1]
        out.put(1 | kind << 1 | (len(how) - 1) << 3, 11)
        out = put_pixels(out, argb_of(steps), len(how), False)
        bits = palette_bits(len(how))
        each, across = 8 >> bits, -(-wide >> bits)
        index = np.zeros((high, across << bits), np.uint32)
        index[:, :wide] = np.searchsorted(how, argb_of(bgra))
        shifts = (each * np.arange(1 << bits)).astype(np.uint32)
        argb = ((index.reshape(high, across, 1 << bits) << shifts).sum(axis=2, dtype=np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).ravel()
    else:
        argb = argb_of(bgra).ravel()
    out.put(0, 1)  # no more transforms
    out = put_pixels(out, argb, across, True)
    return riff(out.value.to_bytes((out.n + 7) // 8, "little"))


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 576 bytes as one or more WebP files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDE, 4)
    return b"".join(encode_samples(rows[i : i + MOST_ROWS]) for i in range(0, len(rows), MOST_ROWS))


def restore(media: bytes) -> np.ndarray:
    return np.concatenate([x.ravel() for x in decode(media)])


def feature(samples: np.ndarray) -> str:
    """Which of 64 like stretches of the samples, less the filling bytes at the end, are brighter than all on average; 16 hex digits."""
    used = np.flatnonzero(samples != 255)
    body = samples[: used[-1] + 1] if len(used) else samples[:0]
    if len(body) < 64:
        body = np.concatenate((body, np.zeros(64 - len(body), np.uint8)))
    cuts = np.arange(64) * len(body) // 64
    means = np.add.reduceat(body, cuts, dtype=np.int64) / np.diff([*cuts, len(body)])
    return np.packbits(means > body.mean()).tobytes().hex()


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored media of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in text_blocks(batches, limit=8 << 20):
            texts = [encoded(t) for t in b.column("text").to_pylist()]
            stored = [store(t + b"\xff" * (-len(t) % TILE if t else TILE)) for t in texts]
            yield {"doc_id": b.column("doc_id"), "n_bytes": [len(t) for t in texts], "media": stored}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long,n_bytes long,media binary")


def features(stored: DataFrame) -> DataFrame:
    """Read media back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of each row of :func:`media`."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in text_blocks(batches, "media", limit=8 << 20):
            out = []
            for m in b.column("media").to_pylist():
                samples = restore(m)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)))
            yield {"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), **dict(zip(names, zip(*out, strict=True), strict=True))}

    ddl = "doc_id long,n_bytes long,payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string"
    return map_arrow(stored, run, ddl)


def pixels(stored: DataFrame, column: str = "media") -> DataFrame:
    """All columns, and the first image of a column of WebP files as ``pixel_height``, ``pixel_width`` and ``pixel_rgba`` (underscores follow where the input has such names); nulls for null."""
    names = [fresh(stored.columns, n) for n in ("pixel_height", "pixel_width", "pixel_rgba")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, column, limit=4 << 20):
            got = [None if m is None else decode(m)[0] for m in b.column(column).to_pylist()]
            new = [[None if g is None else g.shape[0] for g in got], [None if g is None else g.shape[1] for g in got], [None if g is None else g.tobytes() for g in got]]
            cols = [pa.array(v, k) for v, k in zip(new, (pa.int32(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    from pyspark.sql import types as T

    new = [T.StructField(n, k) for n, k in zip(names, (T.IntegerType(), T.IntegerType(), T.BinaryType()), strict=True)]
    return stored.mapInArrow(run, T.StructType([*stored.schema.fields, *new]))
