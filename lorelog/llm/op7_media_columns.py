"""Media columns: lossless WebP (VP8L) images in a binary column, written and read by this subpackage.

A text's bytes are RGBA pixels, WIDTH a row and at most ROWS rows an image; a longer text takes several images, one
container behind the other.  Images are written and read many at a time by ``webp_batch``, with prefix codes,
back-references, colour caches, and predictor, cross-colour, subtract-green and palette transforms as each image's bytes
decide.  This module has a general reader for one stream (several groups of codes, and codes of any length, too), which
takes what the batch reader leaves, and a writer with every option, for tests.

Format: the public specification "WebP Lossless Bitstream" and the RIFF container.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.llm import webp_batch
from lorelog.llm.op7_format import CACHE_FACTOR, CROSS_COLOUR, DISTANCES, LENGTH_ORDER, LENGTHS, LITERALS, NEAR_PLACES, PALETTE, PREDICTOR, SUBTRACT_GREEN, bundle_bits

UNIT = 576
WIDTH = UNIT // 4
MAX_SIDE = 1 << 14
ROWS = 16
#: Bytes of texts, and of stored media, that are written or read together.
RUN_BYTES = 8 << 20


class BitReader:
    """Bits of a byte string, the least significant of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        start = self.at >> 3
        value = int.from_bytes(self.data[start : start + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return value

    def read_array(self, n: int) -> np.ndarray:
        start = self.at >> 3
        skip = self.at & 7
        part = np.frombuffer(self.data, dtype=np.uint8, offset=start, count=min(len(self.data) - start, (skip + n + 7) >> 3))
        bits = np.unpackbits(part, bitorder="little")[skip : skip + n]
        if len(bits) < n:
            raise ValueError("the image data ends early")
        self.at += n
        return bits


class BitWriter:
    """Gathers bits in a number, and full stretches of them in a list."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.held = self.n = 0

    def _flush(self) -> None:
        raw = np.frombuffer(self.held.to_bytes(-(-self.n // 8), "little"), dtype=np.uint8)
        self.parts.append(np.unpackbits(raw, bitorder="little")[: self.n])
        self.held = self.n = 0

    def write(self, value: int, n: int) -> None:
        self.held |= value << self.n
        self.n += n
        if self.n > 8192:
            self._flush()

    def write_array(self, bits: np.ndarray) -> None:
        if len(bits) <= 512:
            self.write(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), len(bits))
        else:
            self._flush()
            self.parts.append(bits)

    def bytes(self) -> bytes:
        self._flush()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


class PrefixCode:
    """A canonical prefix code given by the code length of each symbol."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths)
        self.used = np.flatnonzero(lengths)
        if not len(self.used):
            self.used = np.array([0])
        sizes = lengths[self.used]
        #: All symbols have codes of this length; -1 if they differ.
        self.level = 0 if len(self.used) == 1 else int(sizes[0]) if (sizes == sizes[0]).all() else -1
        if len(self.used) > 1 and (1.0 / (1 << sizes.astype(np.int64))).sum() != 1:
            raise ValueError("a prefix code is not complete")
        self.table: dict[tuple[int, int], int] | None = None
        self.lengths = lengths

    def codes(self) -> dict[int, tuple[int, int]]:
        """symbol -> (code, most significant bit first; its length)."""
        out, code, size = {}, 0, 0
        if self.level == 0:
            return {int(self.used[0]): (0, 0)}
        for symbol in sorted(self.used.tolist(), key=lambda s: (self.lengths[s], s)):
            n = int(self.lengths[symbol])
            code <<= n - size
            out[symbol], size = (code, n), n
            code += 1
        return out

    def read(self, bits: BitReader) -> int:
        if self.level == 0:
            return int(self.used[0])
        if self.table is None:
            self.table = {(n, code): s for s, (code, n) in self.codes().items()}
        code = n = 0
        while True:
            code, n = code << 1 | bits.read(1), n + 1
            if (n, code) in self.table:
                return self.table[n, code]
            if n > 15:
                raise ValueError("no such code")


def _ranks(bits: np.ndarray) -> np.ndarray:
    """Rows of up to 8 bits, the most significant first, as numbers."""
    wide = np.zeros((len(bits), 8), dtype=np.uint8)
    wide[:, 8 - bits.shape[1] :] = bits
    return np.packbits(wide, axis=1).ravel()


def _read_code(bits: BitReader, size: int) -> PrefixCode:
    lengths = np.zeros(size, dtype=np.uint8)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    of_lengths = np.zeros(19, dtype=np.uint8)
    for k in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[k]] = bits.read(3)
    code = PrefixCode(of_lengths)
    left = size if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
    if left > size:
        raise ValueError("too many code lengths")
    if code.level > 0 and code.used[-1] < 16:  # no runs and equal codes
        lengths[:left] = code.used[_ranks(bits.read_array(left * code.level).reshape(left, code.level))]
        return PrefixCode(lengths)
    at, last = 0, 8
    while at < size and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            at, last = at + 1, symbol or last
            continue
        value, times = (last, 3 + bits.read(2)) if symbol == 16 else (0, 3 + bits.read(3)) if symbol == 17 else (0, 11 + bits.read(7))
        if at + times > size:
            raise ValueError("too many code lengths")
        lengths[at : at + times] = value
        at += times
    return PrefixCode(lengths)


def _value(bits: BitReader, prefix: int) -> int:
    """A length or distance, from its prefix symbol and the bits after it."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(value: int, width: int) -> int:
    if value > len(NEAR_PLACES):
        return value - len(NEAR_PLACES)
    left, up = NEAR_PLACES[value - 1]
    return max(1, up * width + left)


def _read_pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: pixels as 0xAARRGGBB, flat."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    cache_size = 1 << cache_bits if cache_bits else 0
    groups, group_bits, group_of, across = 1, 0, None, 0
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across = -(-width >> group_bits)
        group_of = _read_pixels(bits, across, -(-height >> group_bits), False) >> 8 & 0xFFFF
        groups = int(group_of.max()) + 1
    sizes = (LITERALS + LENGTHS + cache_size, LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = [[_read_code(bits, size) for size in sizes] for _ in range(groups)]
    n = width * height
    levels = [c.level for c in codes[0][:4]]
    if groups == 1 and not cache_size and min(levels) >= 0 and max(levels) <= 8 and codes[0][0].used[-1] < LITERALS:
        rows = bits.read_array(n * sum(levels)).reshape(n, sum(levels))
        out, at = np.zeros(n, dtype=np.uint32), 0
        for code, level, shift in zip(codes[0], levels, (8, 16, 0, 24), strict=False):
            channel = code.used.astype(np.uint32)[_ranks(rows[:, at : at + level])] if level else code.used[:1].astype(np.uint32)
            out |= channel << np.uint32(shift)
            at += level
        return out
    out_list = [0] * n
    cache = [0] * cache_size
    at = 0
    while at < n:
        group = codes[int(group_of[(at // width >> group_bits) * across + (at % width >> group_bits)]) if group_of is not None else 0]
        start = at
        symbol = group[0].read(bits)
        if symbol < LITERALS:
            red, blue, alpha = (group[c].read(bits) for c in (1, 2, 3))
            out_list[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < LITERALS + LENGTHS:
            length = _value(bits, symbol - LITERALS)
            back = _distance(_value(bits, group[4].read(bits)), width)
            if back > at or at + length > n:
                raise ValueError("a copy reaches outside the image")
            for _ in range(length):
                out_list[at] = out_list[at - back]
                at += 1
        else:
            out_list[at] = cache[symbol - LITERALS - LENGTHS]
            at += 1
        if cache_size:
            for p in out_list[start:at]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out_list, dtype=np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) of alpha, red, green, blue."""
    return np.stack([(pixels >> np.uint32(s) & np.uint32(255)).astype(np.int32) for s in (24, 16, 8, 0)], axis=-1)


def _packed(argb: np.ndarray) -> np.ndarray:
    a = (argb & 255).astype(np.uint32)
    return a[..., 0] << np.uint32(24) | a[..., 1] << np.uint32(16) | a[..., 2] << np.uint32(8) | a[..., 3]


def predicted(mode: int, left, top, corner, right):
    """The predictor's value for one pixel from its neighbours (left, top, top-left, top-right), channel by channel."""
    half = lambda x, y: [(i + j) >> 1 for i, j in zip(x, y)]
    clamp = lambda x: [min(255, max(0, i)) for i in x]
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, corner))
        by_top = sum(abs(p - c) for p, c in zip(left, corner))
        return left if by_left < by_top else top
    if mode == 12:
        return clamp(p + t - c for p, t, c in zip(left, top, corner))
    if mode == 13:
        return clamp(m + int((m - c) / 2) for m, c in zip(half(left, top), corner))
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: half(half(left, right), top), 6: lambda: half(left, corner), 7: lambda: half(left, top),
        8: lambda: half(corner, top), 9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
    }[mode]()


def _walk_predictor(argb: np.ndarray, modes: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    """Adds (inverse) or subtracts the prediction; pixels (h, w, 4), modes per block."""
    height, width = argb.shape[:2]
    given = argb.tolist()
    full = [[list(p) for p in row] for row in given] if not inverse else [[None] * width for _ in range(height)]
    out = [[None] * width for _ in range(height)]
    for y in range(height):
        for x in range(width):
            if not y:
                guess = full[0][x - 1] if x else [255, 0, 0, 0]
            elif not x:
                guess = full[y - 1][0]
            else:
                right = full[y - 1][x + 1] if x + 1 < width else full[y][0]
                guess = predicted(int(modes[y >> block][x >> block]), full[y][x - 1], full[y - 1][x], full[y - 1][x - 1], right)
            if inverse:
                full[y][x] = out[y][x] = [(d + g) & 255 for d, g in zip(given[y][x], guess)]
            else:
                out[y][x] = [(d - g) & 255 for d, g in zip(given[y][x], guess)]
    return np.array(out, dtype=np.int32)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255) - ((x & 128) << 1)


def _cross_colour(argb: np.ndarray, factors: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    """factors: (blocks down, across, 4) as the stored pixels: red is red-to-blue, green green-to-blue, blue green-to-red."""
    height, width = argb.shape[:2]
    f = _signed(factors[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block])
    out = argb.copy()
    sign = 1 if inverse else -1
    green = _signed(argb[..., 2])
    plain_red = argb[..., 1] if not inverse else None
    out[..., 1] = argb[..., 1] + sign * (f[..., 3] * green >> 5) & 255
    red = _signed(out[..., 1] if inverse else plain_red)
    out[..., 3] = argb[..., 3] + sign * ((f[..., 2] * green >> 5) + (f[..., 1] * red >> 5)) & 255
    return out


def decode_stream(data: bytes) -> np.ndarray:
    """A VP8L stream (from its signature byte): pixels (height, width, 4) of red, green, blue, alpha."""
    bits = BitReader(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, inner, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            across, down = -(-inner >> block), -(-height >> block)
            image = _channels(_read_pixels(bits, across, down, False)).reshape(down, across, 4)
            undo.append((kind, block, image, inner))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            table = np.cumsum(_channels(_read_pixels(bits, size, 1, False)), axis=0) & 255
            undo.append((kind, bundle_bits(size), table, inner))
            inner = -(-inner >> bundle_bits(size))
        else:
            undo.append((kind, 0, None, inner))
    pixels = _read_pixels(bits, inner, height, True)
    if not undo:
        return pixels.astype("<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]
    argb = _channels(pixels).reshape(height, inner, 4)
    for kind, block, image, wide in reversed(undo):
        if kind == PREDICTOR:
            argb = _walk_predictor(argb, image[..., 2] & 15, block, True)
        elif kind == CROSS_COLOUR:
            argb = _cross_colour(argb, image, block, True)
        elif kind == SUBTRACT_GREEN:
            argb = argb.copy()
            argb[..., 1] = argb[..., 1] + argb[..., 2] & 255
            argb[..., 3] = argb[..., 3] + argb[..., 2] & 255
        else:
            per, mask = 8 >> block, (1 << (8 >> block)) - 1
            x = np.arange(wide)
            index = argb[:, x >> block, 2] >> ((x & ((1 << block) - 1)) * per) & mask
            full = np.vstack([image, np.zeros((256, 4), dtype=image.dtype)])
            argb = full[index]
    return argb[..., [1, 2, 3, 0]].astype(np.uint8)


def streams_of(media: bytes) -> Iterator[bytes]:
    """The lossless streams in one or more RIFF containers, one behind the other."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        chunk = int.from_bytes(media[at + 16 : at + 20], "little")
        yield media[at + 20 : at + 20 + chunk]
        at += 8 + size


def decode_media(media: list[bytes], used: Counter | None = None) -> list[list[np.ndarray]]:
    """The images of each value of the column: pixels (height, width, 4) of red, green, blue, alpha."""
    streams = [list(streams_of(x)) for x in media]
    flat = [s for own in streams for s in own]
    found = iter([decode_stream(s) if x is None else x for s, x in zip(flat, webp_batch.decode_streams(flat, used))])
    return [[next(found) for _ in own] for own in streams]


# --- writer ----------------------------------------------------------------------------------------------


def _huffman(counts: dict[int, int], size: int, limit: int = 15) -> np.ndarray:
    """Code lengths, at most ``limit``: counts are flattened until the tree is low enough."""
    import heapq

    lengths = np.zeros(size, dtype=np.uint8)
    if len(counts) < 2:
        lengths[list(counts) or [0]] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(c, floor), s, (s,)) for s, c in counts.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            (x, i, a), (y, j, b) = heapq.heappop(heap), heapq.heappop(heap)
            for s in a + b:
                depth[s] += 1
            heapq.heappush(heap, (x + y, min(i, j), a + b))
        if max(depth.values()) <= limit:
            lengths[list(depth)] = list(depth.values())
            return lengths
        floor = floor * 2 + max(counts.values()) // 1000


def _write_code(out: BitWriter, lengths: np.ndarray) -> PrefixCode:
    code = PrefixCode(lengths)
    if len(code.used) == 1 and code.used[0] < 256:
        symbol = int(code.used[0])
        out.write(1, 1)
        out.write(0, 1)
        out.write(1, 1)
        out.write(symbol, 8)
        return code
    if len(code.used) == 1:  # a lone symbol beyond 255 has no short form; give it a neighbour
        lengths = lengths.copy()
        lengths[0] = 1
        code = PrefixCode(lengths)
    out.write(0, 1)
    last = int(code.used[-1]) + 1
    kinds = sorted({int(x) for x in lengths[:last]} | {0})
    sizes = _huffman({k: int((lengths[:last] == k).sum()) + 1 for k in kinds} if len(kinds) > 1 else {kinds[0]: 1, 0: 1}, 19, 7)
    n = max(k for k in range(19) if sizes[LENGTH_ORDER[k]]) + 1
    out.write(max(4, n) - 4, 4)
    for k in range(max(4, n)):
        out.write(int(sizes[LENGTH_ORDER[k]]), 3)
    out.write(1, 1)
    size_of_count = 4 if last < 1024 else 5
    out.write(size_of_count, 3)
    out.write(max(2, last) - 2, 2 + 2 * size_of_count)
    of_lengths = PrefixCode(sizes)
    words = of_lengths.codes()
    for x in lengths[: max(2, last)].tolist():
        _write_symbol(out, words[x])
    return code


def _write_symbol(out: BitWriter, word: tuple[int, int]) -> None:
    code, n = word
    if n:
        out.write_array(np.array([code >> (n - 1 - i) & 1 for i in range(n)], dtype=np.uint8))


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    return 2 * top + (v >> (top - 1) & 1), v & ((1 << (top - 1)) - 1), top - 1


def _steps(pixels: list[int], width: int, cache_bits: int, copies: bool) -> list[tuple]:
    """The image as literals, cache hits and copies (greedy, from the last place of the same three pixels)."""
    out, cache, seen, at = [], {}, {}, 0
    places = {}
    for k in range(len(NEAR_PLACES), 0, -1):
        places[_distance(k, width)] = k
    while at < len(pixels):
        length, back = 0, 0
        key = tuple(pixels[at : at + 3])
        if copies and key in seen:
            back = at - seen[key]
            while at + length < len(pixels) and length < 4096 and pixels[at + length] == pixels[at + length - back]:
                length += 1
        if length >= 3:
            out.append(("copy", length, places.get(back, back + len(NEAR_PLACES))))
        else:
            length = 1
            p = pixels[at]
            slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            out.append(("cache", slot, 0) if cache_bits and cache.get(slot) == p else ("pixel", p, 0))
        for k in range(at, at + length):
            if cache_bits:
                cache[(CACHE_FACTOR * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
            seen[tuple(pixels[k : k + 3])] = k
        at += length
    return out


def _write_pixels(out: BitWriter, pixels: np.ndarray, width: int, main: bool, coding: str = "huffman", cache_bits: int = 0, copies: bool = False, group_bits: int = 0) -> None:
    if coding == "level":
        out.write(0, 2 if main else 1)
        _write_level(out, pixels)
        return
    out.write(1 if cache_bits else 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    height = len(pixels) // width
    across = -(-width >> group_bits)
    group_at = lambda at: (at // width >> group_bits) * across + (at % width >> group_bits) if group_bits else 0
    groups = across * -(-height >> group_bits) if group_bits else 1
    if main:
        out.write(1 if group_bits else 0, 1)
        if group_bits:
            out.write(group_bits - 2, 3)
            _write_pixels(out, np.arange(groups, dtype=np.uint32) << np.uint32(8), across, False)
    steps = _steps(pixels.tolist(), width, cache_bits, copies)
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    counts: list[list[dict[int, int]]] = [[{} for _ in sizes] for _ in range(groups)]
    marks, at = [], 0
    for kind, x, y in steps:
        if kind == "pixel":
            symbols = [(0, x >> 8 & 255), (1, x >> 16 & 255), (2, x & 255), (3, x >> 24)]
        elif kind == "cache":
            symbols = [(0, LITERALS + LENGTHS + x)]
        else:
            symbols = [(0, LITERALS + _prefix(x)[0]), (4, _prefix(y)[0])]
        g = group_at(at)
        for c, s in symbols:
            counts[g][c][s] = counts[g][c].get(s, 0) + 1
        marks.append((g, symbols))
        at += x if kind == "copy" else 1
    codes = [[_write_code(out, _huffman(c, size)).codes() for c, size in zip(group, sizes)] for group in counts]
    for (kind, x, y), (g, symbols) in zip(steps, marks):
        for k, (c, s) in enumerate(symbols):
            _write_symbol(out, codes[g][c][s])
            if kind == "copy":
                _, extra, n = _prefix((x, y)[k])
                out.write(extra, n)


def _write_level_code(out: BitWriter, used: np.ndarray, level: int) -> None:
    """A code whose used symbols (below 256) all have ``level`` bits."""
    if not level:
        out.write(0b101 | int(used.argmax()) << 3, 11)
        return
    at = LENGTH_ORDER.index(level)
    count = max(4, at + 1)
    last = max(2, int(np.flatnonzero(used)[-1]) + 1)
    # lengths 0 and level have one bit each in the code of the code lengths
    out.write((count - 4) << 1 | (1 << 3 * LENGTH_ORDER.index(0) | 1 << 3 * at) << 5, 5 + 3 * count)
    out.write(1 | 4 << 1 | (last - 2) << 4, 14)
    out.write_array(used[:last].view(np.uint8))


def _write_level(out: BitWriter, pixels: np.ndarray) -> None:
    """Codes of one length per channel: as many bits as the number of different values needs."""
    columns = []
    for shift in (8, 16, 0, 24):
        channel = (pixels >> np.uint32(shift)).astype(np.uint8)
        used = np.bincount(channel, minlength=256) > 0
        n = int(np.count_nonzero(used))
        level = (n - 1).bit_length()
        if n < 1 << level:
            used[np.flatnonzero(~used)[: (1 << level) - n]] = True  # a complete code needs a power of two
        _write_level_code(out, used, level)
        if level:
            rank = (np.cumsum(used) - 1).astype(np.uint8)[channel]
            columns.append(np.unpackbits(rank[:, None], axis=1)[:, 8 - level :])
    _write_level_code(out, np.arange(DISTANCES) == 0, 0)
    if columns:
        out.write_array(np.concatenate(columns, axis=1).ravel())


def encode_stream(
    rgba: np.ndarray, coding: str = "level", transforms: tuple = (), cache_bits: int = 0, copies: bool = False, group_bits: int = 0, mode: int = 11, factors: tuple[int, int, int] = (20, -9, 33), block: int = 2
) -> bytes:
    """A VP8L stream of pixels (height, width, 4).  transforms: in the order they are applied.

    ``level`` codes take no Python loop a pixel; ``huffman`` ones may use the cache, copies and groups.
    """
    height, width = rgba.shape[:2]
    if not 1 <= width <= MAX_SIDE or not 1 <= height <= MAX_SIDE:
        raise ValueError("an image has 1 to 16384 pixels a side")
    out = BitWriter()
    out.write(0x2F, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)
    out.write(0, 3)
    if not transforms:
        out.write(0, 1)
        _write_pixels(out, np.ascontiguousarray(rgba[..., [2, 1, 0, 3]]).view("<u4").ravel(), width, True, coding, cache_bits, copies, group_bits)
        return out.bytes()
    argb = rgba[..., [3, 0, 1, 2]].astype(np.int32)
    for kind in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        across, down = -(-width >> block), -(-height >> block)
        if kind == PREDICTOR:
            modes = np.full((down, across), mode) if mode < 14 else np.arange(down * across).reshape(down, across) % 14
            argb = _walk_predictor(argb, modes, block, False)
            out.write(block - 2, 3)
            _write_pixels(out, (modes.ravel().astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), across, False)
        elif kind == CROSS_COLOUR:
            cell = np.array([255, *(x & 255 for x in factors)], dtype=np.int32)
            image = np.broadcast_to(cell, (down, across, 4))
            argb = _cross_colour(argb, image, block, False)
            out.write(block - 2, 3)
            _write_pixels(out, _packed(image).ravel(), across, False)
        elif kind == SUBTRACT_GREEN:
            argb = argb.copy()
            argb[..., 1] = argb[..., 1] - argb[..., 2] & 255
            argb[..., 3] = argb[..., 3] - argb[..., 2] & 255
        else:
            table, index = np.unique(_packed(argb).ravel(), return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette has 256 colours at most")
            index = index.reshape(height, width)
            out.write(len(table) - 1, 8)
            cells = _channels(table)
            _write_pixels(out, _packed(np.diff(cells, axis=0, prepend=0)), len(table), False)
            bundle = bundle_bits(len(table))
            per, wide = 8 >> bundle, -(-width >> bundle)
            padded = np.zeros((height, wide << bundle), dtype=np.int32)
            padded[:, :width] = index
            green = sum(padded[:, k :: 1 << bundle] << (k * per) for k in range(1 << bundle))
            argb = np.stack([np.full_like(green, 255), np.zeros_like(green), green, np.zeros_like(green)], axis=-1)
            width = wide
    out.write(0, 1)
    _write_pixels(out, _packed(argb).ravel(), width, True, coding, cache_bits, copies, group_bits)
    return out.bytes()


def container(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + padded


# --- operator --------------------------------------------------------------------------------------------


def pad_payload(raw: bytes) -> bytes:
    return raw + b"\xff" * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def store_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload as RGBA pixels, WIDTH a row; over ROWS rows it takes further images."""
    images, counts = [], []
    for payload in payloads:
        rgba = np.frombuffer(payload, dtype="<u4").reshape(-1, WIDTH)
        # red and blue change places: the bytes are red, green, blue, alpha
        argb = rgba & np.uint32(0xFF00FF00) | rgba >> np.uint32(16) & np.uint32(255) | (rgba & np.uint32(255)) << np.uint32(16)
        own = [argb[at : at + ROWS] for at in range(0, len(argb), ROWS)]
        images += own
        counts.append(len(own))
    found = iter(webp_batch.encode_streams(images))
    return [b"".join(container(next(found)) for _ in range(n)) for n in counts]


def _runs(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, values) of a batch, a bounded number of bytes at a time but for single larger values."""
    at = 0
    while at < len(column):
        size, some = 0, []
        while at + len(some) < len(column) and (not some or size < RUN_BYTES):
            some.append(column[at + len(some)].as_py())
            size += len(some[-1] or b"")
        yield at, some
        at += len(some)


def pixel_features(images: list[np.ndarray]) -> str:
    """Size, range, number of values, and the most frequent value of each channel (the smaller of equals)."""
    pixels = np.concatenate([x.reshape(-1, 4) for x in images])
    counts = np.bincount(pixels.ravel(), minlength=256)
    used = np.flatnonzero(counts)
    modes = [int(np.bincount(pixels[:, c], minlength=256).argmax()) for c in range(4)]
    return f"w={images[0].shape[1]};h={sum(len(x) for x in images)};min={used[0]};max={used[-1]};values={len(used)};modes={','.join(map(str, modes))}"


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): each text's UTF-8 bytes, padded with 255 to a multiple of 576, as WebP.

    Null and empty texts are one unit of 255; a text of any length is stored whole.  Equal texts give equal media, a row
    each where rows are repeated; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raws in _runs(batch.column(1)):
                media = store_payloads([pad_payload(x) for x in raws])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raws)), pa.array(map(len, raws), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_pixels(media: DataFrame) -> DataFrame:
    """Rows (doc_id, width, height, pixels binary) of media (doc_id, media): one row an image, rows in RGBA order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in _runs(batch.column(1)):
                ids = batch.column(0).slice(at, len(values)).to_pylist()
                rows = [(doc_id, x.shape[1], x.shape[0], x.tobytes()) for doc_id, images in zip(ids, decode_media([v or b"" for v in values])) for x in images]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(columns, kinds)], ["doc_id", "width", "height", "pixels"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, width int, height int, pixels binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: DataFrame) -> DataFrame:
    """What the contract asks of each stored form, all from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for at, values in _runs(batch.column(2)):
                rows = []
                for data, images in zip(values, decode_media(values)):
                    payload = b"".join(x.tobytes() for x in images)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), pixel_features(images)))
                columns = [batch.column(c).slice(at, len(values)) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    return media.mapInArrow(run, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(write_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: SQL can't express the format; the query is tested by exact round trips.
SQL = None
