"""Lossless WebP (VP8L) in numpy: a decoder of the whole format and a writer for grey images.

The decoder reads prefix codes (simple, normal and grouped by an entropy image), literals, back-references and
the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. Where red, blue
and alpha have one symbol each, as in grey and palette images, runs of literals are decoded at once: the code at
every bit position is looked up in one table, and the chain of positions is followed.

The writer stores 8-bit samples as grey pixels: subtract-green leaves green only; images of 16 grey levels or
less become a packed palette; equal samples at the end become back-references.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batch_of, slices, table

WIDTH, MOST_ROWS = 576, 16384

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes):
        self.data = data + bytes(16)
        self.at = 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        a = self.at
        self.at = a + n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return (int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        a = self.at
        return (int.from_bytes(self.data[a >> 3 : (a >> 3) + 4], "little") >> (a & 7)) & ((1 << n) - 1)


def codes_of(lengths: list[int]) -> list[int]:
    """Canonical prefix codes, bits reversed as they stand in the stream; 0 for unused symbols."""
    out, code, size = [0] * len(lengths), 0, 0
    for n, s in sorted([(n, s) for s, n in enumerate(lengths) if n]):
        code <<= n - size
        size = n
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


class Prefix:
    """A prefix code as a table over the next `most` bits; a code of one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        self.most = 0 if len(used) < 2 else max(lengths)
        if len(used) < 2:
            self.only = used[0] if used else 0
            return
        if sum(1 << (self.most - lengths[s]) for s in used) != 1 << self.most:
            raise ValueError("a prefix code isn't complete")
        self.symbols, self.sizes = np.zeros(1 << self.most, np.int16), np.zeros(1 << self.most, np.int32)
        codes = codes_of(lengths)
        for s in used:
            self.symbols[codes[s] :: 1 << lengths[s]] = s
            self.sizes[codes[s] :: 1 << lengths[s]] = lengths[s]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        k = bits.peek(self.most)
        bits.at += int(self.sizes[k])
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        return int(self.symbols[k])


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[LENGTH_ORDER[k]] = bits.read(3)
    code = Prefix(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            many = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + many > alphabet:
                raise ValueError("too many code lengths")
            lengths[at : at + many] = [last if s == 16 else 0] * many
            at += many
    return Prefix(lengths)


def _value(bits: Bits, prefix: int) -> int:
    """Of a length or distance: the prefix's first value and its extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _literals(bits: Bits, code: Prefix, most: int) -> np.ndarray:
    """Green symbols up to the first that is no literal, or `most` of them; moves on behind them."""
    if code.only is not None:
        return np.full(most if code.only < 256 else 0, code.only, np.int64)
    span = min(most, 4096 + most // 4) if most > 1 << 16 else most
    begin = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, min(len(bits.data) - begin - 3, (span * code.most >> 3) + 4) + 3, begin).astype(np.uint32)
    window = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16)
    look = ((window[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << code.most) - 1)).ravel()
    end = len(look)
    symbol, size = np.append(code.symbols[look], 256), code.sizes[look]
    one = np.arange(end + 1, dtype=np.int32)  # from each bit position to the next code's; what is no literal leads to the end
    one[:-1] = np.where(symbol[:-1] < 256, np.minimum(one[:-1] + size, end), end)
    two = one[one]
    four = two[two]
    follow = memoryview(four[four])
    starts: list[int] = []
    p = bits.at & 7
    for _ in range(-(-span // 8)):
        if p >= end:
            break
        starts.append(p)
        p = follow[p]
    at = np.array(starts, np.int32)[:, None]
    for jump in (one, two, four):
        at = np.hstack([at, jump[at]])
    at = at.ravel()[:span]
    stop = np.flatnonzero(symbol[at] >= 256)
    at = at[: stop[0]] if len(stop) else at
    if len(at):
        bits.at = 8 * begin + int(at[-1] + size[at[-1]])
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    return symbol[at]


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: argb of each pixel, in order."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, group_of, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        entropy = _pixels(bits, across, -(-height >> shift), False)
        group_of = (entropy >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(group_of.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_prefix(bits, n) for n in sizes] for _ in range(groups)]
    out = np.zeros(width * height, np.uint32)
    cache = np.zeros(1 << cache_bits, np.uint32)
    cached = 0  # pixels up to here are in the cache

    def fill(upto: int) -> None:
        new = out[cached:upto]
        cache[(new * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)] = new  # of equal places, the last stays

    grey = groups == 1 and all(c.only is not None for c in codes[0][1:4])
    rest = (codes[0][3].only << 24 | codes[0][1].only << 16 | codes[0][2].only) if grey else 0
    at, n = 0, len(out)
    while at < n:
        if grey:
            found = _literals(bits, codes[0][0], n - at)
            out[at : at + len(found)] = found.astype(np.uint32) << np.uint32(8) | np.uint32(rest)
            at += len(found)
            if len(found):
                continue
        code = codes[int(group_of[((at // width) >> shift) * across + ((at % width) >> shift)])] if group_of is not None else codes[0]
        s = code[0].read(bits)
        if s < 256:
            red, blue, alpha = (c.read(bits) for c in code[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _value(bits, s - 256)
            d = _value(bits, code[4].read(bits))
            d = max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width) if d <= 120 else d - 120
            if d > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            if d >= length:
                out[at : at + length] = out[at - d : at - d + length]
            else:
                out[at : at + length] = np.resize(out[at - d : at], length)
            at += length
        else:
            if cached < at:
                fill(at)
                cached = at
            out[at] = cache[s - 280]
            at += 1
    return out


def _split(argb: np.ndarray) -> np.ndarray:
    """(4, ...) alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(k)) & np.uint32(255) for k in (24, 16, 8, 0)]).astype(np.int64)


def _join(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[0] << np.uint32(24) | c[1] << np.uint32(16) | c[2] << np.uint32(8) | c[3]


def _predicted(mode: int, left, top, top_right, top_left):
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(), np.abs(left - top_left).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        return np.clip(mean + np.fix((mean - top_left) / 2).astype(np.int64), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: half(half(left, top_right), top), 6: lambda: half(left, top_left), 7: lambda: half(left, top),
        8: lambda: half(top_left, top), 9: lambda: half(top, top_right), 10: lambda: half(half(left, top_left), half(top, top_right)),
    }.get(mode, lambda: np.array([255, 0, 0, 0]))()


def unpredict(argb: np.ndarray, width: int, height: int, shift: int, modes: np.ndarray) -> np.ndarray:
    c = _split(argb).T.copy()  # (pixels, 4)
    across = -(-width >> shift)
    c[0] += (255, 0, 0, 0)
    c[:width] = np.cumsum(c[:width], axis=0) & 255  # the first row follows from the left
    for y in range(1, height):
        row = y * width
        c[row] = (c[row] + c[row - width]) & 255
        of = ((modes[(y >> shift) * across + (np.arange(width) >> shift)] >> np.uint32(8)) & np.uint32(15)).astype(int)
        x = 1
        while x < width:
            more = x + 1
            while more < width and of[more] == of[x]:
                more += 1
            a, b = row + x, row + more
            mode = of[x]
            if mode == 1:
                c[a:b] = (np.cumsum(c[a:b], axis=0) + c[a - 1]) & 255
            elif mode in (0, 2, 3, 4, 8, 9) and not (mode in (3, 9) and more == width):
                c[a:b] = (c[a:b] + _predicted(mode, None, c[a - width : b - width], c[a - width + 1 : b - width + 1], c[a - width - 1 : b - width - 1])) & 255
            else:
                for i in range(a, b):
                    c[i] = (c[i] + _predicted(mode, c[i - 1], c[i - width], c[i - width + 1], c[i - width - 1])) & 255
            x = more
    return _join(c.T)


def uncross(argb: np.ndarray, width: int, height: int, shift: int, elements: np.ndarray) -> np.ndarray:
    c = _split(argb)
    y, x = np.divmod(np.arange(len(argb)), width)
    e = _split(elements[(y >> shift) * -(-width >> shift) + (x >> shift)]).astype(np.int8).astype(np.int64)
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int64)
    green = signed(c[2])
    c[1] += (e[3] * green) >> 5
    c[3] += (e[2] * green) >> 5
    c[3] += (e[1] * signed(c[1])) >> 5
    return _join(c)


def ungreen(argb: np.ndarray) -> np.ndarray:
    green = (argb >> np.uint32(8)) & np.uint32(255)
    return (argb & np.uint32(0xFF00FF00)) | ((argb & np.uint32(0xFF00FF)) + green * np.uint32(0x10001)) & np.uint32(0xFF00FF)


def unpack_palette(argb: np.ndarray, width: int, height: int, colours: np.ndarray, packing: int) -> np.ndarray:
    index = (argb >> np.uint32(8)) & np.uint32(255)
    if packing:
        size = 8 >> packing
        x = np.arange(width)
        index = (index.reshape(height, -1)[:, x >> packing] >> ((x & ((1 << packing) - 1)) * size).astype(np.uint32)) & np.uint32((1 << size) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[index.ravel()]


def decode_vp8l(data: bytes) -> np.ndarray:
    """(height, width) argb of one VP8L stream."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not VP8L")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    back = []
    inner = width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == k for k, *_ in back):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            back.append((kind, inner, shift, _pixels(bits, -(-inner >> shift), -(-height >> shift), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = _join(np.cumsum(_split(_pixels(bits, n, 1, False)), axis=1))
            packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            back.append((kind, inner, packing, colours))
            inner = -(-inner >> packing)
        else:
            back.append((kind, inner, 0, None))
    argb = _pixels(bits, inner, height, True)
    for kind, wide, n, more in reversed(back):
        if kind == PREDICTOR:
            argb = unpredict(argb, wide, height, n, more)
        elif kind == CROSS_COLOUR:
            argb = uncross(argb, wide, height, n, more)
        elif kind == SUBTRACT_GREEN:
            argb = ungreen(argb)
        else:
            argb = unpack_palette(argb, wide, height, more, n)
    return argb.reshape(height, width)


def images(media: bytes) -> Iterator[bytes]:
    """The VP8L streams of one or more WebP files that follow each other."""
    at = 0
    while at < len(media):
        riff, size, webp, kind, n = struct.unpack_from("<4sI4s4sI", media, at)
        if (riff, webp, kind) != (b"RIFF", b"WEBP", b"VP8L"):
            raise ValueError("not a lossless WebP file")
        yield media[at + 20 : at + 20 + n]
        at += 8 + size


# Writing.


class Out:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) >> 3, "little")


def lengths_of(counts: list[int], most: int) -> list[int]:
    """Huffman code lengths of at most `most` bits: counts are flattened until they fit."""
    lengths = [0] * len(counts)
    used = [s for s, n in enumerate(counts) if n]
    if len(used) == 1:
        lengths[used[0]] = 1
    if len(used) < 2:
        return lengths
    while True:
        heap = [(counts[s], s, (s,)) for s in used]
        heapq.heapify(heap)
        lengths = [0] * len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths) <= most:
            return lengths
        counts = [(n + 1) // 2 if n else 0 for n in counts]


def put_prefix(out: Out, lengths: list[int]) -> list[int]:
    """Writes a prefix code; the lengths that count for its symbols (0 where it has only one)."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256:
        first = used[0] if used else 0
        out.put(1 | (len(used) == 2) << 1 | 1 << 2, 3)
        out.put(first, 8)
        if len(used) == 2:
            out.put(used[1], 8)
        return lengths if len(used) == 2 else [0] * len(lengths)
    steps: list[tuple[int, int, int]] = []
    at, end = 0, used[-1] + 1
    while at < len(lengths):
        if at >= end or not lengths[at]:
            run = (next((s for s in used if s > at), len(lengths))) - at
            while run:
                m = min(run, 138)
                m = m if m >= 3 else 1
                steps.append((18, m - 11, 7) if m >= 11 else (17, m - 3, 3) if m >= 3 else (0, 0, 0))
                at, run = at + m, run - m
        else:
            steps.append((lengths[at], 0, 0))
            at += 1
    counts = [0] * 19
    for s, _, _ in steps:
        counts[s] += 1
    first = lengths_of(counts, 7)
    out.put(0, 1)
    n = max(4, 1 + max(k for k in range(19) if first[LENGTH_ORDER[k]]))
    out.put(n - 4, 4)
    for k in range(n):
        out.put(first[LENGTH_ORDER[k]], 3)
    out.put(0, 1)
    codes = codes_of(first)
    single = sum(map(bool, first)) == 1
    for s, extra, size in steps:
        out.put(codes[s], 0 if single else first[s])
        out.put(extra, size)
    return lengths if len(used) > 1 else [0] * len(lengths)


def put_value(value: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 1
    return 2 * n + ((v >> (n - 1)) & 1), v & ((1 << (n - 1)) - 1), n - 1


def put_grey(out: Out, green: np.ndarray) -> bytes:
    """The entropy-coded image of pixels that differ in green only; ends the stream."""
    same = np.flatnonzero(green[::-1] != green[-1])
    run = int(same[0]) if len(same) else len(green)
    plain = green[: len(green) - run + 1] if run > 8 else green
    left = len(green) - len(plain)
    copies = []
    while left:
        copies.append(put_value(min(left, 4096)))
        left -= min(left, 4096)
    counts = np.bincount(plain, minlength=280)
    for p, _, _ in copies:
        counts[256 + p] += 1
    lengths = put_prefix(out, lengths_of(counts.tolist(), 15))
    for symbol in (0, 0, 255, 1):  # red, blue, alpha, and the distance of the pixel before
        put_prefix(out, [int(s == symbol) for s in range(256 if symbol != 1 else 40)])
    codes = codes_of(lengths)
    code, size = np.array(codes, np.uint64)[plain], np.array(lengths, np.int64)[plain]
    at = out.n + np.cumsum(size) - size
    total = out.n + int(size.sum())
    word = np.zeros((total >> 5) + 3, np.uint64)
    moved = code << (at & 31).astype(np.uint64)
    place = at >> 5
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    word[place[first]] |= np.bitwise_or.reduceat(moved & np.uint64(0xFFFFFFFF), first)
    word[place[first] + 1] |= np.bitwise_or.reduceat(moved >> np.uint64(32), first)
    body = bytearray(word.astype("<u4").tobytes())
    for k, b in enumerate(out.bytes()):
        body[k] |= b
    tail = Out()
    tail.n = total & 7
    for p, extra, n in copies:
        tail.put(codes[256 + p], lengths[256 + p])
        tail.put(extra, n)
    end = tail.bytes()
    body[(total >> 3) + 1 :] = b""
    body += bytes(max(0, (total >> 3) + len(end) - len(body)))
    for k, b in enumerate(end):
        body[(total >> 3) + k] |= b
    return bytes(body)


def encode_grey(samples: np.ndarray) -> bytes:
    """A WebP file of (height, width) 8-bit samples."""
    height, width = samples.shape
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    levels = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    if len(levels) <= 16:
        out.put(1 | PALETTE << 1, 3)
        out.put(len(levels) - 1, 8)
        steps = np.diff(levels, prepend=0)
        out.put(0, 1)
        sizes = lengths_of(np.bincount(steps, minlength=280).tolist(), 15)
        alpha = [0] * 256
        alpha[255] = 1
        alpha[0] = int(len(levels) > 1)
        real = [put_prefix(out, s) for s in (sizes, sizes[:256], sizes[:256], alpha, [1] + [0] * 39)]
        codes = [codes_of(s) for s in real]
        for k, s in enumerate(steps.tolist()):
            for c, size, v in zip(codes, real, (s, s, s, 0 if k else 255)):
                out.put(c[v], size[v])
        packing = 3 if len(levels) <= 2 else 2 if len(levels) <= 4 else 1
        index = np.searchsorted(levels, samples)
        per, size = 1 << packing, 8 >> packing
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        green = (index << (np.arange(per) * size)).sum(2).ravel()
    else:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        green = samples.ravel().astype(np.int64)
    out.put(0, 3)  # no more transforms, no colour cache, one group of codes
    data = put_grey(out, green)
    pad = len(data) & 1
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(data) + pad, b"WEBP", b"VP8L", len(data)) + data + bytes(pad)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0), len(raw)


def store(payload: bytes) -> bytes:
    """The payload as rows of 576 samples; over 16,384 rows, as several files that follow each other."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(encode_grey(rows[k : k + MOST_ROWS]) for k in range(0, len(rows), MOST_ROWS))


def samples_of(media: bytes) -> np.ndarray:
    """(rows, 576) samples; all of a pixel's colours must agree."""
    argb = np.concatenate([decode_vp8l(x) for x in images(media)])
    grey = argb & np.uint32(255)
    if (argb != (grey * np.uint32(0x010101) | np.uint32(0xFF000000))).any():
        raise ValueError("not a grey image")
    return grey.astype(np.uint8)


def stored(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_bytes and media (WebP bytes) instead of the text. A null text counts as empty; that is one row of 255.

    Repeated rows are stored each for itself, equal texts as equal bytes; an empty table gives no rows. Other columns
    are kept, but one that is called n_bytes or media already is an error.
    """
    names = [c for c in docs.columns if c != text_col]
    clash = {"n_bytes", "media"} & {c.lower() for c in names}
    if clash:
        raise ValueError(f"columns that exist already: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            both = [payload_of(x) for x in part.column(text_col).to_pylist()]
            made = [pa.array([n for _, n in both], pa.int64()), pa.array([store(p) for p, _ in both], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=[*names, "n_bytes", "media"])

    kept = type(docs.schema)([f for f in docs.schema.fields if f.name != text_col])
    return docs.mapInArrow(run, kept.add("n_bytes", "long").add("media", "binary"))


IMAGE = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary())])


def decoded(media: DataFrame, media_col: str = "media", out_col: str = "images") -> DataFrame:
    """media with the pixel arrays of each file, or of several that follow each other, in out_col (a new column).

    Of an image: width, height, and argb row by row as little-endian unsigned 32-bit integers, any colours. Null
    has none (null); an empty value has no image; a damaged one raises.
    """
    names = media.columns
    if out_col.lower() in map(str.lower, names):
        raise ValueError(f"a column that exists already: {out_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16):
            rows = [None if x is None else [decode_vp8l(i) for i in images(x)] for x in part.column(names.index(media_col)).to_pylist()]
            made = [None if of is None else [{"width": x.shape[1], "height": x.shape[0], "argb": x.astype("<u4").tobytes()} for x in of] for of in rows]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(IMAGE))], names=[*names, out_col])

    image = T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("argb", T.BinaryType())
    return media.mapInArrow(run, T.StructType([*media.schema.fields]).add(out_col, T.ArrayType(image)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for doc, n, media in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
            s = samples_of(media)
            payload = s.tobytes()
            many = np.bincount(s.ravel(), minlength=256)
            total = int((many * np.arange(256)).sum())
            text = f"{s.shape[1]}x{s.shape[0]};mean={total / s.size:.4f};levels={int((many > 0).sum())};most={int(many.argmax())};edges={int((s[:, 1:] != s[:, :-1]).sum())}"
            for k, v in zip(rows, (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), text)):
                rows[k].append(v)
        yield batch_of(rows, doc_id=pa.int64(), n_bytes=pa.int64(), payload_bytes=pa.int64(), payload_sha256=pa.string(), tail_crc32=pa.int64(), media_bytes=pa.int64(), media_sha256=pa.string(), feature=pa.string())


def features(media: DataFrame) -> DataFrame:
    """Of each stored image, read back: its payload's and its own size and digest, and a line of image features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_webp(spark, sf_dir: str) -> DataFrame:
    """doc_id, sizes, digests and features of each document's text as stored and read back; null counts as empty, rows that share an id stand each for itself."""
    return features(stored(table(spark, sf_dir, "documents").select("doc_id", "text")))
