"""Lossless WebP: store bytes as images and turn images into pixel arrays.

The decoder reads any still lossless stream: prefix codes (simple and coded lengths, several code
groups), back-references, colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. The encoder writes single-group streams, with cross-colour, predictor or palette and with
back-references and a colour cache where that is shorter; where no symbol repeats it gives each of
the four codes one length, which the decoder reads with array operations.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_PIXELS = 16
MAX_SIDE = 1 << 14
#: An image of more pixels is refused, so that a damaged header of a few bytes cannot fill the memory.
MAX_PIXELS = 1 << 24
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3

# Fixed values of the format: the order of code-length code lengths, and the (column, row) steps of short distances.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = """0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4
 4,1 -4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3
 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1
 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7
 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"""
NEAR_STEPS = [tuple(map(int, x.split(","))) for x in NEAR.split()]


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("image data ends early")
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + 6], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


class Code:
    """A canonical prefix code, given the length of each symbol's code (0: unused)."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("empty prefix code")
        self.symbols = used[np.argsort(lengths[used], kind="stable")]
        sizes = lengths[self.symbols]
        self.uniform = 0 if len(used) == 1 else int(sizes[0]) if sizes[0] == sizes[-1] else None
        self.sizes, self.table = sizes, None
        if len(used) > 1 and int(np.sum(1 << (15 - sizes))) != 1 << 15:
            raise ValueError("prefix code is not complete")

    def build(self) -> list[int]:
        """For the next bits, as many as the longest code has: its symbol times 16 plus the length of its code."""
        self.longest = int(self.sizes[-1])
        table = np.zeros(1 << self.longest, np.int64)
        code, last = 0, int(self.sizes[0])
        for symbol, size in zip(self.symbols.tolist(), self.sizes.tolist(), strict=True):
            code <<= size - last
            table[int(f"{code:0{size}b}"[::-1], 2) :: 1 << size] = symbol << 4 | size
            code, last = code + 1, size
        self.table = table.tolist()
        return self.table

    def read(self, bits: Bits) -> int:
        if self.uniform == 0:
            return int(self.symbols[0])
        table = self.table or self.build()
        at = bits.at
        found = table[(int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)) & ((1 << self.longest) - 1)]
        bits.at = at + (found & 15)
        if bits.at > 8 * len(bits.data):
            raise ValueError("image data ends early")
        return found >> 4


def uniform_ranks(bits: Bits, n: int, size: int) -> np.ndarray:
    """``n`` numbers of ``size`` bits, 8 at most, each written highest bit first."""
    if bits.at + n * size > 8 * len(bits.data):
        raise ValueError("image data ends early")
    flat = np.unpackbits(np.frombuffer(bits.data, np.uint8)[bits.at >> 3 : (bits.at + n * size + 7) >> 3], bitorder="little")
    rows = flat[bits.at & 7 : (bits.at & 7) + n * size].reshape(n, size)
    bits.at += n * size
    return rows[:, 0] if size == 1 else np.packbits(rows, axis=1)[:, 0] >> (8 - size)


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(max(alphabet, 256), int)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths[:alphabet])
    sizes = [0] * 19
    for symbol in LENGTH_ORDER[: 4 + bits.read(4)]:
        sizes[symbol] = bits.read(3)
    coder = Code(sizes)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    if left == alphabet and coder.uniform and coder.uniform <= 8 and coder.symbols[-1] < 16:
        return Code(coder.symbols[uniform_ranks(bits, alphabet, coder.uniform)])
    at, previous = 0, 8
    while at < alphabet and left:
        left -= 1
        size = coder.read(bits)
        if size < 16:
            lengths[at] = size
            previous, at = size or previous, at + 1
            continue
        run = 3 + bits.read(2) if size == 16 else 3 + bits.read(3) if size == 17 else 11 + bits.read(7)
        if at + run > alphabet:
            raise ValueError("code lengths run over the alphabet")
        lengths[at : at + run] = previous if size == 16 else 0
        at += run
    return Code(lengths[:alphabet])


def read_amount(bits: Bits, prefix: int) -> int:
    """A length or distance code from its prefix and the extra bits that follow."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_uniform(bits: Bits, codes: list[Code], pixels: int) -> np.ndarray:
    """Literal pixels whose green, red, blue and alpha codes have one length each."""
    sizes = [c.uniform for c in codes[:4]]
    total = sum(sizes)
    if bits.at + pixels * total > 8 * len(bits.data):
        raise ValueError("image data ends early")
    out = np.zeros((pixels, 4), np.uint8)
    first = bits.at >> 3
    flat = np.unpackbits(np.frombuffer(bits.data, np.uint8)[first : (bits.at + pixels * total + 7) >> 3], bitorder="little")
    rows = flat[bits.at & 7 : (bits.at & 7) + pixels * total].reshape(pixels, total)
    at = 0
    for code, size, channel in zip(codes, sizes, (1, 0, 2, 3), strict=False):
        rank = np.packbits(rows[:, at : at + size], axis=1)[:, 0] >> (8 - size) if size else np.zeros(pixels, np.uint8)
        out[:, channel] = code.symbols.astype(np.uint8)[rank]
        at += size
    bits.at += pixels * total
    return out


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """Entropy-coded pixels as an array (height, width, RGBA)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, group_of, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        group_of = read_image(bits, -(-width // (1 << shift)), -(-height // (1 << shift)))
        group_of = group_of[:, :, 0].astype(int) << 8 | group_of[:, :, 1]
        groups = int(group_of.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    pixels = width * height
    if groups == 1 and codes[0][0].symbols.max() < 256 and all(c.uniform is not None and c.uniform <= 8 for c in codes[0][:4]):
        return read_uniform(bits, codes[0], pixels).reshape(height, width, 4)
    out: list[tuple[int, int, int, int]] = []
    cache = [(0, 0, 0, 0)] * cache_size

    def emit(pixel):
        out.append(pixel)
        if cache_size:
            r, g, b, a = pixel
            cache[((a << 24 | r << 16 | g << 8 | b) * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while len(out) < pixels:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, distance = codes[int(group_of[y >> shift, x >> shift]) if group_of is not None else 0]
        symbol = green.read(bits)
        if symbol < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            emit((r, symbol, b, a))
        elif symbol < 280:
            run = read_amount(bits, symbol - 256)
            back = read_amount(bits, distance.read(bits))
            if back > 120:
                back -= 120
            else:
                dx, dy = NEAR_STEPS[back - 1]
                back = max(1, dx + dy * width)
            if back > len(out) or len(out) + run > pixels:
                raise ValueError("back-reference leaves the image")
            for _ in range(run):
                emit(out[-back])
        else:
            emit(cache[symbol - 280])
    return np.array(out, np.uint8).reshape(height, width, 4)


def undo_predictor(image: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Add to each pixel the prediction from its left, upper-left, upper and upper-right pixels."""
    height, width, _ = image.shape
    kinds = np.unique(modes)
    out = image.copy()
    out[:1, :1, 3] += np.uint8(255)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
    if len(kinds) == 1 and kinds[0] == 1:
        return np.cumsum(out, axis=1, dtype=np.uint8) if height == 1 else np.concatenate([out[:1], np.cumsum(out[1:], axis=1, dtype=np.uint8)])
    if len(kinds) == 1 and kinds[0] == 2:
        return np.concatenate([out[:, :1], np.cumsum(out[:, 1:], axis=0, dtype=np.uint8)], axis=1)
    grid = out.astype(int)
    for y in range(1, height):
        for x in range(1, width):
            left, up, corner = grid[y, x - 1], grid[y - 1, x], grid[y - 1, x - 1]
            right = grid[y - 1, x + 1] if x + 1 < width else grid[y, 0]
            mode = modes[y >> shift, x >> shift]
            if mode in (0, 14, 15):
                guess = np.array([0, 0, 0, 255])
            elif mode == 11:
                guess = left if np.abs(up - corner).sum() < np.abs(left - corner).sum() else up
            elif mode == 12:
                guess = np.clip(left + up - corner, 0, 255)
            elif mode == 13:
                mean = (left + up) // 2
                guess = np.clip(mean + np.trunc((mean - corner) / 2).astype(int), 0, 255)
            else:
                guess = {
                    1: left, 2: up, 3: right, 4: corner, 5: ((left + right) // 2 + up) // 2, 6: (left + corner) // 2,
                    7: (left + up) // 2, 8: (corner + up) // 2, 9: (up + right) // 2, 10: ((left + corner) // 2 + (up + right) // 2) // 2,
                }[int(mode)]
            grid[y, x] = (grid[y, x] + guess) & 255
    return grid.astype(np.uint8)


def undo_cross_colour(image: np.ndarray, elements: np.ndarray, shift: int) -> np.ndarray:
    height, width, _ = image.shape
    y, x = np.mgrid[:height, :width] >> shift
    signed = elements.astype(np.int8).astype(int)[y, x]
    out = image.astype(int)
    green = image[:, :, 1].astype(np.int8).astype(int)
    out[:, :, 0] = (out[:, :, 0] + (signed[:, :, 2] * green >> 5)) & 255
    red = out[:, :, 0].astype(np.uint8).astype(np.int8).astype(int)
    out[:, :, 2] = (out[:, :, 2] + (signed[:, :, 1] * green >> 5) + (signed[:, :, 0] * red >> 5)) & 255
    return out.astype(np.uint8)


def undo_palette(image: np.ndarray, palette: np.ndarray, width: int, shift: int) -> np.ndarray:
    """Colours of the indices that each green value packs, 2 ** shift of them, lowest bits first."""
    each = 8 >> shift
    x = np.arange(width)
    index = image[:, x >> shift, 1].astype(int) >> ((x & ((1 << shift) - 1)) * each) & ((1 << each) - 1)
    colours = np.zeros((256, 4), np.uint8)
    colours[: len(palette)] = palette
    return colours[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    """RGBA pixels of one lossless stream; ValueError if it is damaged."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if width * height > MAX_PIXELS:
        raise ValueError("image too large")
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, coded = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("transform given twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            table = read_image(bits, -(-coded // (1 << shift)), -(-height // (1 << shift)))
            if kind == PREDICTOR:
                undo.append(lambda im, t=table[:, :, 1] & 15, s=shift: undo_predictor(im, t, s))
            else:
                undo.append(lambda im, t=table, s=shift: undo_cross_colour(im, t, s))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda im: im + im[:, :, 1:2] * np.array([1, 0, 1, 0], np.uint8))
        else:
            size = bits.read(8) + 1
            palette = np.cumsum(read_image(bits, size, 1)[0], axis=0, dtype=np.uint8)
            shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append(lambda im, p=palette, w=coded, s=shift: undo_palette(im, p, w, s))
            coded = -(-coded // (1 << shift))
    image = read_image(bits, coded, height, main=True)
    for step in reversed(undo):
        image = step(image)
    return image


def read_webp(media: bytes) -> list[np.ndarray]:
    """Pixels of each of the lossless WebP files that stand one after another in ``media``."""
    images, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        whole, size = struct.unpack_from("<I", media, at + 4)[0], struct.unpack_from("<I", media, at + 16)[0]
        images.append(decode_vp8l(media[at + 20 : at + 20 + size]))
        at += 8 + whole
    return images


def pack_bits(*fields: tuple[int, int]) -> np.ndarray:
    """Bits, lowest first, of (value, width) fields."""
    return np.concatenate([(np.uint64(v) >> np.arange(n, dtype=np.uint64) & np.uint64(1)).astype(np.uint8) for v, n in fields])


CHANNELS = np.arange(4)
ONE_ZERO = pack_bits((1, 1), (0, 1), (0, 1), (0, 1))


@functools.cache
def uniform_header(size: int) -> np.ndarray:
    """The bits before the code lengths, where each is 0 or ``size`` and takes one bit."""
    coders = LENGTH_ORDER.index(size) + 1
    return pack_bits((0, 1), (coders - 4, 4), *[(int(x in (0, size)), 3) for x in LENGTH_ORDER[:coders]], (0, 1))


def uniform_code(has: np.ndarray, alphabet: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Length, each symbol's rank and the header bits of a code of one length that holds all values marked in ``has``."""
    used = int(has.sum())
    size = (used - 1).bit_length()
    if not size:
        return 0, np.zeros(256, np.uint8), pack_bits((1, 1), (0, 1), (1, 1), (int(has.argmax()), 8))
    has = has.copy()
    has[np.flatnonzero(~has)[: (1 << size) - used]] = True
    lengths = np.zeros(alphabet, np.uint8)
    lengths[:256] = has
    return size, (np.cumsum(has) - 1).astype(np.uint8), np.concatenate([uniform_header(size), lengths])


class BitsOut:
    """Bits written lowest first."""

    def __init__(self):
        self.data, self.held, self.n = bytearray(), 0, 0

    def put(self, value: int, size: int) -> None:
        self.held |= value << self.n
        self.n += size
        if self.n >= 64:
            whole = self.n >> 3
            self.data += (self.held & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.held >>= 8 * whole
            self.n -= 8 * whole

    def bits(self) -> np.ndarray:
        whole = bytes(self.data) + self.held.to_bytes((self.n + 7) // 8, "little")
        return np.unpackbits(np.frombuffer(whole, np.uint8), bitorder="little")[: 8 * len(self.data) + self.n]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code, ``most`` bits at most, for symbols with the given counts."""
    counts = np.asarray(counts, np.int64)
    while True:
        heap = [(int(c), i, (i,)) for i, c in enumerate(counts) if c]
        lengths = np.zeros(len(counts), np.int64)
        heapq.heapify(heap)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
        while len(heap) > 1:
            (c, i, x), (d, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            lengths[list(x + y)] += 1
            heapq.heappush(heap, (c + d, i, x + y))
        if lengths.max(initial=0) <= most:
            return lengths
        counts = np.where(counts, counts // 2 + 1, 0)  # flatter counts, flatter code


def codewords(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """(bits with the first to write lowest, length) of each symbol; a single symbol takes no bits."""
    used = sorted((int(n), int(s)) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    found, code, last = {}, 0, used[0][0] if used else 0
    for n, s in used:
        code <<= n - last
        found[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return found


def put_code(out: BitsOut, counts: np.ndarray) -> dict[int, tuple[int, int]]:
    """Write the prefix code for these counts; returns its codewords."""
    used = np.flatnonzero(counts).tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        for value, size in [(1, 1), (len(used) - 1, 1), (1, 1), *[(s, 8) for s in used]]:
            out.put(value, size)
        lengths = np.zeros(len(counts), np.int64)
        lengths[used] = 1
        return codewords(lengths)
    lengths = code_lengths(counts, 15)
    runs, at = [], 0
    while at < len(lengths):
        zeros = 0
        while at + zeros < len(lengths) and not lengths[at + zeros] and zeros < 138:
            zeros += 1
        if zeros >= 3:
            runs.append((17, zeros - 3, 3) if zeros <= 10 else (18, zeros - 11, 7))
            at += zeros
        else:
            runs.append((int(lengths[at]), 0, 0))
            at += 1
    sizes = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    listed = max(4, 1 + max(i for i, x in enumerate(LENGTH_ORDER) if sizes[x]))
    for value, size in [(0, 1), (listed - 4, 4), *[(int(sizes[x]), 3) for x in LENGTH_ORDER[:listed]], (0, 1)]:
        out.put(value, size)
    words = codewords(sizes)
    for symbol, extra, size in runs:
        out.put(*words[symbol])
        out.put(extra, size)
    return codewords(lengths)


def amount_prefix(amount: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number for a length or distance code, as ``read_amount`` reads them."""
    x = amount - 1
    if x < 4:
        return x, 0, 0
    high = x.bit_length() - 1
    return 2 * high + (x >> (high - 1) & 1), x & ((1 << (high - 1)) - 1), high - 1


@functools.cache
def near_codes(width: int) -> dict[int, int]:
    found: dict[int, int] = {}
    for i, (dx, dy) in enumerate(NEAR_STEPS):
        found.setdefault(max(1, dx + dy * width), i + 1)
    return found


def tokens_of(colours: list[int], width: int, cache_bits: int) -> list[tuple]:
    """Literals (colour,), cache places (place, None) and copies (length, distance code, back) that spell the colours, greedily."""
    seen: dict[tuple[int, int], int] = {}
    cache: dict[int, int] = {}
    found, at, n, near = [], 0, len(colours), near_codes(width)
    shift = 32 - cache_bits
    while at < n:
        back, run = 0, 0
        if at + 1 < n and (start := seen.get((colours[at], colours[at + 1]))) is not None:
            back, run = at - start, 2
            while run < 4096 and at + run < n and colours[at + run] == colours[at + run - back]:
                run += 1
        step = run if run > 2 else 1
        place = (colours[at] * 0x1E35A7BD & 0xFFFFFFFF) >> shift
        found.append((run, near.get(back, back + 120), back) if step > 1 else (place, None) if cache.get(place) == colours[at] else (colours[at],))
        for i in range(at, at + step):
            cache[(colours[i] * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = colours[i]
            if i + 1 < n:
                seen[colours[i], colours[i + 1]] = i
        at += step
    return found


def repeated_stream(flat: np.ndarray, width: int, cache_bits: int = 7) -> np.ndarray:
    """Bits of an entropy-coded image with back-references and a colour cache, from the cache's size on."""
    wide = flat.astype(np.int64)
    found = tokens_of((wide[:, 3] << 24 | wide[:, 0] << 16 | wide[:, 1] << 8 | wide[:, 2]).tolist(), width, cache_bits)
    coded, symbols, extras, sizes = [], [], [], []  # of each symbol: its code, itself, its extra bits and their number
    for t in found:
        if len(t) == 1:
            c = t[0]
            coded += (0, 1, 2, 3)
            symbols += (c >> 8 & 255, c >> 16 & 255, c & 255, c >> 24)
            extras += (0, 0, 0, 0)
            sizes += (0, 0, 0, 0)
        elif len(t) == 2:
            coded.append(0)
            symbols.append(280 + t[0])
            extras.append(0)
            sizes.append(0)
        else:
            (length, x, m), (distance, y, k) = amount_prefix(t[0]), amount_prefix(t[1])
            coded += (0, 4)
            symbols += (256 + length, distance)
            extras += (x, y)
            sizes += (m, k)
    code, symbol = np.array(coded, np.int64), np.array(symbols, np.int64)
    out = BitsOut()
    for value, size in ((1, 1), (cache_bits, 4), (0, 1)):
        out.put(value, size)
    words = np.zeros((5, 280 + (1 << cache_bits), 2), np.int64)
    for i, alphabet in enumerate((280 + (1 << cache_bits), 256, 256, 256, 40)):
        for s, word in put_code(out, np.bincount(symbol[code == i], minlength=alphabet)).items():
            words[i, s] = word
    value, size = words[code, symbol].T
    value, size = value | np.array(extras, np.int64) << size, size + np.array(sizes, np.int64)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.concatenate([out.bits(), (np.repeat(value, size) >> at & 1).astype(np.uint8)])


def uniform_stream(flat: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Bits of an entropy-coded image whose four codes have one length each."""
    codes = [uniform_code(has[channel], 280 if channel == 1 else 256) for channel in (1, 0, 2, 3)]
    symbols = [np.unpackbits(rank[flat[:, channel]][:, None], axis=1)[:, 8 - size :] for (size, rank, _), channel in zip(codes, (1, 0, 2, 3), strict=True) if size]
    return np.concatenate([pack_bits((0, 2)), *[c[2] for c in codes], ONE_ZERO, *([np.concatenate(symbols, axis=1).reshape(-1)] if symbols else [])])


def one_value(value: int) -> np.ndarray:
    return pack_bits((1, 1), (0, 1), (1, 1), (value, 8))


def predicted(image: np.ndarray, mode: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The predictor transform's bits and the image less its prediction, from the left (1) or from above (2)."""
    out = image.copy()
    if mode == 1:
        out[1:, 0] -= image[:-1, 0]
        out[:, 1:] -= image[:, :-1]
    else:
        out[1:] -= image[:-1]
        out[0, 1:] -= image[0, :-1]
    out[:1, :1, 3] += np.uint8(1)  # less the 255 that the first pixel is predicted as
    return [pack_bits((1, 1), (PREDICTOR, 2), (7, 3), (0, 1)), one_value(mode), ONE_ZERO, ONE_ZERO, ONE_ZERO, ONE_ZERO], out


def crossed(image: np.ndarray) -> tuple[list[np.ndarray], np.ndarray] | None:
    """The cross-colour transform's bits and result where red or blue follow green closely; else None."""
    green, red, blue = (image[:, :, c].astype(np.int8).astype(int) for c in (1, 0, 2))
    spread = int((green * green).sum())
    if not spread:
        return None
    slopes = [int(np.clip(round(32 * float((green * x).sum()) / spread), -128, 127)) for x in (red, blue)]
    left = [x - (k * green >> 5) for x, k in zip((red, blue), slopes, strict=True)]
    if 4 * sum(int((x * x).sum()) for x in left) > int((red * red).sum() + (blue * blue).sum()):
        return None
    out = image.copy()
    out[:, :, 0], out[:, :, 2] = (x & 255 for x in left)
    return [pack_bits((1, 1), (CROSS_COLOUR, 2), (7, 3), (0, 1)), one_value(slopes[1] & 255), one_value(0), one_value(slopes[0] & 255), one_value(0), ONE_ZERO], out


def indexed(flat: np.ndarray, height: int, width: int) -> tuple[list[np.ndarray], np.ndarray] | None:
    """The palette transform's bits and the image of packed indices, for at most 256 colours; else None."""
    colours, index = np.unique(np.ascontiguousarray(flat).view("<u4")[:, 0], return_inverse=True)
    if len(colours) > 256:
        return None
    palette = colours.view(np.uint8).reshape(-1, 4)
    steps = np.diff(palette, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    shift = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    grid = np.zeros((height, -(-width // (1 << shift)) << shift), np.uint16)
    grid[:, :width] = index.reshape(height, width)
    packed = (grid.reshape(height, -1, 1 << shift) << (np.arange(1 << shift) * (8 >> shift)).astype(np.uint16)).sum(2).astype(np.uint8)
    out = np.zeros((*packed.shape, 4), np.uint8)
    out[:, :, 1] = packed
    has = np.zeros((4, 256), bool)
    has[CHANNELS, steps] = True
    # The palette is an image of its own, without the bit that the main image has for code groups.
    header = np.concatenate([pack_bits((0, 1)), uniform_stream(steps, has)[2:]])
    return [pack_bits((1, 1), (PALETTE, 2), (len(colours) - 1, 8)), header], out


def write_webp(pixels: np.ndarray) -> bytes:
    """A lossless WebP file of RGBA pixels: the shortest of the streams that are tried.

    Each image is tried as it is and predicted from the left or from above, after the cross-colour
    transform where red or blue follow green; and, where three quarters of its colours are repeats,
    with a palette if it has few colours, and with back-references and a colour cache, of the
    palette's indices or else of the colours.
    """
    height, width, _ = pixels.shape
    flat = pixels.reshape(-1, 4)
    linked = crossed(pixels)
    before, image = linked or ([], pixels)
    plain: list[tuple] = []
    for parts, made in ((before, image), *((before + p, m) for p, m in (predicted(image, mode) for mode in (1, 2)))):
        has = np.zeros((4, 256), bool)
        has[CHANNELS, made.reshape(-1, 4)] = True
        plain.append((sum((int(n) - 1).bit_length() for n in has.sum(1)), parts, made.reshape(-1, 4), has))
    _, parts, made, has = min(plain, key=lambda x: x[0])
    streams = [[*parts, pack_bits((0, 1)), uniform_stream(made, has)]]
    if 4 * len(np.unique(np.ascontiguousarray(flat).view("<u4"))) <= len(flat):
        palette = indexed(flat, height, width)
        table, index = palette or ([], pixels)
        streams.append([*table, pack_bits((0, 1)), repeated_stream(index.reshape(-1, 4), index.shape[1])])
        if palette:
            has = np.zeros((4, 256), bool)
            has[CHANNELS, index.reshape(-1, 4)] = True
            streams.append([*table, pack_bits((0, 1)), uniform_stream(index.reshape(-1, 4), has)])
    best = min((np.concatenate(x) for x in streams), key=len)
    data = np.packbits(np.concatenate([pack_bits((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)), best]), bitorder="little").tobytes()
    padded = data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + padded


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % 64 or 64 * (not data))


def encode_payload(payload: bytes) -> bytes:
    """Images of 16 pixels a row, four bytes a pixel, 16384 rows at most in each."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, 4)
    return b"".join(write_webp(pixels[at : at + MAX_SIDE]) for at in range(0, len(pixels), MAX_SIDE))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, zero-padded to a multiple of 64, as lossless WebP.

    Null and empty texts give 64 zero bytes. Long texts give several images, one after another.
    Equal texts give equal media. Only doc_id and text are read; an empty table gives no rows.
    """

    def encode(batches):
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts], "media": [encode_payload(payload_of(x)) for x in texts]})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(encode, f"doc_id {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """Adds pixels (RGBA bytes of all images, row by row), width, height and a feature string.

    The feature is eight relative frequencies of sample values (32 values each) and their mean.
    A null or damaged medium gives null in the added columns. Input columns of these names are
    replaced; all others stay as they are.
    """
    added = ("pixels", "width", "height", "feature")
    media = media.drop(*added)

    def decode(batches):
        for batch in batches:
            rows = []
            for data in batch["media"]:
                try:
                    images = read_webp(bytes(data))
                    samples = np.concatenate([im.reshape(-1) for im in images])
                    shares = np.bincount(samples >> 5, minlength=8) / len(samples)
                    feature = ",".join(f"{x:.4f}" for x in shares) + f";{samples.mean():.4f}"
                    rows.append((samples.tobytes(), images[0].shape[1], sum(len(im) for im in images), feature))
                except (ValueError, TypeError, struct.error):
                    rows.append((None, None, None, None))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=list(added), dtype=object)], axis=1)

    schema = ", ".join([f"`{c}` {k}" for c, k in media.dtypes] + ["pixels binary, width int, height int, feature string"])
    return media.mapInPandas(decode, schema)


def op10_lossless_webp(spark, sf_dir: str) -> DataFrame:
    found = decode_media(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
