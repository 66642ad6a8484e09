"""Lossless WebP (VP8L) images in pure Python and numpy: a decoder, and an encoder to store bytes.

The decoder reads RIFF containers and the VP8L bit stream: simple and normal prefix codes (canonical,
with run-length coded lengths), meta prefix codes, LZ77 back-references with the two-dimensional
distance map, the colour cache, and the inverses of the predictor, cross-colour, subtract-green and
palette transforms. It writes arrays (height, width, 4) of red, green, blue, alpha. Symbols are read one by one; where
one code tells the pixels (those of red, blue and alpha take no bits, and there is no cache), what a symbol would be is looked
up at every bit at once, and only the step from symbol to symbol is a loop. Inverses of transforms go over whole arrays, the
predictor's pixel by pixel.

The encoder stores bytes as a grey image, a sample a pixel: subtract-green leaves the green channel alone; back-references go
to the last place with the same LEAST samples; prefix codes are fitted to the image's symbols.

ValueError says what is wrong with damaged data; nothing is guessed.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

# Fixed values of the published VP8L format.
_SIGNATURE = 0x2F
_LENGTH_CODE_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
_HASH = 0x1E35A7BD
# fmt: off
_DISTANCES = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
# fmt: on
LARGEST_SIDE = 1 << 14
#: Of a prefix code; of those that the encoder makes.
LONGEST, LONGEST_MADE = 15, 10


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        low = self.at >> 3
        return int.from_bytes(self.data[low : low + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return value


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol (in the order of the stream) of a canonical code, for symbols sorted by (length, symbol)."""
    size = np.int64(1) << (LONGEST - lengths)
    return _REVERSED[np.cumsum(size) - size]


def _mirror() -> np.ndarray:
    x, out = np.arange(1 << LONGEST), np.zeros(1 << LONGEST, np.int64)
    for k in range(LONGEST):
        out |= (x >> k & 1) << (LONGEST - 1 - k)
    return out


_REVERSED = _mirror()


class Code:
    """A canonical prefix code from the lengths of its symbols. table[next bits & mask] is symbol << 4 | length."""

    def __init__(self, lengths: tuple[int, ...]):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.only = used[0][1] if len(used) == 1 else None if used else 0
        self.width = self.mask = 0
        if self.only is not None:  # takes no bits
            self.table = [self.only << 4]
            return
        # over the full width
        if sum(1 << (LONGEST - n) for n, _ in used) != 1 << LONGEST:
            raise ValueError("a prefix code isn't complete")
        self.width = used[-1][0]
        size = 1 << self.width
        self.mask, self.table = size - 1, [0] * size
        for (n, s), code in zip(used, reversed_codes(np.array([n for n, _ in used])).tolist(), strict=True):
            if n == self.width:
                self.table[code] = s << 4 | n
            else:
                self.table[code :: 1 << n] = [s << 4 | n] * (size >> n)

    def next(self, bits: Bits) -> int:
        entry = self.table[bits.peek(self.width)]
        bits.at += entry & 15
        if bits.at > bits.end:
            raise ValueError("the image ends early")
        return entry >> 4


#: Images of one writer share their codes.
_code = lru_cache(256)(Code)


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        for s in symbols:
            if s >= alphabet:
                raise ValueError("a symbol is outside its alphabet")
            lengths[s] = 1
        return _code(tuple(lengths))
    meta = [0] * 19
    for k in _LENGTH_CODE_ORDER[: 4 + bits.read(4)]:
        meta[k] = bits.read(3)
    code, left = _code(tuple(meta)), alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, previous, table, mask = 0, 8, code.table, code.mask
    if code.only is not None and code.only < 16:  # every length takes no bits
        at = min(left, alphabet)
        lengths[:at] = [code.only] * at
        left = 0
    data, place = bits.data, (bits.at >> 3) + 24
    window, have = int.from_bytes(data[place - 24 : place], "little") >> (bits.at & 7), 192 - (bits.at & 7)
    while at < alphabet and left:
        if have < 24:
            window |= int.from_bytes(data[place : place + 24], "little") << have
            place += 24
            have += 192
        left -= 1
        entry = table[window & mask]
        window >>= entry & 15
        have -= entry & 15
        symbol = entry >> 4
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            previous = symbol or previous
            continue
        n, least = (2, 3) if symbol == 16 else (3, 3) if symbol == 17 else (7, 11)
        times = least + (window & ((1 << n) - 1))
        window >>= n
        have -= n
        if at + times > alphabet:
            raise ValueError("a run of code lengths is too long")
        if symbol == 16:
            lengths[at : at + times] = [previous] * times
        at += times
    bits.at = 8 * place - have
    if bits.at > bits.end:
        raise ValueError("the image ends early")
    return _code(tuple(lengths))


def _near(code: int, width: int) -> int:
    """The distance of one of the 120 codes of pixels close by."""
    dx, dy = _DISTANCES[code - 1]
    return max(1, dx + dy * width)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as uint32 ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, meta, tile = 1, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        meta = (_image(bits, across, (height + (1 << tile) - 1) >> tile, False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    return _pixels(bits, codes, meta, tile, width, width * height, cache_bits)


def _pixels(bits: Bits, codes: list[list[Code]], meta: list[int] | None, tile: int, width: int, total: int, cache_bits: int) -> np.ndarray:
    """All symbols of an image. meta: the group of codes of each tile."""
    across = (width + (1 << tile) - 1) >> tile
    # tables and masks of each group; literals whose other channels take no bits are whole pixels at once
    groups = []
    for green, red, blue, alpha, distance in codes:
        flat = None
        if red.only is not None and blue.only is not None and alpha.only is not None:
            flat = [alpha.only << 24 | red.only << 16 | g << 8 | blue.only for g in range(256)]
        groups.append((green.table, green.mask, flat, red.table, red.mask, blue.table, blue.mask, alpha.table, alpha.mask, distance.table, distance.mask))
    green, g_mask, flat, red, r_mask, blue, b_mask, alpha, a_mask, distance, d_mask = groups[0]
    if flat is not None and meta is None and not cache_bits:
        return _green(bits, codes[0][0], codes[0][4], width, total).astype(np.uint32) << np.uint32(8) | np.uint32(flat[0])
    cache, shift, kept = [0] * (1 << cache_bits), 32 - cache_bits, 0
    out, at, number = array("I"), 0, int.from_bytes
    put, extend = out.append, out.extend
    data, size = bits.data, len(bits.data)
    place = (bits.at >> 3) + 24
    window, have = number(data[place - 24 : place], "little") >> (bits.at & 7), 192 - (bits.at & 7)
    while at < total:
        if have < 64:  # the longest symbol with what follows it takes 60 bits
            if place >= size + 24:
                raise ValueError("the image ends early")
            window |= number(data[place : place + 24], "little") << have
            place += 24
            have += 192
        if meta is not None:
            green, g_mask, flat, red, r_mask, blue, b_mask, alpha, a_mask, distance, d_mask = groups[meta[(at // width >> tile) * across + (at % width >> tile)]]
        entry = green[window & g_mask]
        window >>= entry & 15
        have -= entry & 15
        symbol = entry >> 4
        if symbol < 256:
            if flat is not None:
                put(flat[symbol])
            else:
                r = red[window & r_mask]
                window >>= r & 15
                b = blue[window & b_mask]
                window >>= b & 15
                a = alpha[window & a_mask]
                window >>= a & 15
                have -= (r & 15) + (b & 15) + (a & 15)
                put(a >> 4 << 24 | r >> 4 << 16 | symbol << 8 | b >> 4)
            at += 1
        elif symbol < 280:
            n = symbol - 255
            if n > 4:
                more = (symbol - 258) >> 1
                n = ((2 + (symbol & 1)) << more) + (window & ((1 << more) - 1)) + 1
                window >>= more
                have -= more
            entry = distance[window & d_mask]
            window >>= entry & 15
            have -= entry & 15
            symbol = entry >> 4
            back = symbol + 1
            if symbol > 3:
                more = (symbol - 2) >> 1
                back = ((2 + (symbol & 1)) << more) + (window & ((1 << more) - 1)) + 1
                window >>= more
                have -= more
            back = back - 120 if back > 120 else _near(back, width)
            if back > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            if back >= n:
                extend(out[at - back : at - back + n])
            else:
                extend((out[at - back :] * (n // back + 1))[:n])
            at += n
        else:
            if symbol - 280 >= len(cache):
                raise ValueError("a symbol is outside the colour cache")
            for pixel in out[kept:]:
                cache[(pixel * _HASH & 0xFFFFFFFF) >> shift] = pixel
            kept = at
            put(cache[symbol - 280])
            at += 1
    bits.at = 8 * place - have
    if bits.at > bits.end:
        raise ValueError("the image ends early")
    return np.frombuffer(out, np.uint32)


#: Bytes of the stream that are looked up at once.
SEGMENT = 1 << 16


def _green(bits: Bits, green: Code, distance: Code, width: int, total: int) -> np.ndarray:
    """The green samples of an image whose pixels differ in nothing else, as uint8."""
    if green.only is not None:
        if green.only > 255:
            raise ValueError("a back-reference leaves the image")
        return np.full(total, green.only, np.uint8)
    raw = np.frombuffer(bits.data, np.uint8)
    g_table, d_table = np.array(green.table, np.int32), np.array(distance.table, np.int32)
    at, made, found = bits.at, 0, []
    while made < total:
        low = at >> 3
        if low >= len(raw):
            raise ValueError("the image ends early")
        part = np.concatenate((raw[low : low + SEGMENT + 16], np.zeros(16, np.uint8))).astype(np.uint32)
        word = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        end = 8 * min(SEGMENT, len(raw) - low)

        def take(place, many, word=word):
            return (word[place >> 3] >> (place & 7).astype(np.uint32)).astype(np.int64) & ((1 << many) - 1)

        window = (word[: end >> 3, None] >> np.arange(8, dtype=np.uint32)).ravel()
        entry = g_table[window & np.uint32(green.mask)]
        step = entry & 15
        # back-references: a length and a distance, each with the bits that follow its symbol
        there = np.flatnonzero(entry >= 256 << 4)
        place, numbers = there + step[there], []
        for symbol in ((entry[there] >> 4).astype(np.int64) - 256, None):
            if symbol is None:
                code = d_table[take(place, distance.width)]
                place, symbol = place + (code & 15), (code >> 4).astype(np.int64)
            more = np.where(symbol > 3, (symbol - 2) >> 1, 0)
            numbers.append(np.where(symbol > 3, ((2 + (symbol & 1)) << more) + take(place, more) + 1, symbol + 1))
            place = place + more
        step[there] = place - there
        steps, mark, here = step.astype(np.uint8).tobytes(), bytearray(end), at & 7
        while here < end:
            mark[here] = 1
            here += steps[here]
        tokens = np.flatnonzero(np.frombuffer(mark, np.uint8))
        symbols, counts, back = entry[tokens] >> 4, np.ones(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        far = np.flatnonzero(symbols > 255)
        which = np.searchsorted(there, tokens[far])
        counts[far], back[far] = numbers[0][which], numbers[1][which]
        ends = made + np.cumsum(counts)
        last = int(np.searchsorted(ends, total))
        if last < len(tokens):
            if ends[last] != total:
                raise ValueError("a back-reference leaves the image")
            here = int(tokens[last] + step[tokens[last]])
            symbols, counts, back, ends = symbols[: last + 1], counts[: last + 1], back[: last + 1], ends[: last + 1]
        found.append((symbols, counts, back))
        made, at = int(ends[-1]), 8 * low + here
    bits.at = at
    if at > bits.end:
        raise ValueError("the image ends early")
    symbols, counts, back = (np.concatenate(x) for x in zip(*found, strict=True))
    start = np.cumsum(counts) - counts
    plain = symbols < 256
    samples = np.zeros(total, np.uint8)
    samples[start[plain]] = symbols[plain]
    out = bytearray(samples.tobytes())
    for a, n, d in zip(start[~plain].tolist(), counts[~plain].tolist(), back[~plain].tolist(), strict=True):
        d = d - 120 if d > 120 else _near(d, width)
        if d > a:
            raise ValueError("a back-reference leaves the image")
        out[a : a + n] = out[a - d : a - d + n] if d >= n else (out[a - d : a] * (n // d + 1))[:n]
    return np.frombuffer(out, np.uint8)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(n, 4) of alpha, red, green, blue as int32."""
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[:, 0] << 24 | c[:, 1] << 16 | c[:, 2] << 8 | c[:, 3]


def predicted(mode: int, left, top, corner, right) -> list[int]:
    """One pixel's prediction; arguments are (alpha, red, green, blue)."""
    average = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return average(average(left, right), top)
    if mode == 6:
        return average(left, corner)
    if mode == 7:
        return average(left, top)
    if mode == 8:
        return average(corner, top)
    if mode == 9:
        return average(top, right)
    if mode == 10:
        return average(average(left, corner), average(top, right))
    if mode == 11:
        away_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        away_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if away_left < away_top else top
    clamp = lambda x: min(255, max(0, x))
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        mean = average(left, top)
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]
    return [255, 0, 0, 0]


def neighbours(rows, x: int, y: int, width: int):
    """(mode forced at the border or None, left, top, corner, right) of a pixel."""
    left = rows[y][x - 1] if x else None
    if y == 0:
        return (1 if x else 0), left, None, None, None
    top = rows[y - 1][x]
    if x == 0:
        return 2, None, top, None, None
    return None, left, top, rows[y - 1][x - 1], rows[y - 1][x + 1] if x + 1 < width else rows[y][0]


def _inverse_predictor(argb: np.ndarray, width: int, height: int, tile: int, modes: np.ndarray) -> np.ndarray:
    rows = _channels(argb).reshape(height, width, 4).tolist()
    across = (width + (1 << tile) - 1) >> tile
    kinds = (modes >> 8 & 15).tolist()
    for y in range(height):
        for x in range(width):
            forced, *near = neighbours(rows, x, y, width)
            mode = kinds[(y >> tile) * across + (x >> tile)] if forced is None else forced
            rows[y][x] = [(a + b) & 255 for a, b in zip(rows[y][x], predicted(mode, *near), strict=True)]
    return _joined(np.array(rows, np.int32).reshape(-1, 4))


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int32) + 128) % 256 - 128


def cross_colour(argb: np.ndarray, width: int, height: int, tile: int, factors: np.ndarray, sign: int) -> np.ndarray:
    """Add (sign 1: decode) or take away (-1: encode) what green and red predict of red and blue."""
    c = _channels(argb)
    across = (width + (1 << tile) - 1) >> tile
    y, x = np.divmod(np.arange(width * height), width)
    f = _channels(factors)[(y >> tile) * across + (x >> tile)]
    delta = lambda t, v: (_signed(t) * _signed(v)) >> 5
    red = c[:, 1] + sign * delta(f[:, 3], c[:, 2])
    original_red = red & 255 if sign > 0 else c[:, 1]
    blue = c[:, 3] + sign * (delta(f[:, 2], c[:, 2]) + delta(f[:, 1], original_red))
    return _joined(np.stack([c[:, 0], red, c[:, 2], blue], axis=1))


def subtract_green(argb: np.ndarray, sign: int) -> np.ndarray:
    """Take green away from red and blue (sign -1: encode), or add it (1: decode)."""
    green = argb >> np.uint32(8) & np.uint32(255)
    both = argb & np.uint32(0x00FF00FF)
    both = both + (green << np.uint32(16) | green) if sign > 0 else (both | np.uint32(0x01000100)) - (green << np.uint32(16) | green)
    return argb & np.uint32(0xFF00FF00) | both & np.uint32(0x00FF00FF)


def palette_bits(colours: int) -> int:
    """The power of two of pixels that share one, with so many colours."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _inverse_palette(argb: np.ndarray, packed: int, width: int, height: int, shared: int, table: np.ndarray) -> np.ndarray:
    green = (argb >> np.uint32(8) & np.uint32(255)).reshape(height, packed)
    each = 8 >> shared
    x = np.arange(width)
    index = green[:, x >> shared] >> ((x & ((1 << shared) - 1)) * each).astype(np.uint32) & np.uint32((1 << each) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index].ravel()


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: (height, width, 4) of red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("no lossless WebP file")
    n = int.from_bytes(data[16:20], "little")
    if len(data) < 20 + n:
        raise ValueError("the image ends early")
    bits = Bits(data[20 : 20 + n])
    if bits.read(8) != _SIGNATURE:
        raise ValueError("no lossless WebP image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in {k[0] for k in undo}:
            raise ValueError("a transform is there twice")
        if kind < 2:
            tile = bits.read(3) + 2
            across, down = (inner + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            undo.append((kind, inner, tile, _image(bits, across, down, False)))
        elif kind == 2:
            undo.append((kind, inner, 0, None))
        else:
            colours = bits.read(8) + 1
            c = _channels(_image(bits, colours, 1, False))
            undo.append((kind, inner, palette_bits(colours), _joined(np.cumsum(c, axis=0))))
            inner = (inner + (1 << palette_bits(colours)) - 1) >> palette_bits(colours)
    argb = _image(bits, inner, height, True)
    for kind, wide, tile, extra in reversed(undo):
        if kind == 0:
            argb = _inverse_predictor(argb, wide, height, tile, extra)
        elif kind == 1:
            argb = cross_colour(argb, wide, height, tile, extra, 1)
        elif kind == 2:
            argb = subtract_green(argb, 1)
        else:
            argb = _inverse_palette(argb, inner, wide, height, tile, extra)
            inner = wide
    stored, out = argb.astype("<u4").view(np.uint8).reshape(height, width, 4), np.empty((height, width, 4), np.uint8)
    for channel, place in enumerate((2, 1, 0, 3)):
        out[..., channel] = stored[..., place]
    return out


class BitWriter:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def _riff(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + pad
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _header(out: BitWriter, width: int, height: int, alpha: bool = True) -> None:
    out.put(_SIGNATURE, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(alpha), 1)
    out.put(0, 3)


#: The code that the encoder writes lengths of codes with: its own lengths, by symbol 0 to 18.
_META = [4, 7, 6, 6, 5, 4, 3, 3, 3, 4, 5, 5, 6, 6, 7, 7, 7, 3, 3]
#: Samples that a back-reference has at least and at most; its largest distance.
LEAST, MOST, FARTHEST = 8, 4096, (1 << 20) - 120


def _coded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols used, their bits) of a canonical code with these lengths (0: not used)."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    return used, reversed_codes(lengths[used])


def _meta_bits() -> list[int]:
    out = np.zeros(len(_META), np.int64)
    used, bits = _coded(np.array(_META))
    out[used] = bits
    return out.tolist()


_META_BITS = _meta_bits()


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths, LONGEST_MADE at most, of a complete code for symbols with these counts (two of them or more aren't 0)."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    weight = counts[used].astype(np.float64)
    weight = np.maximum(weight, weight.sum() / (1 << (LONGEST_MADE - 1)))
    lengths = np.maximum(1, np.ceil(np.log2(weight.sum() / weight))).astype(np.int64)
    left = (1 << LONGEST_MADE) - int((np.int64(1) << (LONGEST_MADE - lengths)).sum())
    by, lengths = np.argsort(-weight, kind="stable").tolist(), lengths.tolist()
    while left:  # shorten frequent symbols as long as there is room: it always ends in a complete code
        for k in by:
            cost = 1 << (LONGEST_MADE - lengths[k])
            if cost <= left and lengths[k] > 1:
                lengths[k] -= 1
                left -= cost
    out[used] = lengths
    return out


def _put_code(out: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a code for symbols with these counts; (bits, lengths) by symbol."""
    bits, lengths = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2 and (not len(used) or used[0] < 256):  # it takes no bits
        symbol = int(used[0]) if len(used) else 0
        out.put(1, 2)
        out.put(int(symbol > 1), 1)
        out.put(symbol, 8 if symbol > 1 else 1)
        return bits, lengths
    lengths = code_lengths(counts)
    order, codes = _coded(lengths)
    bits[order] = codes
    out.put(0, 1)
    out.put(15, 4)
    for k in _LENGTH_CODE_ORDER:
        out.put(_META[k], 3)
    out.put(0, 1)
    at = 0
    for symbol, n in zip([*used.tolist(), len(counts)], [*lengths[used].tolist(), None], strict=True):
        gap = symbol - at
        while gap:
            run = min(gap, 138)
            kind = 18 if run > 10 else 17 if run > 2 else 0
            run = run if kind else 1
            out.put(_META_BITS[kind], _META[kind])
            if kind:
                out.put(run - (11 if kind == 18 else 3), 7 if kind == 18 else 3)
            gap -= run
        if n is not None:
            out.put(_META_BITS[n], _META[n])
        at = symbol + 1
    return bits, lengths


def _matches(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of back-references, from left to right: to the last place with the same LEAST samples,
    for as long as that distance holds."""
    n = len(samples) - LEAST + 1
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    key = np.ndarray((n,), "<u8", samples, 0, (1,))  # LEAST samples from each place on, as one number
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    distance = np.zeros(n, np.int64)
    distance[order[same + 1]] = order[same + 1] - order[same]
    distance[distance > FARTHEST] = 0
    first = np.concatenate(([0], np.flatnonzero(distance[1:] != distance[:-1]) + 1))
    stop, back = np.append(first[1:], n), distance[first]
    there = back > 0
    at, out = 0, []
    for a, b, d in zip(first[there].tolist(), stop[there].tolist(), back[there].tolist(), strict=True):
        if a < at:
            if b <= at:
                continue
            a = at
        at = b + LEAST - 1
        while at - a > MOST:
            out.append((a, MOST, d))
            a += MOST
        if at - a >= LEAST:
            out.append((a, at - a, d))
        else:
            at = a
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, how many) of lengths or distances."""
    below = values - 1
    high = np.maximum(np.frexp(below)[1].astype(np.int64) - 1, 1)
    large = values > 4
    more = np.where(large, high - 1, 0)
    return np.where(large, 2 * high + (below >> more & 1), below), np.where(large, below & ((1 << more) - 1), 0), more


def bytes_to_webp(payload: bytes) -> bytes:
    """A grey image whose samples are the payload, in rows of 64 up to 1 MiB and of more beyond; zeros fill the last row.
    Its length is positive. ValueError beyond 256 MiB, which is the largest image."""
    width = 64
    while width * LARGEST_SIDE < len(payload):
        width *= 2
    if width > LARGEST_SIDE:
        raise ValueError("an image holds 256 MiB at most")
    height = -(-len(payload) // width)
    samples = np.frombuffer(payload + bytes(width * height - len(payload)), np.uint8)
    start, length, back = _matches(samples)
    covered = np.zeros(len(samples) + 1, np.int8)
    covered[start] += 1
    covered[start + length] -= 1
    literal = np.flatnonzero(np.cumsum(covered[:-1], dtype=np.int8) == 0)
    values = samples[literal].astype(np.int64)
    (n_symbol, n_extra, n_more), (d_symbol, d_extra, d_more) = _prefixed(length), _prefixed(back + 120)

    out = BitWriter()
    _header(out, width, height, alpha=False)
    out.put(0b0101, 4)  # subtract-green, and no other transform
    out.put(0, 2)  # no cache, one group
    green, green_n = _put_code(out, np.bincount(values, minlength=280) + np.bincount(n_symbol + 256, minlength=280))
    out.put(0b0001, 4)  # red and blue are 0 after subtract-green
    out.put(0b0001, 4)
    out.put(0b101, 3)  # alpha is 255
    out.put(255, 8)
    distance, distance_n = _put_code(out, np.bincount(d_symbol, minlength=40))

    # all symbols in a row: (bits, how many)
    at = np.searchsorted(literal, start) + np.arange(len(start))
    bits, count = np.zeros(len(literal) + len(start), np.uint64), np.zeros(len(literal) + len(start), np.int64)
    plain = np.ones(len(bits), bool)
    plain[at] = False
    bits[plain], count[plain] = green[values].astype(np.uint64), green_n[values]
    one = green_n[n_symbol + 256]
    two = one + n_more
    three = two + distance_n[d_symbol]
    bits[at] = (green[n_symbol + 256] | n_extra << one | distance[d_symbol] << two | d_extra << three).astype(np.uint64)
    count[at] = three + d_more
    ends = out.n + np.cumsum(count)
    place = ends - count
    total = int(ends[-1])
    words = np.zeros(total // 64 + 2, np.uint64)
    word, skip = place >> 6, (place & 63).astype(np.uint64)
    np.bitwise_or.at(words, word, bits << skip)
    np.bitwise_or.at(words, word + 1, np.where(skip > 0, bits >> (np.uint64(64) - np.maximum(skip, np.uint64(1))), np.uint64(0)))
    head = out.bytes()
    body = words.astype("<u8").view(np.uint8)
    body[: len(head)] |= np.frombuffer(head, np.uint8)
    return _riff(body[: (total + 7) // 8].tobytes())


def webp_to_bytes(data: bytes, n: int) -> bytes:
    """The first n samples of an image of bytes_to_webp()."""
    return decode(data)[..., 1].tobytes()[:n]
