"""An encoder of lossless WebP that uses every feature the decoder has to undo; for tests."""

from collections import Counter

import numpy as np

from grovespark.llm import webp as W


def code_lengths(counts, alphabet, longest=15):
    """Lengths of a complete prefix code: the two rarest are joined; counts are flattened until none is too long."""
    used = {s: n for s, n in counts.items() if n}
    if len(used) < 2:
        return [int(s in used) for s in range(alphabet)]
    while True:
        heap = [(n, [s]) for s, n in sorted(used.items())]
        lengths = dict.fromkeys(used, 0)
        while len(heap) > 1:
            heap.sort(key=lambda x: x[0])
            (a, x), (b, y) = heap[:2]
            for s in x + y:
                lengths[s] += 1
            heap = [*heap[2:], (a + b, x + y)]
        if max(lengths.values()) <= longest:
            return [lengths.get(s, 0) for s in range(alphabet)]
        used = {s: n // 2 + 1 for s, n in used.items()}


class Table:
    def __init__(self, lengths):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.codes, code, last = {}, 0, 0
        for n, s in used:
            code <<= n - last
            last = n
            self.codes[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
            code += 1
        if len(used) == 1:
            self.codes = {used[0][1]: (0, 0)}

    def put(self, out, s):
        out.put(*self.codes[s])


def put_code(out, counts, alphabet):
    lengths = code_lengths(counts, alphabet)
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        out.put(1, 1)
        used = used or [0]
        out.put(len(used) - 1, 1)
        wide = int(used[0] > 1)
        out.put(wide, 1)
        out.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return Table(lengths if len(used) > 1 else [int(s == used[0]) for s in range(alphabet)])
    out.put(0, 1)
    row, at = [], 0  # (symbol, extra value, extra bits)
    while at < alphabet:
        n = 1
        while at + n < alphabet and lengths[at + n] == lengths[at]:
            n += 1
        if lengths[at] == 0 and n >= 11:
            n = min(n, 138)
            row.append((18, n - 11, 7))
        elif lengths[at] == 0 and n >= 3:
            row.append((17, n - 3, 3))
        else:
            row.append((lengths[at], 0, 0))
            n -= 1
            if lengths[at] and n >= 3:
                n = min(n, 6)
                row.append((16, n - 3, 2))
                n += 1
            else:
                n = 1
        at += n
    meta = code_lengths(Counter(s for s, _, _ in row), 19, 7)
    last = max(k for k, s in enumerate(W._LENGTH_CODE_ORDER) if meta[s])
    count = max(4, last + 1)
    out.put(count - 4, 4)
    for s in W._LENGTH_CODE_ORDER[:count]:
        out.put(meta[s], 3)
    out.put(0, 1)
    table = Table(meta)
    for s, value, bits in row:
        table.put(out, s)
        out.put(value, bits)
    return Table(lengths)


def prefix(value):
    """(symbol, extra bits, their value) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, top - 1, v & ((1 << (top - 1)) - 1)


def tokens(pixels, cache, lz):
    """('pixel', argb), ('cache', index) or ('copy', length, distance)."""
    table, last, at, out = {}, {}, 0, []
    shift = 32 - cache

    def remember(p):
        if cache:
            table[(p * W._HASH & 0xFFFFFFFF) >> shift] = p

    n = len(pixels)
    while at < n:
        key = tuple(pixels[at : at + 3])
        back = last.get(key) if lz and len(key) == 3 else None
        if back is not None:
            k = 0
            while at + k < n and k < 4096 and pixels[back + k] == pixels[at + k]:
                k += 1
            out.append(("copy", k, at - back))
            for p in range(at, at + k):
                remember(pixels[p])
                last[tuple(pixels[p : p + 3])] = p
            at += k
            continue
        p = pixels[at]
        index = (p * W._HASH & 0xFFFFFFFF) >> shift if cache else None
        out.append(("cache", index) if cache and table.get(index) == p else ("pixel", p))
        remember(p)
        last[key] = at
        at += 1
    return out


def put_image(out, argb, width, main, cache=0, lz=False, groups=False):
    pixels = [int(p) for p in argb]
    out.put(int(cache > 0), 1)
    if cache:
        out.put(cache, 4)
    of, across, tile = None, 0, 2
    height = len(pixels) // width
    if main:
        out.put(int(groups), 1)
        if groups:
            out.put(tile - 2, 3)
            across, down = (width + 3) >> 2, (height + 3) >> 2
            of = [(k * 7) % 3 for k in range(across * down)]
            put_image(out, np.array([g << 8 for g in of], np.uint32), across, False)
    row = tokens(pixels, cache, lz)
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    counts = [[Counter() for _ in sizes] for _ in range(max(of) + 1 if of else 1)]

    def group(at):
        return of[(at // width >> tile) * across + (at % width >> tile)] if of else 0

    plane = {d: k + 1 for k, d in reversed(list(enumerate(W._DISTANCES)))}

    def distance_code(d):
        for dy in range(8):
            dx = d - dy * width
            if (dx, dy) in plane:
                return plane[dx, dy]
        return d + 120

    def walk(f):
        at = 0
        for t in row:
            f(group(at), t)
            at += t[1] if t[0] == "copy" else 1

    def count(g, t):
        c = counts[g]
        if t[0] == "pixel":
            for k, s in enumerate((8, 16, 0, 24)):
                c[k][t[1] >> s & 255] += 1
        elif t[0] == "cache":
            c[0][280 + t[1]] += 1
        else:
            c[0][256 + prefix(t[1])[0]] += 1
            c[4][prefix(distance_code(t[2]))[0]] += 1

    walk(count)
    tables = [[put_code(out, c, n) for c, n in zip(cs, sizes, strict=True)] for cs in counts]

    def write(g, t):
        c = tables[g]
        if t[0] == "pixel":
            for k, s in enumerate((8, 16, 0, 24)):
                c[k].put(out, t[1] >> s & 255)
        elif t[0] == "cache":
            c[0].put(out, 280 + t[1])
        else:
            for table, base, value in ((c[0], 256, t[1]), (c[4], 0, distance_code(t[2]))):
                s, bits, extra = prefix(value)
                table.put(out, base + s)
                out.put(extra, bits)

    walk(write)


def encode(picture, cache=0, lz=False, groups=False, green=False, cross=False, predictor=False, palette=False):
    """picture: (height, width, 4) of red, green, blue, alpha."""
    height, width = picture.shape[:2]
    out = W.BitWriter()
    W._header(out, width, height)
    p = picture.reshape(-1, 4).astype(np.uint32)
    argb = p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]
    inner = width
    tile = 2
    across, down = (width + 3) >> 2, (height + 3) >> 2
    if palette:
        colours = np.unique(argb)
        index = np.searchsorted(colours, argb).reshape(height, width)
        out.put(1, 1)
        out.put(3, 2)
        out.put(len(colours) - 1, 8)
        c = W._channels(colours)
        put_image(out, W._joined(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int32))), len(colours), False)
        shared = W.palette_bits(len(colours))
        inner = (width + (1 << shared) - 1) >> shared
        packed = np.zeros((height, inner), np.uint32)
        for x in range(width):
            packed[:, x >> shared] |= (index[:, x] << ((x & ((1 << shared) - 1)) * (8 >> shared))).astype(np.uint32)
        argb = (packed << 8 | np.uint32(0xFF000000)).ravel()
    if predictor:
        kinds = np.arange(across * down) % 14
        out.put(1, 1)
        out.put(0, 2)
        out.put(tile - 2, 3)
        put_image(out, (kinds << 8).astype(np.uint32), across, False)
        rows = W._channels(argb).reshape(height, width, 4).tolist()
        rest = []
        for y in range(height):
            for x in range(width):
                forced, *near = W.neighbours(rows, x, y, width)
                mode = int(kinds[(y >> tile) * across + (x >> tile)]) if forced is None else forced
                rest.append([(a - b) & 255 for a, b in zip(rows[y][x], W.predicted(mode, *near), strict=True)])
        argb = W._joined(np.array(rest, np.int32))
    if cross:
        g = np.random.default_rng(5)
        factors = g.integers(0, 1 << 24, across * down, dtype=np.uint32) | np.uint32(0xFF000000)
        out.put(1, 1)
        out.put(1, 2)
        out.put(tile - 2, 3)
        put_image(out, factors, across, False)
        argb = W.cross_colour(argb, width, height, tile, factors, -1)
    if green:
        out.put(1, 1)
        out.put(2, 2)
        argb = W.subtract_green(argb, -1)
    out.put(0, 1)
    put_image(out, argb, inner, True, cache, lz, groups)
    return W._riff(out.bytes())
