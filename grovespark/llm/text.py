"""Words and hashes of whole Arrow batches with numpy: no Python loop over words.

A word is ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes with A-Z in lower case. A word's 64-bit
hash is a polynomial over its bytes (random byte values, an odd base, modulo 2**64),
taken from prefix sums, and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
#: What separates words: ASCII white space; or whatever in ASCII is neither letter nor digit.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NO_LETTER = np.zeros(256, bool)
NO_LETTER[[i for i in range(128) if not chr(i).isalnum()]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Text bytes that are taken at once; a longer document is taken alone.
CHUNK_BYTES = 500_000


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.uint64(_BASE if kind == "up" else _INVERSE)
        size = max(n, 1 << 16)
        factors = np.full(size, step)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. offsets[0] is 0."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of some documents. hashes, starts and ends (byte positions in data) by word;
    first[i]:first[i + 1] are the words of document low + i. letters: Chinese and Japanese letters are words each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: int, space: np.ndarray = SPACE, letters: bool = False):
        self.low, self.data, self.offsets, n = low, data, offsets, len(data)
        word = ~space[data]
        breaks = np.zeros(n + 1, bool)
        breaks[offsets] = True
        if letters:  # U+3000 to U+9FFF take three bytes, U+20000 on take four
            for lead, size in ((np.flatnonzero((data >= 0xE3) & (data <= 0xE9)), 3), (np.flatnonzero((data[:-1] == 0xF0) & (data[1:] >= 0xA0)), 4)):
                breaks[lead] = True
                breaks[np.minimum(lead + size, n)] = True
        before = np.concatenate(([False], word[:-1])) if n else word
        after = np.concatenate((word[1:], [False])) if n else word
        self.starts = np.flatnonzero(word & (breaks[:n] | ~before))
        self.ends = np.flatnonzero(word & (breaks[1:] | ~after)) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", n)[:n], out=sums[1:])
        self._sums, self._down = sums, _power("down", n + 1)[self.starts]
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * self._down)
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def prefixes(self, k: int) -> np.ndarray:
        """Hashes of each word's first k bytes (of the whole word if it is shorter); none equals a word's hash but by chance."""
        ends = np.minimum(self.starts + k, self.ends)
        return mix(mix((self._sums[ends] - self._sums[self.starts]) * self._down) + np.uint64(k))

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes().lower()


def chunks(column: pa.Array, space: np.ndarray = SPACE, letters: bool = False) -> Iterator[Words]:
    """The documents of a column in runs of about CHUNK_BYTES; every text is whole."""
    data, offsets = string_parts(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        yield Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], low, space, letters)
        low = high


_SHINGLE = [np.uint64(int(x) | 1) for x in np.random.default_rng(7).integers(1, 1 << 62, 16)]


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row."""
    total = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        total += hashes[j : j + len(total)] * _SHINGLE[j % 16] + np.uint64(j // 16)
    return mix(total)


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted set of k-word shingles; the whole sequence if it has fewer words."""
    if len(hashes) == 0:
        return hashes[:0]
    if len(hashes) < k:
        return mix(rolling(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(rolling(hashes, k))
