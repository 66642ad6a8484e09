"""A class-based bigram model: Brown classes by exchange clustering, over all training documents.

P(word | words before) = P(class | class before) * P(word | its class). Documents whose
crc32(id as text) mod 10 isn't 0 are trained on; words are those of llm.text, then one end for each document.

1. Documents are coded once, in chunks: a chunk's distinct words (64-bit hashes), how often each occurs in training
   documents, and its texts as numbers of these words. That table is all that later steps read.
2. Counts of all words: chunks send their words' counts to ranges of hashes, which add them up. Nothing is
   cut off: the vocabulary is every training word, in as many ranges as it takes.
3. Seed. Units are the most frequent words and ENDINGS groups of all others, by a word's last two bytes; how many words and
   classes there are grows with the vocabulary (seed_size). Chunks count pairs of units in a row. Exchange clustering on the
   driver: each unit in turn moves to the class where the likelihood of the class bigrams is largest, until a sweep moves
   none (SWEEPS at most).
4. Words. Every other word begins in its group's class and moves by itself, in PASSES distributed passes: chunks send how often
   each class stands before and after a word to the word's range, which adds them up and moves each word to its best
   class, the others taken as they are. Chunks then look up the new classes (and counts) by range. Words move at the same
   time, so the likelihood is measured after each pass, and a pass that doesn't raise it is undone and is the last.
5. Documents are scored in the chunks. Words that training documents don't have are in their group's class.

A null or empty text has just its end. A null id counts as the empty text for the fold (held out); rows with the same id are
documents each. Without training documents (or any) the counts are 0 and scores follow from smoothing alone; an empty table
gives an empty one. Columns other than the id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.llm.shared import drop_table, shuffle_partitions, texts, write_table
from grovespark.llm.text import Words, chunks

#: Least number of frequent words in the seed; groups of the others; least number of classes besides the end's; sweeps; passes over all other words.
TOP, ENDINGS, CLASSES, SWEEPS, PASSES = 767, 256, 47, 8, 2
#: Added to each count.
ALPHA = 0.1
#: Numbers in one array of a move, about.
CELLS = 2_000_000
#: Text bytes of a chunk, about.
CHUNK = 10_000_000
_CHUNKS = pa.schema([("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("endings", pa.binary()), ("codes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))])
_CHUNKS_SQL = "chunk long, hashes binary, counts binary, endings binary, codes binary, doc_ids array<long>, lengths array<long>, held array<boolean>"


def seed_size(types: int) -> tuple[int, int]:
    """Frequent words and classes of a vocabulary: its 4th root times 31, and its power by 0.3."""
    return max(TOP, int(31 * types**0.25)), max(CLASSES, int(types**0.3))


def _pack(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if len(x) else b"")


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def _endings(part: Words, at: np.ndarray) -> np.ndarray:
    """The group of words by their last two bytes (in lower case)."""
    lower = part.data[part.ends[at] - 1].astype(np.uint64)
    second = part.data[np.maximum(part.ends[at] - 2, part.starts[at])].astype(np.uint64)
    lower, second = (np.where((x >= 65) & (x <= 90), x + np.uint64(32), x) for x in (lower, second))
    return ((second * np.uint64(131) + lower) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint16) % ENDINGS


class _Chunk:
    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids, self.lengths, self.held, self.size = [], [], [], 0

    def add(self, part: Words, ids: list[int | None]) -> None:
        hashes, at, codes = np.unique(part.hashes, return_index=True, return_inverse=True)
        held = [held_out(i) for i in ids]
        lengths = np.diff(part.first)
        train = ~np.repeat(np.array(held, bool), lengths)
        self.parts.append((hashes, np.bincount(codes[train], minlength=len(hashes)), _endings(part, at), codes.astype(np.uint32)))
        self.ids += ids
        self.lengths += lengths.tolist()
        self.held += held
        self.size += len(part.data)

    def row(self, number: int) -> pa.RecordBatch:
        hashes, first, place = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
        counts = np.bincount(place, np.concatenate([p[1] for p in self.parts]), len(hashes)).astype(np.uint32)
        endings = np.concatenate([p[2] for p in self.parts])[first]
        codes, low = [], 0
        for p in self.parts:
            codes.append(place[low : low + len(p[0])].astype(np.uint32)[p[3]])
            low += len(p[0])
        values = [number, hashes.tobytes(), counts.tobytes(), endings.astype(np.uint16).tobytes(), _pack(np.concatenate(codes)), self.ids, self.lengths, self.held]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _CHUNKS, strict=True)], schema=_CHUNKS)


def code(docs: DataFrame) -> DataFrame:
    """docs in chunks; written at once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for part in chunks(batch.column("text")):
                now.add(part, ids[part.low : part.low + len(part)])
                if now.size >= CHUNK:
                    yield now.row(number)
                    number, now = number + 1, _Chunk()
        if now.ids:
            yield now.row(number)

    return write_table(texts(docs).mapInArrow(encode, _CHUNKS_SQL), "chunks")


def _ranges(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes by their first bits."""
    cuts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, first, place = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]).astype(np.float64), len(hashes)).astype(np.int64)
    return hashes, counts, np.concatenate([p[2] for p in parts])[first]


def vocabulary(coded: DataFrame, bits: int) -> DataFrame:
    """(bucket, hashes, counts, endings): every training word with its count, by range of hashes; written."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, c, e in zip(*(batch.column(k).to_pylist() for k in ("hashes", "counts", "endings")), strict=True):
                hashes, counts, endings = np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32), np.frombuffer(e, np.uint16)
                kept = counts > 0
                hashes, counts, endings = hashes[kept], counts[kept], endings[kept]
                rows += [(k, hashes[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes(), endings[a:b].tobytes()) for k, a, b in _ranges(hashes, bits)]
            yield _rows(rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0

        def done() -> pa.RecordBatch:
            hashes, counts, endings = _merged(parts)
            return _rows([(now, hashes.tobytes(), counts.tobytes(), endings.tobytes())])

        for batch in batches:
            for b, h, c, e in zip(*(batch.column(k).to_pylist() for k in ("bucket", "hashes", "counts", "endings")), strict=True):
                if now is not None and b != now:
                    yield done()
                    parts, size = [], 0
                now = b
                parts.append((np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64), np.frombuffer(e, np.uint16)))
                size += len(parts[-1][0])
                if size > 2_000_000 and len(parts) > 1:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
        if now is not None:
            yield done()

    schema = "bucket int, hashes binary, counts binary, endings binary"
    sent = coded.select("hashes", "counts", "endings").mapInArrow(send, schema)
    ordered = sent.repartition(shuffle_partitions(coded.sparkSession), "bucket").sortWithinPartitions("bucket")
    return write_table(ordered.mapInArrow(add, schema), "vocabulary", release=True)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)], ["bucket", "hashes", "counts", "endings"])


def _frequent(words: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, so many at most, sorted by hash, with their counts."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                hashes, counts = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                first = np.lexsort((hashes, -counts))[:slots]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(counts[first])], ["hash", "n"])

    rows = words.select("hashes", "counts").mapInArrow(best, "hash long, n long").orderBy(F.desc("n"), "hash").limit(slots).collect()
    hashes, counts = np.array([r["hash"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _distinct(words: DataFrame, top: np.ndarray, slots: int) -> tuple[np.ndarray, int, int]:
    """Distinct training words by unit (frequent words: 1 each), their number, and their occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = np.zeros(ENDINGS, np.int64), 0
        for batch in batches:
            for h, c, e in zip(*(batch.column(k).to_pylist() for k in ("hashes", "counts", "endings")), strict=True):
                total += np.bincount(np.frombuffer(e, np.uint16)[~_among(np.frombuffer(h, np.uint64), top)[1]], minlength=ENDINGS)
                tokens += int(np.frombuffer(c, np.int64).sum())
        yield pa.RecordBatch.from_arrays([pa.array([*range(ENDINGS), ENDINGS]), pa.array([*total.tolist(), tokens])], ["ending", "n"])

    rows = words.mapInArrow(count, "ending long, n long").groupBy("ending").agg(F.sum("n").alias("n")).collect()
    by = {r["ending"]: r["n"] for r in rows}
    distinct = np.array([1] * len(top) + [0] * (slots - len(top)) + [by.get(k, 0) for k in range(ENDINGS)] + [0], np.int64)
    return distinct, int(distinct.sum()), int(by.get(ENDINGS, 0))


def _among(hashes: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(top):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(top, hashes), len(top) - 1)
    return at, top[at] == hashes


def units_of(hashes: np.ndarray, endings: np.ndarray, top: np.ndarray, slots: int) -> np.ndarray:
    """The unit of each word: its place among frequent words, or slots + its ending. The end is slots + ENDINGS."""
    at, hit = _among(hashes, top)
    return np.where(hit, at, slots + endings.astype(np.int64))


def _in_rows(units: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Units (or classes) of documents in a row, with an end after each (and so before the next)."""
    return np.insert(units, np.cumsum(lengths), end)


def unit_pairs(coded: DataFrame, top: np.ndarray, slots: int) -> np.ndarray:
    """How often units follow each other in training documents; a document begins after an end."""
    n, blocks = slots + ENDINGS + 1, 64
    shared = coded.sparkSession.sparkContext.broadcast(top)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for h, e, c, lengths, held in zip(*(batch.column(k).to_pylist() for k in ("hashes", "endings", "codes", "lengths", "held")), strict=True):
                lengths, train = np.array(lengths, np.int64), ~np.array(held, bool)
                units = units_of(np.frombuffer(h, np.uint64), np.frombuffer(e, np.uint16), shared.value, slots)[_unpack(c, np.uint32)]
                row = _in_rows(units[np.repeat(train, lengths)], lengths[train], n - 1)
                before = np.concatenate(([n - 1], row[:-1]))[: len(row)]
                total += np.bincount(before * n + row, minlength=n * n)
        # a task sends the pairs that it met
        rows = [(block, _pack(cell.astype(np.uint32)), _pack(part[cell])) for block, part in enumerate(np.array_split(total, blocks)) for cell in (np.flatnonzero(part),) if len(cell)]
        yield _batch(rows, "block cells n", [pa.int32(), pa.binary(), pa.binary()])

    sizes = [len(p) for p in np.array_split(np.zeros(n * n, np.int8), blocks)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, counts in zip(*(batch.column(x).to_pylist() for x in ("block", "cells", "n")), strict=True):
                total = totals.setdefault(block, np.zeros(sizes[block], np.int64))
                total[_unpack(cells, np.uint32)] += _unpack(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["block", "n"])

    rows = coded.select("hashes", "endings", "codes", "lengths", "held").mapInArrow(count, "block int, cells binary, n binary").repartition(min(blocks, shuffle_partitions(coded.sparkSession)), "block").mapInArrow(add, "block int, n binary").collect()
    out = [np.zeros(size, np.int64) for size in sizes]
    for r in rows:
        out[r["block"]] = np.frombuffer(r["n"], np.int64)
    return np.concatenate(out).reshape(n, n)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit; the last unit (the end) has the class `classes` to itself.
    Units begin spread over the classes by frequency; each move maximises the sum of N log N over class pairs
    less that over classes, which is the bigram likelihood but for a constant."""
    n = len(pairs)
    total = pairs.sum(1) + pairs.sum(0)
    order = [u for u in np.argsort(-total, kind="stable").tolist() if u != n - 1 and total[u] > 0]
    of = np.zeros(n, np.int64)
    of[order] = np.arange(len(order)) % classes
    of[n - 1] = classes
    hot = np.zeros((n, classes + 1), np.float64)
    hot[np.arange(n), of] = 1
    hot[total == 0] = 0
    pairs = pairs.astype(np.float64)
    right, left = pairs @ hot, pairs.T @ hot  # a unit's followers and predecessors by class
    grid = hot.T @ right

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, own = int(of[u]), pairs[u, u]
            out, into = right[u].copy(), left[u].copy()
            out[a] -= own
            into[a] -= own
            # the grid without u
            grid[a] -= out
            grid[:, a] -= into
            grid[a, a] -= own
            rows, columns = grid.sum(1), grid.sum(0)
            gain = (f(grid + out[None]) - f(grid)).sum(1) + (f(grid + into[:, None]) - f(grid)).sum(0)
            c = np.arange(classes + 1)
            d = grid[c, c]
            gain += f(d + out[c] + into[c] + own) - f(d) - (f(d + out[c]) - f(d)) - (f(d + into[c]) - f(d))
            away, come = out.sum() + own, into.sum() + own
            gain -= f(rows + away) - f(rows) + f(columns + come) - f(columns)
            gain[classes] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += out
            grid[:, b] += into
            grid[b, b] += own
            if b != a:
                moved += 1
                of[u] = b
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[:, a] -= pairs[u]
                left[:, b] += pairs[u]
        if not moved:
            break
    return of


@dataclass
class BrownModel:
    top: np.ndarray
    slots: int  # units of frequent words
    of: np.ndarray  # class by unit
    grid: np.ndarray  # how often classes follow each other
    follow: np.ndarray  # log10 P(class | class before)
    tokens: np.ndarray  # training tokens by class
    types: np.ndarray  # distinct training words by class
    n: int  # all training tokens
    v: int  # distinct training tokens, the end among them
    ends: int  # training documents

    def seed_classes(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        return self.of[units_of(hashes, endings, self.top, self.slots)]

    def log_words(self, hashes: np.ndarray, endings: np.ndarray, counts: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, log10 P(word | class), base log10 P(word)) of words with training counts; without classes, by the seed's."""
        classes = self.seed_classes(hashes, endings) if classes is None else classes
        own = np.log10((counts + ALPHA) / (self.tokens[classes] + ALPHA * (self.types[classes] + 1)))
        return classes, own, np.log10((counts + ALPHA) / (self.n + ALPHA * (self.v + 1)))


def _follow(grid: np.ndarray) -> np.ndarray:
    return np.log10((grid + ALPHA) / (grid.sum(1, keepdims=True) + ALPHA * len(grid)))


def learn(coded: DataFrame, words: DataFrame) -> BrownModel:
    """The seed's model: every word in the class of its unit."""
    slots, classes = seed_size(words.select(F.coalesce(F.sum(F.octet_length("hashes") / 8), F.lit(0)).cast("long").alias("n")).first()["n"])
    top, _ = _frequent(words, slots)
    distinct, types, tokens = _distinct(words, top, slots)
    pairs = unit_pairs(coded, top, slots)
    of = exchange(pairs, classes)
    k = classes + 1
    grid = np.zeros((k, k))
    np.add.at(grid, (of[:, None], of[None, :]), pairs)
    ends = int(pairs[:, -1].sum())
    return BrownModel(top, slots, of, grid, _follow(grid), np.bincount(of, pairs.sum(0), k), np.bincount(of, distinct, k), tokens + ends, types + (ends > 0), ends)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(grid: np.ndarray) -> float:
    """The bigram likelihood but for a constant."""
    return float(_f(grid).sum() - _f(grid.sum(1)).sum() - _f(grid.sum(0)).sum())


def best_classes(classes: np.ndarray, word: np.ndarray, key: np.ndarray, n: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class of each word where the likelihood is largest if it moves alone. Its neighbours are (word, key, n), sorted by
    word: key c is class c after it, k + c class c before it, 2 k the word itself (k classes, the end's last)."""
    k, out = len(grid), classes.copy()
    f_grid, diagonal = _f(grid), np.arange(k)
    first = np.searchsorted(word, np.arange(len(classes) + 1))
    low = 0
    while low < len(classes):
        high = max(low + 1, int(np.searchsorted(first, first[low] + CELLS // k, "right")) - 1)
        high = min(high, low + max(1, CELLS // k), len(classes))
        here = slice(first[low], first[high])
        w, c, m, now = word[here] - low, key[here], n[here].astype(np.float64), classes[low:high]
        size, at = high - low, np.arange(high - low)
        own = np.bincount(w[c == 2 * k], m[c == 2 * k], size)
        sides = []
        for lowest in (0, k):
            x = (c >= lowest) & (c < lowest + k)
            dense = np.zeros((size, k))
            dense[w[x], c[x] - lowest] = m[x]
            sides.append((w[x], c[x] - lowest, m[x], dense))
        gain = np.zeros((size, k))
        for (sw, sc, sm, _), other, table, f_table in ((sides[0], sides[1][3], grid.T, f_grid.T), (sides[1], sides[0][3], grid, f_grid)):
            if not len(sw):
                continue
            # the grid without the word differs in its own class alone: there in each place, and in the column of it
            cells = table[sc]
            base = f_table[sc]
            mine, entry = now[sw], np.arange(len(sw))
            same = np.flatnonzero(sc == mine)
            cells[entry, mine] -= sm
            cells[same] -= other[sw[same]]
            cells[same, mine[same]] -= own[sw[same]]
            base[entry, mine] = _f(cells[entry, mine])
            base[same] = _f(cells[same])
            term = _f(cells + sm[:, None]) - base
            starts = np.flatnonzero(np.concatenate(([True], sw[1:] != sw[:-1])))
            gain[sw[starts]] += np.add.reduceat(term, starts)
        after, before = sides[0][3], sides[1][3]
        d = np.repeat(grid[diagonal, diagonal][None], size, 0)
        d[at, now] -= after[at, now] + before[at, now] + own
        gain += _f(d + after + before + own[:, None]) + _f(d) - _f(d + after) - _f(d + before)
        for totals, dense in ((grid.sum(1), after), (grid.sum(0), before)):
            weight = dense.sum(1) + own
            left = np.repeat(totals[None], size, 0)
            left[at, now] -= weight
            gain -= _f(left + weight[:, None]) - _f(left)
        gain[:, -1] = -np.inf
        to = np.argmax(gain, 1)
        better = gain[at, to] > gain[at, now] + 1e-9
        out[low:high] = np.where(better, to, now)
        low = high
    return out


_LABELS_SQL = "chunk long, hashes binary, endings binary, known binary, classes binary, codes binary, doc_ids array<long>, lengths array<long>, held array<boolean>"
_ASSIGNED_SQL = "bucket int, hashes binary, counts binary, classes binary"


def _batch(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names.split())


def label(coded: DataFrame, assigned: DataFrame, model: BrownModel, bits: int) -> DataFrame:
    """coded (or labels) with training count and class of every word; written."""
    spark = coded.sparkSession
    n, shared = shuffle_partitions(spark), spark.sparkContext.broadcast(model)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, chunk, hashes[a:b].tobytes()) for chunk, h in zip(batch.column("chunk").to_pylist(), batch.column("hashes").to_pylist(), strict=True) for hashes in (np.frombuffer(h, np.uint64),) for k, a, b in _ranges(hashes, bits)]
            yield _batch(rows, "bucket chunk hashes", [pa.int32(), pa.int64(), pa.binary()])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, counts, of = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        for batch in batches:
            rows = []
            for b, chunk, h, c, o in zip(*(batch.column(k).to_pylist() for k in ("bucket", "chunk", "hashes", "counts", "classes")), strict=True):
                hashes = np.frombuffer(h, np.uint64)
                if chunk is None:  # the range's words come first
                    now, known, counts, of = b, hashes, np.frombuffer(c, np.int64), np.frombuffer(o, np.uint16)
                    continue
                found, classes = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.uint16)
                if now == b and len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    hit = known[at] == hashes
                    found, classes = np.where(hit, counts[at], 0), np.where(hit, of[at], 0).astype(np.uint16)
                rows.append((chunk, b, _pack(found), _pack(classes)))
            yield _batch(rows, "chunk bucket known classes", [pa.int64(), pa.int32(), pa.binary(), pa.binary()])

    asked = coded.select("chunk", "hashes").mapInArrow(ask, "bucket int, chunk long, hashes binary")
    none = F.lit(None).cast("binary")
    asked = asked.withColumns({"counts": none, "classes": none})
    ranges = assigned.select("bucket", F.lit(None).cast("long").alias("chunk"), "hashes", "counts", "classes")
    answers = ranges.unionByName(asked).repartition(n, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(answer, "chunk long, bucket int, known binary, classes binary")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, parts = shared.value, []
        kinds = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        for batch in batches:
            for i, codes in enumerate(batch.column("codes")):
                row = {k: batch.column(k)[i].as_py() for k in (("known", "classes") if not codes.is_valid else ("chunk", "hashes", "endings", "codes", "doc_ids", "lengths", "held"))}
                if not codes.is_valid:
                    parts.append((_unpack(row["known"], np.int64), _unpack(row["classes"], np.uint16)))
                    continue
                known, classes = (np.concatenate([p[k] for p in parts] + [np.zeros(0, kind)]).astype(kind) for k, kind in ((0, np.int64), (1, np.uint16)))
                parts = []
                ends = np.frombuffer(row["endings"], np.uint16)
                classes = np.where(known > 0, classes, m.of[m.slots + ends.astype(np.int64)]).astype(np.uint16)
                yield _batch([(row["chunk"], row["hashes"], row["endings"], _pack(known), _pack(classes), row["codes"], row["doc_ids"], row["lengths"], row["held"])], "chunk hashes endings known classes codes doc_ids lengths held", kinds)

    texts_ = coded.select("chunk", F.lit(None).cast("int").alias("bucket"), none.alias("known"), none.alias("classes"), "hashes", "endings", "codes", "doc_ids", "lengths", "held")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in texts_.schema if f.name in ("hashes", "endings", "codes", "doc_ids", "lengths", "held")]
    both = answers.select("chunk", "bucket", "known", "classes", *empty).unionByName(texts_)
    # a chunk's counts come in the order of its hashes, then its texts
    return write_table(both.repartition(n, "chunk").sortWithinPartitions("chunk", F.asc_nulls_last("bucket")).mapInArrow(join, _LABELS_SQL), "labels", release=True)


def class_pairs(labels: DataFrame, k: int) -> np.ndarray:
    """How often classes follow each other in training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for o, c, lengths, held in zip(*(batch.column(x).to_pylist() for x in ("classes", "codes", "lengths", "held")), strict=True):
                lengths, train = np.array(lengths, np.int64), ~np.array(held, bool)
                row = _in_rows(_unpack(o, np.uint16)[_unpack(c, np.uint32)][np.repeat(train, lengths)].astype(np.int64), lengths[train], k - 1)
                before = np.concatenate(([k - 1], row[:-1]))[: len(row)]
                total += np.bincount(before * k + row, minlength=k * k)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell])], ["cell", "n"])

    rows = labels.select("classes", "codes", "lengths", "held").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    grid = np.zeros(k * k)
    for r in rows:
        grid[r["cell"]] = r["n"]
    return grid.reshape(k, k)


def _added(parts: list[tuple[np.ndarray, ...]], width: int) -> tuple[np.ndarray, ...]:
    """(hashes, entries of each, keys, counts) of parts as one: hashes sorted, keys sorted in each."""
    hashes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    word = np.repeat(place, np.concatenate([p[1] for p in parts]))
    cell, at = np.unique(word * width + np.concatenate([p[2] for p in parts]), return_inverse=True)
    return hashes, np.bincount(cell // width, minlength=len(hashes)), cell % width, np.bincount(at, np.concatenate([p[3] for p in parts]), len(cell)).astype(np.int64)


def move(coded: DataFrame, assigned: DataFrame, model: BrownModel, grid: np.ndarray, bits: int) -> DataFrame:
    """assigned after every word outside the seed has moved to its best class; written. coded is that table, or labels."""
    spark, k = coded.sparkSession, len(grid)
    width = 2 * k + 1
    n, shared = shuffle_partitions(spark), spark.sparkContext.broadcast((model, grid))
    first = "classes" not in coded.columns

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value[0]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i].as_py() for x in batch.schema.names}
                hashes, lengths, train = np.frombuffer(row["hashes"], np.uint64), np.array(row["lengths"], np.int64), ~np.array(row["held"], bool)
                classes = m.seed_classes(hashes, np.frombuffer(row["endings"], np.uint16)) if first else _unpack(row["classes"], np.uint16).astype(np.int64)
                end = len(hashes)
                word = _in_rows(_unpack(row["codes"], np.uint32)[np.repeat(train, lengths)].astype(np.int64), lengths[train], end)
                of, free = np.append(classes, k - 1), np.append(~_among(hashes, m.top)[1], False)
                word = np.concatenate(([end], word))  # a document begins after an end
                a, b = word[:-1], word[1:]
                own = a == b
                x, y = free[a], free[b] & ~own
                cells = np.concatenate((a[x] * width + np.where(own, 2 * k, of[b])[x], b[y] * width + k + of[a][y]))
                cells, counts = np.unique(cells, return_counts=True)
                at, number = np.unique(cells // width, return_counts=True)
                sent, keys, stop = hashes[at], (cells % width).astype(np.uint16), np.concatenate(([0], np.cumsum(number)))
                rows = [(r, None, None, sent[lo:hi].tobytes(), _pack(number[lo:hi].astype(np.uint32)), _pack(keys[stop[lo] : stop[hi]]), _pack(counts[stop[lo] : stop[hi]].astype(np.uint32))) for r, lo, hi in _ranges(sent, bits)]
                yield _batch(rows, "bucket counts classes hashes number keys n", [pa.int32(), *[pa.binary()] * 6])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value[1]
        now, known, parts, size = None, None, [], 0

        def done() -> pa.RecordBatch:
            hashes, counts, classes = known
            if parts:
                got, number, keys, added = _added(parts, width)
                at = np.searchsorted(hashes, got)  # every training word is known
                moved = best_classes(classes[at].astype(np.int64), np.repeat(np.arange(len(got)), number), keys, added, table)
                classes = classes.copy()
                classes[at] = moved.astype(np.uint16)
            return _batch([(now, hashes.tobytes(), counts.tobytes(), classes.tobytes())], "bucket hashes counts classes", [pa.int32(), *[pa.binary()] * 3])

        for batch in batches:
            for i, b in enumerate(batch.column("bucket").to_pylist()):
                h, c, o, *entries = (batch.column(x)[i].as_py() for x in ("hashes", "counts", "classes", "number", "keys", "n"))
                if o is not None:  # the range's words come first
                    if known is not None:
                        yield done()
                    now, known, parts, size = b, (np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64), np.frombuffer(o, np.uint16)), [], 0
                    continue
                parts.append((np.frombuffer(h, np.uint64), *(_unpack(e, kind).astype(np.int64) for e, kind in zip(entries, (np.uint32, np.uint16, np.uint32), strict=True))))
                size += len(parts[-1][2])
                if size > 3_000_000 and len(parts) > 1:
                    parts = [_added(parts, width)]
                    size = len(parts[0][2])
        if known is not None:
            yield done()

    columns = ["hashes", "endings", "codes", "lengths", "held"] + ["classes"] * (not first)
    sent = coded.select(*columns).mapInArrow(send, "bucket int, counts binary, classes binary, hashes binary, number binary, keys binary, n binary")
    none = F.lit(None).cast("binary")
    ranges = assigned.select("bucket", "counts", "classes", "hashes", none.alias("number"), none.alias("keys"), none.alias("n"))
    ordered = ranges.unionByName(sent).repartition(n, "bucket").sortWithinPartitions("bucket", F.col("classes").isNull())
    return write_table(ordered.mapInArrow(best, _ASSIGNED_SQL), "classes", release=True)


def _seeded(words: DataFrame, model: BrownModel) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b, h, c, shared.value.seed_classes(np.frombuffer(h, np.uint64), np.frombuffer(e, np.uint16)).astype(np.uint16).tobytes()) for b, h, c, e in zip(*(batch.column(x).to_pylist() for x in ("bucket", "hashes", "counts", "endings")), strict=True)]
            yield _batch(rows, "bucket hashes counts classes", [pa.int32(), *[pa.binary()] * 3])

    return words.mapInArrow(assign, _ASSIGNED_SQL)


def _types(assigned: DataFrame, k: int) -> np.ndarray:
    """Distinct training words by class (the end's: none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k, np.int64)
        for batch in batches:
            for o in batch.column("classes").to_pylist():
                total += np.bincount(np.frombuffer(o, np.uint16), minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], ["class", "n"])

    rows = assigned.select("classes").mapInArrow(count, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(k, np.int64)
    for r in rows:
        out[r["class"]] = r["n"]
    return out


def refine(coded: DataFrame, words: DataFrame, seed: BrownModel, bits: int, passes: int | None = None) -> tuple[DataFrame, BrownModel]:
    """Labels of coded and the model after the passes over all words outside the seed."""
    k, now, labels, grid = len(seed.grid), _seeded(words, seed), None, seed.grid
    for _ in range(PASSES if passes is None else passes):
        moved = move(coded if labels is None else labels, now, seed, grid, bits)
        new = label(coded if labels is None else labels, moved, seed, bits)
        pairs = class_pairs(new, k)
        if likelihood(pairs) <= likelihood(grid):
            drop_table(new)
            drop_table(moved)
            break
        drop_table(coded if labels is None else labels)
        drop_table(now)
        now, labels, grid = moved, new, pairs
    if labels is None:
        labels = label(coded, now, seed, bits)
    types = _types(now, k)
    drop_table(now)
    return labels, replace(seed, grid=grid, follow=_follow(grid), tokens=grid.sum(0), types=types)


def score(labels: DataFrame, model: BrownModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    shared = labels.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _scores({x: batch.column(x)[i].as_py() for x in batch.schema.names}, shared.value)

    return labels.mapInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scores(row: dict, m: BrownModel) -> pa.RecordBatch:
    codes, lengths, counts, k = _unpack(row["codes"], np.uint32), np.array(row["lengths"], np.int64), _unpack(row["known"], np.int64), len(m.follow)
    classes, own, base = m.log_words(np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["endings"], np.uint16), counts, _unpack(row["classes"], np.uint16).astype(np.int64))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    n = len(lengths)
    end = float(np.log10((m.ends + ALPHA) / (m.n + ALPHA * (m.v + 1))))
    track = _in_rows(classes[codes], lengths, k - 1)
    before = np.concatenate(([k - 1], track[:-1]))[: len(track)]
    of_track = np.repeat(np.arange(n), lengths + 1)
    follow = np.bincount(of_track, m.follow[before, track], n)
    # the end's class holds nothing else: its emission is certain
    columns = [
        pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths + 1), pa.array(np.bincount(doc, counts[codes] > 0, n).astype(np.int64) + (m.ends > 0)),
        pa.array(np.full(n, m.n, np.int64)), pa.array(np.bincount(doc, base[codes], n) + end), pa.array(follow + np.bincount(doc, own[codes], n)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def train_and_score(docs: DataFrame) -> DataFrame:
    """Train on docs' training fold and score every row of docs."""
    coded = code(docs)
    sizes = coded.select(F.coalesce(F.sum(F.octet_length("hashes") / 8), F.lit(0)).cast("long").alias("n")).first()["n"]
    bits = max(5, min(24, (sizes // 250_000).bit_length()))
    words = vocabulary(coded, bits)
    labels, model = refine(coded, words, learn(coded, words), bits)
    drop_table(words)
    return score(labels, model)
