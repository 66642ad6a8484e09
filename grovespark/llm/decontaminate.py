"""Benchmark decontamination: windows of documents close in edit distance to a benchmark item.

Texts are words (letters and digits, A-Z in lower case; Chinese and Japanese letters are words each). A document leaks an item
of n words if some run of its words is within floor(RATE * n) word edits of the item; one of up to four words if it
holds them as they are.

1. Seeds. By counting, such a run shares a q-gram with the item (q is the largest of 3, 2, 1 for which
   n - q + 1 - q * floor(RATE * n) >= 1), and as many as that number says, so windows of the item's size
   are only laid around shared q-grams: nothing within the distance is lost here. One pass over the words, without a shuffle.
2. CGK. Each window and each item is embedded by random walks that read a word and go on to the next one
   or stay, as a random bit for (step, word) says; edit distance becomes Hamming distance. Walks share
   their bits between windows and items.
3. Bit sampling. From each of WALKS walks, TABLES draws of BITS steps make keys; a window and an item
   that agree on one key are a candidate pair. Equal texts always agree.
4. Candidates are verified by exact edit distance (the best run of words around the window).

The items of a block of about BLOCK_CHARS characters are sent to the executors; more blocks take more
passes, so what is broadcast is bounded. Null or empty texts, and items without words, leak nothing; repeated rows of
documents or items give a row each, with null ids too; an empty table on either side gives nothing. Columns other than the ids and
texts are not looked at; keep_uncontaminated() carries those of docs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.llm.shared import texts
from grovespark.llm.text import NO_LETTER, Words, chunks, mix, rolling

#: Word edits for each word of an item; walks, draws from each, steps in a draw.
RATE, WALKS, TABLES, BITS = 0.2, 4, 8, 2
BLOCK_CHARS = 4_000_000
LEAKS = "doc_id long, item_id long, edits int, item_words int, start long, end long"


def allowed(n: int, rate: float = RATE) -> int:
    return int(rate * n + 1e-9)


def seed_width(n: int, rate: float = RATE) -> int:
    return next((q for q in (3, 2) if n - q + 1 - q * allowed(n, rate) >= 1), 1)


def walk_keys(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """CGK walks over rows of n word hashes; (rows, WALKS * TABLES) keys of sampled steps."""
    random = np.random.default_rng([seed, n])
    steps = 3 * n
    padded = np.concatenate((rows, np.zeros((len(rows), 1), np.uint64)), axis=1)
    lines, keys = np.arange(len(rows)), []
    for walk in range(WALKS):
        # draws are of early steps, where walks have read little beyond the item
        draws = np.sort(random.integers(0, max(1, 2 * n), (TABLES, BITS)), axis=1)
        bits = random.integers(1, 1 << 63, steps, dtype=np.uint64)
        needed, at = int(draws.max()) + 1, np.zeros(len(rows), np.int64)
        seen: dict[int, np.ndarray] = {}
        wanted = set(draws.ravel().tolist())
        for t in range(needed):
            symbol = padded[lines, at]
            if t in wanted:
                seen[t] = symbol
            at = np.minimum(at + (mix(symbol ^ bits[t]) >> np.uint64(63)).astype(np.int64), n)
        for table, draw in enumerate(draws):
            key = np.full(len(rows), np.uint64(walk * TABLES + table + 1))
            for t in draw:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[int(t)])
            keys.append(key)
    return np.stack(keys, axis=1)


def best_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the run of words closest to item; earliest end first among equals."""
    n, m = len(item), len(words)
    cost, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i in range(n):
        step = cost[:-1] + (words != item[i])
        down = cost[1:] + 1
        new, start = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        new[0], start[0] = i + 1, 0
        np.minimum(step, down, out=new[1:])
        start[1:] = np.where(step <= down, begin[:-1], begin[1:])
        # insertions run along the row: new[j] = min over k <= j of new[k] + (j - k)
        level = new - np.arange(m + 1)
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, np.arange(m + 1), 0))
        cost, begin = low + np.arange(m + 1), start[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


class Items:
    """What executors hold of a block of items."""

    def __init__(self, rows: list[tuple[int | None, str]], rate: float = RATE, seed: int = 20240229):
        self.rate, self.seed = rate, seed
        self.ids, self.words = [], []
        part = pa.array([t or "" for _, t in rows], pa.large_string())
        for w in chunks(part, NO_LETTER, letters=True):
            for i in range(len(w)):
                if len(w.of(i)):
                    self.ids.append(rows[w.low + i][0])
                    self.words.append(w.of(i).copy())
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.tables: dict[int, dict[int, set[int]]] = {}
        by_q, by_n = defaultdict(list), defaultdict(list)
        for k, w in enumerate(self.words):
            q = seed_width(len(w), rate)
            grams = rolling(w, q)
            by_q[q] += [(g, k, o) for o, g in enumerate(grams.tolist())]
            by_n[len(w)].append(k)
        for q, found in by_q.items():
            found.sort()
            self.seeds[q] = (np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found]), np.array([x[2] for x in found]))
        for n, members in by_n.items():
            table = defaultdict(set)
            for k, keys in zip(members, walk_keys(np.stack([self.words[k] for k in members]), n, seed), strict=True):
                for key in keys.tolist():
                    table[key].add(k)
            self.tables[n] = dict(table)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.needed = np.array([max(1, n - (q := seed_width(n, rate)) + 1 - q * allowed(n, rate)) for n in self.lengths.tolist()], np.int64)
        self.sieves = {}
        for q, (grams, _, _) in self.seeds.items():
            self.sieves[q] = np.zeros(1 << 20, bool)
            self.sieves[q][(grams >> np.uint64(44)).astype(np.int64)] = True

    def windows(self, part: Words) -> Iterator[tuple[int, int, int]]:
        """(document, item length, window start) around shared q-grams, start counted in part's words."""
        for q, (grams, item, offset) in self.seeds.items():
            hashes = rolling(part.hashes, q)
            at = np.flatnonzero(self.sieves[q][(hashes >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(grams, hashes[at], "left"), np.searchsorted(grams, hashes[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            if not len(at):
                continue
            times = high - low
            position = np.repeat(at, times)
            which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            doc_of = np.searchsorted(part.first, position, "right") - 1
            inside = position + q <= part.first[doc_of + 1]
            which, position, doc_of = which[inside], position[inside], doc_of[inside]
            # an item of n words within k edits shares n - q + 1 - q * k q-grams, not just one
            _, pair, count = np.unique(doc_of * len(self.words) + item[which], return_inverse=True, return_counts=True)
            enough = count[pair] >= self.needed[item[which]]
            which, position, doc_of = which[enough], position[enough], doc_of[enough]
            yield from set(zip(doc_of.tolist(), self.lengths[item[which]].tolist(), (position - offset[which]).tolist(), strict=True))

    def leaks(self, part: Words) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, first word, word after the last) of each leak, words counted in part."""
        around = defaultdict(set)
        for doc, n, start in self.windows(part):
            k = allowed(n, self.rate)
            around[n].update((doc, s) for s in range(max(start - k, part.first[doc]), max(part.first[doc], min(start + k, part.first[doc + 1] - 1)) + 1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, places in around.items():
            pairs, k = set(), allowed(n, self.rate)
            rows = sorted(places)
            for low in range(0, len(rows), 20_000):
                docs, starts = np.array(rows[low : low + 20_000]).T
                index = starts[:, None] + np.arange(n)
                cut = index >= part.first[docs + 1][:, None]
                windows = part.hashes[np.minimum(index, len(part.hashes) - 1)]
                windows[cut] = 0
                table = self.tables[n]
                for doc, start, keys in zip(docs.tolist(), starts.tolist(), walk_keys(windows, n, self.seed).tolist(), strict=True):
                    pairs.update((doc, item, start) for key in keys if key in table for item in table[key])
            # candidates that overlap are verified in one span
            spans: list[list[int]] = []
            for doc, item, start in sorted(pairs):
                if spans and spans[-1][:2] == [doc, item] and start - spans[-1][3] <= n:
                    spans[-1][3] = start
                else:
                    spans.append([doc, item, start, start])
            for doc, item, first, last in spans:
                low, high = max(first - k, part.first[doc]), min(last + n + k, part.first[doc + 1])
                edits, a, b = best_run(self.words[item], part.hashes[low:high])
                if edits <= k and edits < best.get((doc, item), (k + 1,))[0]:
                    best[doc, item] = (edits, low + a, low + b)
        return [(doc, item, *found) for (doc, item), found in sorted(best.items())]


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of about BLOCK_CHARS characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_CHARS))
    for b in range(blocks):
        yield Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it leaks: doc_id, item_id, edits, item_words, and the leaked
    run's start and end, in bytes of the text's UTF-8."""
    spark, found = docs.sparkSession, None
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                rows = []
                for part in chunks(batch.column("text"), NO_LETTER, letters=True):
                    origin = None
                    for doc, item, edits, a, b in items.leaks(part):
                        origin = part.offsets[doc]
                        rows.append((ids[part.low + doc].as_py(), items.ids[item], edits, len(items.words[item]), int(part.starts[a] - origin) if b > a else 0, int(part.ends[b - 1] - origin) if b > a else 0))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "edits", "item_words", "start", "end"])

        one = texts(docs).mapInArrow(search, LEAKS)
        found = one if found is None else found.unionByName(one)
    return found


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item; no shuffle."""
    spark = docs.sparkSession
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch.column("text"), NO_LETTER, letters=True):
                    kept = np.ones(len(part), bool)
                    kept[[x[0] for x in shared.value.leaks(part)]] = False
                    yield batch.slice(part.low, len(part)).filter(pa.array(kept))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
