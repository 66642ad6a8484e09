"""All documents linked by a Jaccard similarity of at least 0.8 of their five-word shingles, by a prefix tree.

A link is 100 * common >= 80 * union, exactly, on sets of 64-bit shingle hashes. The result is a row
for each document with its set's size and its component, so copies are never expanded into pairs.

1. Sets. Documents with equal sets are one class (a digest of 128 bits); only classes go on.
2. Candidates. Two linked sets x, y share all but n - ceil(0.8 n) of each; so of the smallest hashes of x,
   n - ceil(0.8 n) + m of them, at least m are also among those of y, if x's end first. Each class
   sends its n - ceil(0.8 n) + m(n) smallest hashes, m(n) = max(1, n // 10), to their range of hashes, and
   learns how many of them another class sent. Fewer than m(ceil(0.8 n)): it has no link. Most documents end here.
   Hashes travel packed, with those of a task counted first: a hash that a third of all classes has is sent
   once by each task.
3. Families. The candidates' whole sets are ordered by how many of them have a shingle (rarest first; counted by ranges
   of hashes), and any shingle in the first n - ceil(0.8 n) + 1 of several sets ties them into one family. Links never leave one.
4. Prefix tree. The sets of a family are put into a tree, in a common order; each set is walked through
   it, sharing the overlap of what sets have in common, and a subtree is left out when the remaining lengths can't
   reach the overlap that a link needs, or when all its sets are already in the walker's component.
   A family of more than BLOCK shingles is cut into classes of sizes and those into blocks: first within blocks, then among one
   set of each component and block, and only where components remain apart, between pairs of blocks of the same class or of
   two that follow each other.

A document without words has an empty set (0), is its own component and links with nothing, as has a
null or empty text. A row with a null id gets its set's size and a null component. Rows with the same id
get a row each, with the component of their own text: classes have numbers of their own, and ids name them only at the
end. Ties don't arise: a component is named by its smallest id. Columns other than the id and text are not looked at.
An empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.llm.components import components
from grovespark.llm.shared import drop_table, fresh, shuffle_partitions, texts, write_table
from grovespark.llm.text import chunks, shingle_set

SHINGLE = 5
#: Hashes that a task counts before it sends them; shingles in a block of a family.
RUN, BLOCK = 1_000_000, 2_000_000
#: Two linked sets' sizes differ by a quarter at most: by one class of this ratio.
CLASS = 1.26
#: Bits of the sieve of candidates, at least and at most (16 for each candidate between).
SIEVE = (1 << 20, 1 << 27)


def least_common(n):
    """ceil(0.8 n): what a linked set of n has in common with any other, at least."""
    return -(-80 * n // 100)


def spare(n):
    return np.maximum(1, n // 10)


def sent(n):
    """How many of its smallest hashes a set of n sends."""
    return n - least_common(n) + spare(n)


def needed(total: int) -> int:
    """The overlap of a link between sets with so many shingles together."""
    return -(-4 * total // 9)


def _digest(s: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for part in chunks(batch.column("text")):
        for i in range(len(part)):
            yield part.low + i, shingle_set(part.of(i), SHINGLE)


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n, hi, lo of every row (doc_id, text, mark): the size and digest of its set."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *_digest(s)) for _, s in _sets(batch)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "mark", "n", "hi", "lo"])

    return docs.mapInArrow(sizes, "doc_id long, mark long, n long, hi long, lo long")


def _packed(bucket, tokens, nodes) -> tuple:
    return int(bucket), tokens.tobytes(), nodes.tobytes()


def _send(docs: DataFrame, bits: int) -> DataFrame:
    """bucket, tokens, nodes: packed hashes by range (the first `bits` bits), with their class. Without nodes:
    hashes that more than one class of the task has. Without tokens: classes, each as often as such a hash."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, nodes, size = [], [], 0
        turn = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            t, v = np.concatenate(tokens), np.concatenate(nodes)
            order = np.argsort(t)
            t, v = t[order], v[order]
            first = np.concatenate(([True], t[1:] != t[:-1]))
            many = np.zeros(len(t), bool)
            many[1:] = ~first[1:]
            many[:-1] |= ~first[1:]
            rows = []
            for kept, with_nodes in ((~many, True), (many & first, False)):
                hashes, owners = t[kept], v[kept]
                if not len(hashes):
                    continue
                bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
                    rows.append(_packed(bucket[a], hashes[a:b], owners[a:b] if with_nodes else owners[:0]))
            if many.any():
                rows.append(_packed(turn % (1 << bits), t[:0], v[many]))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "tokens", "nodes"])

        for batch in batches:
            for _, s in _sets(batch):
                if not len(s) or (node := _digest(s)[1]) in seen:
                    continue
                seen.add(node)
                part = s[: sent(len(s))]
                tokens.append(part)
                nodes.append(np.full(len(part), node, np.int64))
                size += len(part)
                if size >= RUN:
                    yield flush()
                    tokens, nodes, size = [], [], 0
                    turn += 1
        if size:
            yield flush()

    return docs.mapInArrow(send, "bucket int, tokens binary, nodes binary")


class _Bucket:
    """Hashes of one range so far; those known to be shared are counted as they come."""

    def __init__(self):
        self.tokens, self.nodes, self.marks, self.counts, self.size = [], [], [], [], 0

    def add(self, tokens: np.ndarray, nodes: np.ndarray) -> None:
        if not len(tokens):
            self.counts.append(nodes)
        elif not len(nodes):
            self.marks.append(tokens)
        else:
            self.tokens.append(tokens)
            self.nodes.append(nodes)
            self.size += len(tokens)
            if self.size > 4 * RUN:
                self.compact()

    def compact(self) -> None:
        """Count the classes of shared hashes; keep one row of each other hash."""
        marks = np.unique(np.concatenate([*self.marks, np.zeros(0, np.uint64)]))
        if self.tokens:
            t, v = np.concatenate(self.tokens), np.concatenate(self.nodes)
            order = np.lexsort((v, t))
            t, v = t[order], v[order]
            fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (v[1:] != v[:-1])))
            t, v = t[fresh], v[fresh]
            many = np.zeros(len(t), bool)
            same = t[1:] == t[:-1]
            many[1:] |= same
            many[:-1] |= same
            if len(marks):
                at = np.minimum(np.searchsorted(marks, t), len(marks) - 1)
                many |= marks[at] == t
            self.counts.append(v[many])
            marks = np.union1d(marks, t[many])
            self.tokens, self.nodes = [t[~many]], [v[~many]]
            self.size = len(self.tokens[0])
        self.marks = [marks]

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        self.compact()
        return np.unique(np.concatenate([*self.counts, np.zeros(0, np.int64)]), return_counts=True)


def _shared_hashes(packed: DataFrame) -> DataFrame:
    """(node, shared): how many of a class's hashes another class sent, by range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, _Bucket()

        def done() -> pa.RecordBatch:
            nodes, counts = bucket.finish()
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts.astype(np.int64))], ["node", "shared"])

        for batch in batches:
            for b, tokens, nodes in zip(*(batch.column(k) for k in ("bucket", "tokens", "nodes")), strict=True):
                if now is not None and b.as_py() != now:
                    yield done()
                    bucket = _Bucket()
                now = b.as_py()
                bucket.add(np.frombuffer(tokens.as_py(), np.uint64), np.frombuffer(nodes.as_py(), np.int64))
        if now is not None:
            yield done()

    ordered = packed.repartition(shuffle_partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(count, "node long, shared long")


def candidates(docs: DataFrame, classes: DataFrame, hashes: int) -> DataFrame:
    """The classes (hi, lo, n, node, doc) that may have a link."""
    bits = max(6, min(24, (hashes // 500_000).bit_length()))
    shared = _shared_hashes(_send(docs, bits)).groupBy("node").agg(F.sum("shared").alias("shared"))
    partner = F.expr("(80 * n + 99) div 100")
    enough = F.col("shared") >= F.greatest(F.lit(1), F.floor(partner / 10))
    return classes.join(shared.withColumnRenamed("node", "lo"), "lo").where(enough).select("hi", "lo", "n", "node", "doc")


def _sieve(found: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit map of the candidates' digests; SIEVE[1] bits at most."""
    size = min(SIEVE[1], max(SIEVE[0], 1 << (16 * n).bit_length()))
    at = F.pmod(F.col("lo"), F.lit(size))
    rows = found.select(F.bitmap_bucket_number(at + 1).alias("bucket"), F.bitmap_bit_position(at + 1).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    sieve = np.zeros(size // 8, np.uint8)
    for r in rows:
        low = (r["bucket"] - 1) * 4096
        sieve[low : low + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(sieve) - low]
    return sieve, size


def candidate_sets(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(node, n, tokens, chunk): the candidates' whole sets, packed, in chunks of about 4 * RUN shingles; written
    at once."""
    sieve, size = _sieve(found, found.count())
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, s in _sets(batch):
                hi, lo = _digest(s)
                at = lo % size
                if len(s) and bits[at >> 3] >> (at & 7) & 1:
                    rows.append((ids[i], hi, lo, s.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "hi", "lo", "tokens"])

    some = docs.where(F.col("doc_id").isNotNull()).mapInArrow(select, "doc_id long, hi long, lo long, tokens binary")
    kept = some.join(found, ["hi", "lo"]).where(F.col("doc_id") == F.col("doc")).select("node", "n", "tokens")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = size + np.cumsum(batch.column("n").to_numpy())
            yield batch.append_column("chunk", pa.array(chunk + sizes // (4 * RUN)))
            size = int(sizes[-1]) if len(sizes) else size

    return write_table(kept.dropDuplicates(["node"]).mapInArrow(number, "node long, n long, tokens binary, chunk long"), "sets")


def _counted(sets: DataFrame, bits: int) -> DataFrame:
    """(chunk, hashes, counts): for the shingles of each chunk that more than one set has, how many have them.
    Chunks send their distinct shingles to ranges of hashes and get back what the range has counted: a shingle comes
    at most once from each run of sets, however common it is."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def done() -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            rows = [(k, now, hashes[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return _hash_rows(rows)

        for batch in batches:
            for chunk, x in zip(batch.column("chunk").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if now is not None and (chunk != now or size > 2 * RUN):
                    yield done()
                    held, size = [], 0
                now = chunk
                held.append(np.frombuffer(x, np.uint64))
                size += len(held[-1])
        if held:
            yield done()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            hashes, place = np.unique(np.concatenate([h for _, h, _ in held]), return_inverse=True)
            total = np.bincount(place, np.concatenate([c for _, _, c in held]).astype(np.float64), len(hashes)).astype(np.int64)
            rows, low = [], 0
            for chunk, h, _ in held:
                mine = total[place[low : low + len(h)]]
                many = mine > 1
                low += len(h)
                if many.any():
                    rows.append((now, chunk, h[many].tobytes(), np.minimum(mine[many], (1 << 32) - 1).astype(np.uint32).tobytes()))
            return _hash_rows(rows)

        for batch in batches:
            for b, chunk, h, c in zip(*(batch.column(k).to_pylist() for k in ("bucket", "chunk", "hashes", "counts")), strict=True):
                if now is not None and b != now:
                    yield done()
                    held = []
                now = b
                held.append((chunk, np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32)))
        if held:
            yield done()

    schema = "bucket int, chunk long, hashes binary, counts binary"
    asked = sets.select("chunk", "tokens").mapInArrow(ask, schema)
    return asked.repartition(shuffle_partitions(sets.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(answer, schema)


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "hashes", "counts"])


def families(sets: DataFrame) -> DataFrame:
    """(node, component): sets tied by a shingle that is among the rarest of both."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    counted = _counted(sets, max(6, min(24, (total // 500_000).bit_length())))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, known, counts = None, [], None, None
        for batch in batches:
            tokens, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for chunk, node, n, x, h, c in zip(*(batch.column(k).to_pylist() for k in ("chunk", "node", "n", "tokens", "hashes", "counts")), strict=True):
                if chunk != now:
                    now, parts, known = chunk, [], None
                if x is None:  # what is counted comes before the chunk's sets
                    parts.append((np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32)))
                    continue
                if known is None:
                    known, first = np.unique(np.concatenate([*[p[0] for p in parts], np.zeros(0, np.uint64)]), return_index=True)
                    counts = np.concatenate([*[p[1] for p in parts], np.zeros(0, np.uint32)])[first]
                if not len(known):
                    continue
                s = np.frombuffer(x, np.uint64)
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                shared = known[at] == s
                # shingles of this set alone come first in the order, and tie it to nothing
                left = n - least_common(n) + 1 - int(len(s) - np.count_nonzero(shared))
                if left > 0:
                    s, common = s[shared], counts[at[shared]]
                    tokens.append(s[np.lexsort((s, common))[:left]])
                    nodes.append(np.full(len(tokens[-1]), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], ["token", "node"])

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = counted.select("chunk", null("long", "node"), null("long", "n"), null("binary", "tokens"), "hashes", "counts")
    both = first.unionByName(sets.select("chunk", "node", "n", "tokens", null("binary", "hashes"), null("binary", "counts")))
    ordered = both.repartition(shuffle_partitions(sets.sparkSession), "chunk").sortWithinPartitions("chunk", F.asc_nulls_first("node"))
    rows = write_table(ordered.mapInArrow(rarest, "token long, node long"), "rarest")
    hubs = rows.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("token", "a")
    out = components(rows.join(hubs, "token").select("a", F.col("node").alias("b")).distinct())
    drop_table(rows)
    return out


class Tree:
    """A prefix tree over sorted sequences, as ranges of them. A node's path is shared by sets low:high."""

    def __init__(self, rows: list[np.ndarray], sizes: np.ndarray):
        self.rows, self.sizes, n = rows, sizes, len(rows)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        # how far each sequence agrees with the one before
        agree = np.zeros(n, np.int64)
        for i in range(1, n):
            m = min(self.lengths[i], self.lengths[i - 1])
            differ = rows[i][:m] != rows[i - 1][:m]
            agree[i] = np.argmax(differ) if differ.any() else m
        #: low, high, depth above, depth, smallest size, longest rest below, end of the sets that end here
        self.nodes: list[list[int]] = []
        self.children: list[list[int]] = []
        stack = [(0, n, 0, -1)] if n else []
        while stack:
            low, high, above, parent = stack.pop()
            depth = int(agree[low + 1 : high].min()) if high - low > 1 else int(self.lengths[low])
            depth = min(depth, int(self.lengths[low]))
            me = len(self.nodes)
            self.nodes.append([low, high, above, depth, int(sizes[low:high].min()), int(self.lengths[low:high].max()) - depth])
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            ends = low
            while ends < high and self.lengths[ends] == depth:
                ends += 1
            self.nodes[-1].append(ends)
            if ends < high:
                cuts = [ends, *[ends + 1 + int(c) for c in np.flatnonzero(agree[ends + 1 : high] <= depth)], high]
                stack += [(a, b, depth, me) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def link_group(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], comp: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among some sets: a spanning forest, not all pairs.
    comp: components already known; side: links only between sets of different sides are wanted."""
    n = len(ids)
    if n < 2:
        return []
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    kept = counts > 1  # a shingle of one set alone counts by the set's size
    # the common order: the most common first, so that near copies share long paths
    rank = np.full(len(every), -1, np.int64)
    order = np.argsort(-counts[kept], kind="stable")
    rank[np.flatnonzero(kept)[order]] = np.arange(int(kept.sum()))
    common = counts[kept][order]
    rows = []
    for s in sets:
        r = rank[np.searchsorted(every, s)]
        rows.append(np.sort(r[r >= 0]).astype(">u4"))
    by = sorted(range(n), key=lambda i: rows[i].tobytes())
    ids, sizes = ids[by], sizes[by]
    rows = [rows[i].astype(np.int64) for i in by]
    comp = np.arange(n) if comp is None else comp[by].copy()
    side = None if side is None else side[by]
    tree = Tree(rows, sizes)
    member, done, links = np.zeros(len(common), bool), np.zeros(n, bool), []
    # sets of common shingles first: they are in the midst of their family
    for x in sorted(range(n), key=lambda i: -float(common[rows[i]].mean()) if len(rows[i]) else 0.0):
        done[x] = True
        mine, size = rows[x], int(sizes[x])
        if len(mine) < least_common(size):
            continue
        alive = ~done & (comp != comp[x])
        if side is not None:
            alive &= side != side[x]
        if not alive.any():
            continue
        member[mine] = True
        stack = [(0, 0)]
        while stack:
            at, overlap = stack.pop()
            low, high, above, depth, smallest, rest, ends = tree.nodes[at]
            if not alive[low:high].any():
                continue
            if depth > above:
                edge = rows[low][above:depth]
                overlap += int(np.count_nonzero(member[edge]))
                left = len(mine) - int(np.searchsorted(mine, edge[-1], "right"))
            else:
                left = len(mine)
            if overlap + min(left, rest) < needed(size + smallest):
                continue
            for y in range(low, ends):
                if alive[y] and overlap >= needed(size + int(sizes[y])):
                    links.append((int(ids[x]), int(ids[y])))
                    comp[comp == comp[y]] = comp[x]
                    alive &= comp != comp[x]
            stack += [(child, overlap) for child in tree.children[at]]
        member[mine] = False
    return links


def _joined(rows: DataFrame) -> DataFrame:
    """(a, b) for rows (group, node, n, tokens, comp, side), group by group: one group is in memory."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            node, n, tokens, comp, side = zip(*held, strict=True)
            ids = np.array(node, np.int64)
            _, labels = np.unique(np.array(comp, np.int64), return_inverse=True)
            sides = np.array(side, np.int64)
            links = link_group(ids, np.array(n, np.int64), [np.frombuffer(t, np.uint64) for t in tokens], labels, None if (sides == sides[0]).all() else sides)
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for group, *row in zip(*(batch.column(k).to_pylist() for k in ("group", "node", "n", "tokens", "comp", "side")), strict=True):
                if now is not None and group != now:
                    if len(held) > 1:
                        yield done()
                    held = []
                now = group
                held.append(row)
        if len(held) > 1:
            yield done()

    ordered = rows.repartition(shuffle_partitions(rows.sparkSession), "group").sortWithinPartitions("group", "node")
    return ordered.select("group", "node", "n", "tokens", "comp", "side").mapInArrow(join, "a long, b long")


def links(sets: DataFrame) -> DataFrame:
    """(a, b): links that connect all sets which links connect; written."""
    member = families(sets)
    placed = sets.select("node", "n").join(member.withColumnRenamed("component", "family"), "node")
    weight = placed.groupBy("family").agg(F.sum("n").alias("weight"))
    name = lambda *parts: F.xxhash64("family", *parts)
    whole = lambda rows, *more: rows.join(sets, "node").select("group", "node", "n", "tokens", *more)
    if weight.where(F.col("weight") > BLOCK).isEmpty():  # every family is one block
        return write_table(_joined(whole(placed.select("node", name().alias("group")), F.col("node").alias("comp"), F.lit(0).alias("side"))), "found")
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(CLASS))).cast("int")
    placed = placed.join(weight, "family").select("node", "n", "family", F.when(F.col("weight") > BLOCK, size).otherwise(-1).alias("size"))
    sizes = write_table(placed.groupBy("family", "size").agg(F.expr(f"cast((sum(n) + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks")), "sizes")
    blocks = write_table(placed.join(sizes, ["family", "size"]).select("node", "n", "family", "size", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "blocks")
    found = write_table(_joined(whole(blocks.select("node", name("size", "block").alias("group")), F.col("node").alias("comp"), F.lit(0).alias("side"))), "found")
    large = blocks.where("size >= 0")
    for step in ("midst", "pairs"):
        now = components(found)
        state = large.join(now, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        apart = state.groupBy("family").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a < z").select("family")
        state = write_table(state.join(apart, "family"), "state")
        if state.isEmpty():
            break
        if step == "midst":
            some = state.groupBy("family", "size", "block", "comp").agg(F.min(F.struct("node", "n")).alias("x")).select("family", "size", "comp", "x.*")
            parts = some.groupBy("family", "size").agg(F.expr(f"cast((sum(n) + {BLOCK - 1}) div {BLOCK} as int)").alias("parts"))
            group = some.join(parts, ["family", "size"]).select("node", "comp", F.lit(0).alias("side"), name("size", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))).alias("group"))
        else:
            # linked sets are of one class of sizes or of two that follow each other
            near = state.withColumn("other_size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).join(sizes.select("family", F.col("size").alias("other_size"), "blocks"), ["family", "other_size"])
            both = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block OR other_size <> size")
            pair = F.array_sort(F.array(F.struct("size", "block"), F.struct(F.col("other_size").alias("size"), F.col("other").alias("block"))))
            group = both.select("node", "comp", F.xxhash64("size", "block").alias("side"), name(pair).alias("group"))
        more = write_table(found.unionByName(_joined(whole(group, "comp", "side"))), "found")
        for table in (found, state):
            drop_table(table)
        found = more
    for table in (blocks, sizes):
        drop_table(table)
    return found


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (a digest of the text), n_shingles, first (the least (doc_id, mark) of the component; null without words or id)."""
    plain = texts(docs, id_col, text_col)
    sizes = write_table(set_sizes(plain.withColumn("mark", F.xxhash64("text"))), "sizes")
    named = sizes.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # numbers are given once, as the table is written: ids may repeat with other texts
    classes = named.groupBy("hi", "lo", "n").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select("*", F.col("first")["doc_id"].alias("doc"), F.monotonically_increasing_id().alias("node"))
    classes = write_table(classes, "classes")
    hashes = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // 4
    found = write_table(candidates(plain, classes, hashes), "candidates")
    sets = candidate_sets(plain, found)
    tied = links(sets)
    ties = components(tied)
    for table in (sets, found, tied):
        drop_table(table)
    linked = classes.select("node", "first").join(ties, "node")
    names = linked.groupBy("component").agg(F.min("first").alias("name"))
    of = classes.join(linked.select("node", "component").join(names, "component").select("node", "name"), "node", "left").select("hi", "lo", "n", F.coalesce("name", "first").alias("first"))
    out = sizes.join(of, ["hi", "lo", "n"], "left")
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    return _components(docs, id_col, text_col).select("doc_id", "n_shingles", F.coalesce(F.col("first")["doc_id"], "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component, by (id, digest of the text); rows
    without words or without an id stay, and so do all rows of the same id and text as the first."""
    doc, own, of_text, own_mark = fresh(docs, "doc", "id", "mark", "text")
    rows = _components(docs, id_col, text_col).where(F.col("first").isNull() | ((F.col("doc_id") == F.col("first")["doc_id"]) & (F.col("mark") == F.col("first")["mark"])))
    first = rows.select(F.col("doc_id").alias(doc), F.col("mark").alias(of_text)).distinct()
    marked = docs.withColumns({own: F.col(id_col).cast("long"), own_mark: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return marked.join(first, F.col(own).eqNullSafe(F.col(doc)) & (F.col(own_mark) == F.col(of_text)), "left_semi").drop(own, own_mark)
