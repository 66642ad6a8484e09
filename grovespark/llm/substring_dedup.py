"""Repeated passages, by hashing runs of lines and sentences.

A text is cut into pieces that depend on nothing but the words around the cut: at line ends, after ``.``, ``!`` or ``?``
before a space, and after a word that is longer (in bytes) than the NEAR words before it and no shorter than the NEAR
words after it. A unit begins at every piece and holds as many whole pieces as it takes to have LEAST_WORDS words: so
a passage in the midst of a line, of short lines, or without punctuation is met wherever it stands, whatever is
around it, if the whole pieces in it have so many words. Whole lines alone would meet only passages that fill their lines.

Units are normalised to their words (letters and digits, A-Z in lower case) and digested to 128 bits. Digests are
grouped over all documents, the earliest occurrence by (id, digest of the text, place) is kept, and the others are
reported or removed with their original offsets (in bytes of the text's UTF-8). What overlaps the earliest occurrence in its own
document is no other occurrence.

A digest's occurrences are reduced to the earliest before they are shuffled, and joined back to it: a unit that a third
of all rows share costs its rows once, and its join partition can be split.

Null ids come first; null and empty texts have no units; rows with the same id and text are one document, and rows
with the same id (or none) and different texts are documents each; an empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovespark.llm.shared import fresh, texts, write_table
from grovespark.llm.text import NO_LETTER, SPACE, Words, chunks, mix

#: Words of a unit, at least; words on each side that the longest is held against.
LEAST_WORDS, NEAR = 32, 8
UNITS = "high long, low long, doc_id long, mark long, start long, end long, n_words int"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base, and of its inverse, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for step in (base, pow(base, -1, 1 << 64)):
            factors = np.full(max(n, 1 << 17), np.uint64(step))
            factors[0] = 1
            both.append(np.cumprod(factors, dtype=np.uint64))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def _pieces(part: Words, near: int) -> np.ndarray:
    """The words that begin a piece; a document's first is always one."""
    data, n, m = part.data, len(part.data), len(part.starts)
    cut = np.zeros(n + 1, bool)
    cut[part.offsets] = True
    cut[1:] |= data == 10
    stop = (data == 46) | (data == 33) | (data == 63)
    cut[1:n] |= stop[:-1] & (data[1:] == 32)
    before = np.searchsorted(np.flatnonzero(cut), part.starts, "right")
    new = np.concatenate(([True], before[1:] != before[:-1]))
    # the longest words around; another document's words don't count
    length = part.ends - part.starts
    doc = np.searchsorted(part.first, np.arange(m), "right")
    longest = np.ones(m, bool)
    for k in range(1, min(near, m - 1) + 1):
        same = doc[k:] == doc[:-k]
        longest[k:] &= ~same | (length[k:] > length[:-k])
        longest[:-k] &= ~same | (length[:-k] >= length[k:])
    new[1:] |= longest[:-1]
    return np.flatnonzero(new)


def units(part: Words, least: int = LEAST_WORDS, near: int = NEAR) -> tuple[np.ndarray, ...]:
    """(document, high, low, start, end, words) of every unit."""
    n, m = len(part.data), len(part.starts)
    if not m:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    first = _pieces(part, near)
    stops = np.append(first[1:], m)
    doc = np.searchsorted(part.first, first, "right") - 1
    at = np.searchsorted(stops, first + least)
    whole = at < len(stops)
    whole[whole] = stops[at[whole]] <= part.first[doc[whole] + 1]
    first, doc, after = first[whole], doc[whole], stops[at[whole]]
    digests = []
    for base in _BASES:
        up, down = _power(base, m + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(part.hashes + np.uint64(base)) * up[:m], dtype=np.uint64)))
        digests.append(mix((sums[after] - sums[first]) * down[first] + (after - first).astype(np.uint64)).view(np.int64))
    # to the end of the last word and what follows it up to white space or the next word
    last = part.ends[after - 1]
    bounds = np.concatenate((np.flatnonzero(SPACE[part.data]), part.offsets, [n]))
    bounds.sort()
    end = np.minimum(bounds[np.searchsorted(bounds, last)], np.append(part.starts, n)[after])
    origin = part.offsets[doc]
    return doc, *digests, part.starts[first] - origin, end - origin, after - first


def find_units(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Every unit of docs (doc_id, text) with its digest and place; mark is a digest of the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column("text"), NO_LETTER):
                doc, high, low, start, end, count = units(part, least)
                row = pa.array(doc + part.low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high, pa.int64()), pa.array(low, pa.int64()), batch.column("doc_id").take(row), batch.column("mark").take(row), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(count.astype(np.int32))],
                    ["high", "low", "doc_id", "mark", "start", "end", "n_words"],
                )

    return texts(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(find, UNITS)


def repeated_units(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The units that aren't the earliest of their digest: doc_id, mark (xxhash64 of the text), start, end, n_words,
    first_doc_id, first_start."""
    found = write_table(find_units(docs, least), "units")
    place = F.struct("doc_id", "mark", "start", "end")
    first = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    own = F.col("doc_id").eqNullSafe(F.col("first")["doc_id"]) & (F.col("mark") == F.col("first")["mark"]) & (F.col("start") < F.col("first")["end"])
    later = found.join(first.drop("times"), ["high", "low"]).where(~own)
    return later.select("doc_id", "mark", "start", "end", "n_words", F.col("first")["doc_id"].alias("first_doc_id"), F.col("first")["start"].alias("first_start"))


def dedup_units(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without their repeated units, and `kept`: the (start, end) of what is left, in bytes of the original
    text. A null text stays null with kept null; other columns are as before, but for one named kept, which is replaced."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc, of_text, spans_col, own, own_mark = fresh(docs, "doc", "mark", "gone", "id", "text")
    gone = repeated_units(plain, least).groupBy(F.col("doc_id").alias(doc), F.col("mark").alias(of_text)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(spans_col))
    marked = docs.withColumns({own: F.col(id_col).cast("long"), own_mark: F.xxhash64(text_col)})
    both = marked.join(gone, F.col(own).eqNullSafe(F.col(doc)) & (F.col(own_mark) == F.col(of_text)), "left").drop(doc, of_text, own, own_mark)
    kinds = [c for c in docs.columns if c != "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, kept = [], []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column(spans_col).to_pylist(), strict=True):
                raw, at, left = (text or "").encode(), 0, []
                for span in spans or []:
                    if span["start"] > at:
                        left.append((at, span["start"]))
                    at = max(at, span["end"])
                if at < len(raw):
                    left.append((at, len(raw)))
                new.append(None if text is None else b"".join(raw[a:b] for a, b in left).decode())
                kept.append(None if text is None else [{"start": a, "end": b} for a, b in left])
            columns = [pa.array(new, pa.string()) if name == text_col else batch.column(name) for name in kinds]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=[*kinds, "kept"])

    schema = T.StructType([f for f in docs.schema if f.name != "kept"]).add("kept", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    return both.mapInArrow(cut, schema)
