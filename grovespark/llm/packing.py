"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded.

A document of n tokens is cut into n // longest pieces of the longest length and one piece for
each bit of the rest, longest first. Pieces of equal length share a bucket, and each piece is a
whole sequence there, so batches of one bucket need no padding. Sequences are numbered without
gaps, longest bucket first.

Tokens are written once, as a table in the shared folder; numbering takes a count for each task
and length, so nothing is shuffled. A null text is empty and holds just the end id; rows with
the same id (or none) are packed apart, each in its own right; pieces of equal length are in the order of their tasks; an
empty table gives no pieces. Columns other than the id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovespark.llm.binary_records import text_runs
from grovespark.llm.shared import texts, write_table
from grovespark.llm.tokens import encoder

LONGEST = 2048
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("task", pa.int64()), ("number", pa.int64())])


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths that n is cut into; longest is a power of two."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, splitter: str = "lead", end_id: int = 1, longest: int = LONGEST) -> DataFrame:
    """The packed sequences of docs with their ids: doc_id, start, length, doc_tokens, ids
    (little-endian, of width bytes), width, sequence_id, offset (0: a piece is a sequence)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, numbers = TaskContext.get().partitionId(), Counter()
        coder = encoder(tokenizer, splitter)
        end, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        for batch in batches:
            for ids, run in text_runs(batch):
                rows = []
                for doc_id, packed in zip(ids, coder.encode(run), strict=True):
                    packed += end
                    total, at = len(packed) // width, 0
                    for n in binary_lengths(total, longest):
                        rows.append((doc_id, at, n, total, packed[at * width : (at + n) * width], width, task, numbers[n]))
                        numbers[n] += 1
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    pieces = write_table(texts(docs).mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary, width int, task long, number long"), "pieces", "snappy")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))  # tasks x lengths rows
    before = counts.select("length", "task", (F.sum("n").over(Window.orderBy(F.desc("length"), "task")) - F.col("n")).alias("before"))
    numbered = pieces.join(F.broadcast(before), ["length", "task"])
    return numbered.select("doc_id", "start", "length", "doc_tokens", "ids", "width", (F.col("before") + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def piece_digests(packed: DataFrame) -> DataFrame:
    """pack()'s rows with ids_crc32 (ids as little-endian unsigned 32-bit integers) for their ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(ids, f"<u{w}").astype("<u4").tobytes()) for ids, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True)]
            yield batch.append_column("ids_crc32", pa.array(crc, pa.int64())).select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return packed.mapInArrow(digest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
