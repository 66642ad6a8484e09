"""Token ids as length-delimited binary records, with a separate offset index.

A shard ``NNNNN.rec`` holds one record for each document:

    length of the payload, 8 bytes | its masked checksum, 4 bytes | payload | masked checksum

all little-endian. The payload is one byte of flags (1: the id is null), the document's id in
8 bytes, the width of an id in one byte and the ids. A checksum is CRC-32, masked by a rotation
by 15 bits and an added constant, as a checksum of data that holds checksums should be. Its
index ``NNNNN.idx`` has for each record its offset, id and number of ids (8 bytes each), so that a
shuffled read opens any record without scanning the shard.

Shards are ranges of ascending ids, so a task's memory is one batch of texts. A task writes under
a name of its own and renames at the end: a lost executor's task is run again.

Null ids come first, as Spark sorts them; a null text is empty and has just the end id; documents
with the same id follow each other in order of their texts; an empty table gives no records; other
columns are left alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovespark.llm.shared import shuffle_partitions, texts, work_path, write_table
from grovespark.llm.tokens import encoder

_MASK = 0xA282EAD8
_HEAD, _ID, _INDEX = "<QI", "<BqB", "<QqQ"
_HEAD_SIZE, _ID_SIZE, _INDEX_SIZE = map(struct.calcsize, (_HEAD, _ID, _INDEX))
SHARDS = "shard int, path string, n_docs long, n_tokens long"
RECORDS = "shard int, ordinal long, doc_id long, n_tokens long, ids_crc32 long, ids binary, width int"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frames(stream) -> Iterator[bytes]:
    """The payloads of a shard; ValueError where a checksum doesn't hold or the shard is cut off."""
    while head := stream.read(_HEAD_SIZE):
        if len(head) < _HEAD_SIZE or masked(head[:8]) != struct.unpack(_HEAD, head)[1]:
            raise ValueError("a record's length is damaged")
        n = struct.unpack(_HEAD, head)[0]
        body = stream.read(n + 4)
        if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
            raise ValueError("a record's payload is damaged")
        yield body[:n]


def text_runs(batch: pa.RecordBatch, id_col: str = "doc_id", text_col: str = "text", limit: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a batch in runs of a bounded number of characters."""
    ids, column = batch.column(id_col), batch.column(text_col)
    low = size = 0
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, n in enumerate(lengths):
        size += n
        if size >= limit or i == len(column) - 1:
            part = slice(low, i + 1)
            yield ids[part].to_pylist(), [t or "" for t in column[part].to_pylist()]
            low, size = i + 1, 0


def write_records(docs: DataFrame, folder: str, tokenizer: str, splitter: str, end_id: int = 1, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to folder in ascending order of id; a row for each shard. Writes at once."""
    spark = docs.sparkSession
    n = shards or shuffle_partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, base = fs.FileSystem.from_uri(folder)
        base = base.rstrip("/")
        store.create_dir(base, recursive=True)
        final = f"{base}/{shard:05d}"
        coder = encoder(tokenizer, splitter)
        end = np.array([end_id], coder.dtype).tobytes()
        offset = n_docs = n_tokens = 0
        with store.open_output_stream(f"{final}.rec.{attempt}") as rec, store.open_output_stream(f"{final}.idx.{attempt}") as idx:
            for batch in batches:
                for ids, run in text_runs(batch):
                    for doc_id, packed in zip(ids, coder.encode(run), strict=True):
                        count = (len(packed) + len(end)) // coder.dtype.itemsize
                        idx.write(struct.pack(_INDEX, offset, doc_id or 0, count))
                        record = frame(struct.pack(_ID, doc_id is None, doc_id or 0, coder.dtype.itemsize) + packed + end)
                        rec.write(record)
                        offset, n_docs, n_tokens = offset + len(record), n_docs + 1, n_tokens + count
        for kind in ("rec", "idx"):
            store.move(f"{final}.{kind}.{attempt}", f"{final}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{shard:05d}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ordered = texts(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return write_table(ordered.mapInArrow(write, SHARDS), "shards")


def read_records(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every record of write_records()'s shards, checked against its checksums."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(f"{row['path']}.rec")
                rows, size = [], 0
                with store.open_input_stream(path, buffer_size=1 << 20) as stream:
                    for k, payload in enumerate(frames(stream)):
                        null, doc_id, width = struct.unpack_from(_ID, payload)
                        ids = payload[_ID_SIZE :]
                        wide = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                        rows.append((row["shard"], k, None if null else doc_id, len(ids) // width, zlib.crc32(wide), ids if with_ids else None, width))
                        size += len(ids)
                        if size > 4_000_000 or len(rows) >= 5000:
                            yield _records(rows)
                            rows, size = [], 0
                yield _records(rows)

    return shards.select("shard", "path").repartition(shuffle_partitions(shards.sparkSession), "shard").mapInArrow(read, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    names = ["shard", "ordinal", "doc_id", "n_tokens", "ids_crc32", "ids", "width"]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_one(folder: str, shard: int, ordinal: int) -> tuple[int | None, np.ndarray]:
    """One record through the offset index: (id, token ids)."""
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{shard:05d}.idx") as idx:
        offset, _, _ = struct.unpack(_INDEX, idx.read_at(_INDEX_SIZE, ordinal * _INDEX_SIZE))
    with store.open_input_file(f"{base}/{shard:05d}.rec") as rec:
        rec.seek(offset)
        payload = next(frames(rec))
    null, doc_id, width = struct.unpack_from(_ID, payload)
    return None if null else doc_id, np.frombuffer(payload[_ID_SIZE :], f"<u{width}")


def record_digests(docs: DataFrame, tokenizer: str, splitter: str = "space", end_id: int = 1) -> DataFrame:
    """Write docs' records and return from the files: doc_id, start, n_tokens, ids_crc32, shard, ordinal.
    start counts the ids of all records before. Spark's share of it: a running sum over shards
    (as many rows as tasks) and one within a shard."""
    spark: SparkSession = docs.sparkSession
    shards = write_records(docs, work_path(spark, "records"), tokenizer, splitter, end_id)
    before = shards.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before"))
    rows = read_records(shards, with_ids=False).drop("ids", "width")
    inside = Window.partitionBy("shard").orderBy("ordinal")
    rows = rows.withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    joined = rows.join(F.broadcast(before), "shard")  # a row for each shard
    return joined.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "ordinal")
