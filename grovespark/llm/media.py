"""Texts as media columns: stored as lossless WebP images, read back, and described.

The payload of a text is its UTF-8 bytes (null: none), with zeros to a positive multiple of 64; its bytes are the samples of a
grey image, which is coded with prefix codes of its own, back-references and the subtract-green transform. The
image column is written as a table in the shared folder and decoded from what is read there, to arrays of pixels. A feature is
the image's size and a histogram of its samples' high halves, so equal texts have equal features. Nothing is
shuffled; a task holds a batch. Repeated rows and null ids are rows like others; an empty table gives an empty one; columns other than
the id and the text are left out. ValueError for a text beyond 256 MiB, the largest image of the format.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.llm.binary_records import text_runs
from grovespark.llm.shared import texts, write_table
from grovespark.llm.webp import bytes_to_webp, decode

MEDIA = "doc_id long, n_bytes long, payload_bytes long, media binary"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media for every row of docs; written at once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, run in text_runs(batch):
                raw = [t.encode() for t in run]
                payloads = [padded(r) for r in raw]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([len(p) for p in payloads], pa.int64()), pa.array([bytes_to_webp(p) for p in payloads], pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return write_table(texts(docs).mapInArrow(encode, MEDIA), "media")


def feature(pixels: np.ndarray) -> str:
    """Height x width, and how many samples of green have each high half."""
    counts = np.bincount(pixels[..., 1].ravel() >> 4, minlength=16)
    return f"{pixels.shape[0]}x{pixels.shape[1]}:" + ",".join(map(str, counts.tolist()))


def describe(media: DataFrame) -> DataFrame:
    """Decode store()'s images: digests of payload and stored form, and the feature."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, size in zip(batch.column("media"), batch.column("payload_bytes").to_pylist(), strict=True):
                stored = image.as_py()
                pixels = decode(stored)
                payload = pixels[..., 1].tobytes()[:size]
                rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(pixels)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kept = batch.select(["doc_id", "n_bytes", "payload_bytes"])
            for name, kind, column in zip(names, kinds, columns, strict=True):
                kept = kept.append_column(name, pa.array(column, kind))
            yield kept

    return media.mapInArrow(read, DIGESTS)


def pixels(media: DataFrame, column: str = "media", id_col: str = "doc_id") -> DataFrame:
    """doc_id, height, width, pixels of lossless WebP files in a column: the pixels' red, green, blue and alpha, row by row.
    A null image has nulls; ValueError for one that is damaged."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, image in enumerate(batch.column("media")):
                found = decode(image.as_py()) if image.is_valid else None
                row = [None] * 3 if found is None else [found.shape[0], found.shape[1], found.tobytes()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 1), *[pa.array([x], kind) for x, kind in zip(row, (pa.int32(), pa.int32(), pa.binary()), strict=True)]], ["doc_id", "height", "width", "pixels"])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(column).alias("media")).mapInArrow(read, "doc_id long, height int, width int, pixels binary")
