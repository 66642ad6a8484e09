"""Sinks: loose objects, packs with their indexes, multi-pack indexes, references and whole repositories.

Files appear under their final names by a rename, so a task that is run again does no harm. A pack is one file and so
one task's work; many packs are written at once by giving rows a pack number.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.errors import PackIndexError, TransactionError
from grovespark.functions.codecs import framed, object_id
from grovespark.functions.names import require_ref_name
from grovespark.operators import packs as P
from grovespark.sources import packfile
from grovespark.sources.datasource import _store, list_files, read_file
from grovespark.storage import Scratch


def put_file(path: str, data: bytes) -> None:
    store, base = _store(path)
    store.create_dir(base.rsplit("/", 1)[0], recursive=True)
    part = f"{base}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, base)


def put_pieces(folder: str, pieces: Iterator[bytes], name) -> str:
    """A file of pieces, one after the other; name: its path by its last 20 bytes."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    part, tail = f"{base}/{uuid.uuid4().hex}", b""
    with store.open_output_stream(part) as f:
        for piece in pieces:
            f.write(piece)
            tail = (tail + piece)[-20:]
    path = name(tail.hex())
    store.move(part, _store(path)[1])
    return path


def write_loose(objects: DataFrame, folder: str) -> DataFrame:
    """Every object (type, content) as a compressed file under folder; (oid) of those written. Ids that are there are passed over."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for kind, content in zip(batch.column("type").to_pylist(), batch.column("content").to_pylist(), strict=True):
                o = object_id(kind, content)
                path = f"{folder}/{o[:2]}/{o[2:]}"
                store, base = _store(path)
                if store.get_file_info(base).type == fs.FileType.NotFound:
                    put_file(path, zlib.compress(framed(kind, content)))
                ids.append(o)
            yield pa.RecordBatch.from_pydict({"oid": pa.array(ids, pa.string())})

    return objects.select("type", "content").mapInArrow(write, "oid string")


def delete_loose(spark: SparkSession, folder: str, oids: DataFrame) -> int:
    """Unlink loose objects; how many there were."""

    def unlink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for o in batch.column("oid").to_pylist():
                store, base = _store(f"{folder}/{o[:2]}/{o[2:]}")
                if store.get_file_info(base).type == fs.FileType.File:
                    store.delete_file(base)
                    n += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return oids.select("oid").distinct().mapInArrow(unlink, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def write_packs(objects: DataFrame, folder: str, pack: str = "pack", order: str = "seq") -> DataFrame:
    """objects (pack, seq, type, content) as one pack and index a pack number: (pack, name, objects)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            made = packfile.write_pack(held)
            put_file(f"{folder}/pack-{made.checksum}.pack", made.data)
            put_file(f"{folder}/pack-{made.checksum}.idx", packfile.write_index(made.index, made.checksum))
            return pa.RecordBatch.from_pydict({"pack": [str(now)], "name": [f"pack-{made.checksum}.pack"], "objects": pa.array([len(made.index)], pa.int64())})

        for batch in batches:
            for number, kind, content in zip(*(batch.column(k).to_pylist() for k in ("pack", "type", "content")), strict=True):
                if now is not None and number != now:
                    yield done()
                    held = []
                now = number
                held.append((kind, content))
        if now is not None:
            yield done()

    rows = objects.select(F.col(pack).cast("string").alias("pack"), F.col(order).alias("seq"), "type", "content")
    return rows.repartition("pack").sortWithinPartitions("pack", "seq").mapInArrow(write, "pack string, name string, objects long")


def _write_midx(index: DataFrame, folder: str, name, preferred: str | None = None, base_layers: int = 0) -> tuple[str, int]:
    """(path, ids) of a multi-pack index over (pack, oid, offset). Ids are sorted by ranges of their first byte, each one task's, and
    packed there; the file is one sequence, which the driver writes from those ranges with one of them in memory. The
    packs' names come to the driver: they are in the file."""
    spark = index.sparkSession
    names = sorted(r["pack"] for r in index.select("pack").distinct().collect())
    numbers = spark.createDataFrame(list(enumerate(names)), "pack_id int, pack string")
    best = P.winners(index.join(numbers, "pack").select("oid", "pack_id", "offset"), names.index(preferred) if preferred in names else None)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            oids, owners, offsets = (b"".join(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({"first": pa.array([now], pa.int32()), "oids": [oids], "packs": [owners], "offsets": [offsets], "large": pa.array([int((np.frombuffer(offsets, ">u8") >= packfile.LARGE).sum())], pa.int64())})

        for batch in batches:
            firsts, oids = batch.column("first").to_numpy(), batch.column("oid").to_pylist()
            owners, offsets = batch.column("pack_id").to_numpy().astype(">u4"), batch.column("offset").to_numpy().astype(">u8")
            cuts = [0, *(np.flatnonzero(firsts[1:] != firsts[:-1]) + 1).tolist(), len(firsts)] if len(firsts) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if now is not None and firsts[a] != now:
                    yield done()
                    held = []
                now = int(firsts[a])
                held.append((bytes.fromhex("".join(oids[a:b])), owners[a:b].tobytes(), offsets[a:b].tobytes()))
        if now is not None:
            yield done()

    rows = best.select(F.conv(F.substring("oid", 1, 2), 16, 10).cast("int").alias("first"), "oid", "pack_id", "offset").repartition("first").sortWithinPartitions("first", "oid")
    parts = Scratch(spark).keep(rows.mapInArrow(pack, "first int, oids binary, packs binary, offsets binary, large long"))
    counts, large = [0] * 256, 0
    for r in parts.select("first", (F.octet_length("oids") / 20).cast("long").alias("n"), "large").collect():  # 256 rows at most
        counts[r["first"]], large = r["n"], large + r["large"]
    stream = lambda: ((bytes(r["oids"]), bytes(r["packs"]), bytes(r["offsets"])) for r in parts.select("first", "oids", "packs", "offsets").orderBy("first").toLocalIterator())
    pieces = packfile.midx_pieces([n.removesuffix(".pack") + ".idx" for n in names], counts, large, stream, base_layers)
    return put_pieces(folder, pieces, name), sum(counts)


def write_multi_index(index: DataFrame, path: str, preferred: str | None = None) -> int:
    """One index over packs (pack, oid, offset), duplicates resolved; how many ids it has."""
    return _write_midx(index, path.rsplit("/", 1)[0], lambda _: path, preferred)[1]


def write_refs(folder: str, refs: list[tuple[str, str]]) -> None:
    """Loose references (name, target). All names are checked before any is written."""
    for name, _ in refs:
        require_ref_name(name)
    for name, target in refs:
        put_file(f"{folder}/{name}", f"{target}\n".encode())


def delete_packed_ref(folder: str, name: str) -> None:
    """Rewrite packed-refs without a name and the peeled line that follows it."""
    path = f"{folder}/packed-refs"
    if not list_files(path):
        return
    kept, drop = [], False
    for line in read_file(path).decode().splitlines():
        if line.startswith("^"):
            if not drop:
                kept.append(line)
            continue
        drop = line.partition(" ")[2] == name and not line.startswith("#")
        if not drop:
            kept.append(line)
    put_file(path, ("\n".join(kept) + "\n").encode())


def write_shallow(folder: str, oids: DataFrame) -> None:
    """The shallow list (oid), sorted; an empty one is no file. Ids are sorted by ranges and tasks join their lines; the driver writes
    them one range after the other."""
    path = f"{folder}/shallow"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"lines": [("\n".join(batch.column("oid").to_pylist()) + "\n").encode()]})

    pieces = (bytes(r["lines"]) for r in oids.select("oid").orderBy("oid").mapInArrow(lines, "lines binary").toLocalIterator())
    first = next(pieces, None)
    if first is not None:
        put_pieces(folder, itertools.chain([first], pieces), lambda _: path)
    else:
        store, base = _store(path)
        if store.get_file_info(base).type == fs.FileType.File:
            store.delete_file(base)


def init_repository(folder: str, branch: str = "refs/heads/main") -> None:
    if list_files(f"{folder}/HEAD"):
        raise TransactionError(f"{folder} is a repository already")
    store, base = _store(folder)
    for part in ("objects/pack", "objects/info", "refs/heads", "refs/tags"):
        store.create_dir(f"{base}/{part}", recursive=True)
    put_file(f"{folder}/HEAD", f"ref: {branch}\n".encode())


def swap_table(df: DataFrame, folder: str) -> str:
    """A new version of a table and a pointer that names it: readers see the old one or the new one. The version before stays."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{folder}/{version}")
    put_file(f"{folder}/CURRENT", version.encode())
    return version


def read_table(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{folder}/{version or read_file(f'{folder}/CURRENT').decode()}")


def chain_layers(folder: str) -> list[str]:
    """Paths of an incremental multi-pack index's layers, base first; none where the chain or a layer is damaged."""
    chain = f"{folder}/multi-pack-index.d/multi-pack-index-chain"
    try:
        names = read_file(chain).decode().split()
        paths = [f"{folder}/multi-pack-index.d/multi-pack-index-{n}.midx" for n in names]
        for name, path in zip(names, paths, strict=True):
            data = read_file(path)
            packfile.read_midx(data)
            if data[-20:].hex() != name:
                return []
        return paths
    except (OSError, PackIndexError):
        return []


def chain_index(spark: SparkSession, folder: str) -> DataFrame:
    """(layer, oid, pack, offset): every layer's rows; newest_layer() of it is the look-up."""
    paths = spark.createDataFrame(list(enumerate(chain_layers(folder))), "layer int, path string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer, path in zip(batch.column("layer").to_pylist(), batch.column("path").to_pylist(), strict=True):
                names, rows = packfile.read_midx(read_file(path))
                o, p, at = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([layer] * len(o), pa.int32()), pa.array(o, pa.string()), pa.array([names[k].removesuffix(".idx") + ".pack" for k in p], pa.string()), pa.array(at, pa.int64())], ["layer", "oid", "pack", "offset"])

    return paths.repartition("path").mapInArrow(read, "layer int, oid string, pack string, offset long")


def write_incremental_index(index: DataFrame, folder: str) -> int:
    """A new layer over packs (pack, oid, offset): ids that no layer has yet; how many. Without new ids nothing is written."""
    spark, layers = index.sparkSession, chain_layers(folder)
    base = chain_index(spark, folder).select("oid") if layers else spark.createDataFrame([], "oid string")
    fresh = Scratch(spark).keep(index.select("pack", "oid", "offset").join(base, "oid", "left_anti"))
    if fresh.isEmpty():
        return 0
    where = f"{folder}/multi-pack-index.d"
    path, n = _write_midx(fresh, where, lambda checksum: f"{where}/multi-pack-index-{checksum}.midx", base_layers=len(layers))
    known = [p.rsplit("-", 1)[-1].removesuffix(".midx") for p in [*layers, path]]
    put_file(f"{where}/multi-pack-index-chain", "\n".join([*known, ""]).encode())
    return n
