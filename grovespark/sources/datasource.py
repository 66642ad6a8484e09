"""Python data sources for files of a repository. Register them once a session; read by format name:

    repo_loose  objects as single compressed files      (objects)
    repo_pack   packs, deltas resolved inside each       (pack_objects), one partition a pack
    repo_index  pack indexes                             (pack_index)
    repo_midx   multi-pack indexes                       (midx)
    repo_refs   loose and packed references              (refs)
    repo_tree   a directory's files as a snapshot        (path, mode, oid, content)
    repo_remote recorded listings of a remote            (remote_refs)
    repo_sizes  recorded sizes of a remote's objects     (oid, size)

Option path: a repository folder or the folder of the files; any URI that Arrow's file systems open. Filters on
oid (equality, prefix) and on name (prefix) are pushed down: the first two digits choose folders, and indexes are searched.
"""

from __future__ import annotations

import bisect
import os
import stat
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from grovespark.errors import InvalidObjectError, VersionDataError
from grovespark.functions.codecs import object_id
from grovespark.schema import EXECUTABLE, FILE, MIDX, OBJECTS, PACK_INDEX, PACK_OBJECTS, REFS, REMOTE_REFS, SYMLINK
from grovespark.plans import protocol
from grovespark.sources import packfile


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def list_files(path: str, suffix: str = "", recursive: bool = True) -> list[tuple[str, int]]:
    store, base = _store(path)
    if store.get_file_info(base).type == fs.FileType.File:
        return [(path, store.get_file_info(base).size)]
    found = store.get_file_info(fs.FileSelector(base, recursive=recursive, allow_not_found=True))
    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
    return sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.endswith(suffix))


def read_file(path: str) -> bytes:
    store, base = _store(path)
    with store.open_input_stream(base) as f:
        return f.read()


class FilePart(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _parts(paths: list[str], most: int = 1024) -> list[InputPartition]:
    """Files dealt to at most so many partitions."""
    n = max(1, min(most, len(paths)))
    return [FilePart(paths[k::n]) for k in range(n)]


class _Reader(DataSourceReader):
    column = "oid"

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.wanted: str | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters that choose by the key narrow what is read; Spark checks them again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.column,):
                self.wanted = self.prefix = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == (self.column,):
                self.prefix = max(self.prefix, f.value, key=len)
            yield f

    def hit(self, key: str) -> bool:
        return key.startswith(self.prefix)


def read_loose(data: bytes) -> tuple[str, bytes]:
    """(type, content) of a loose object's file."""
    raw = zlib.decompress(data)
    head, nul, content = raw.partition(b"\0")
    kind, _, size = head.decode(errors="replace").partition(" ")
    if not nul or kind not in packfile.PACK_TYPE_NUMBERS or not size.isdigit() or int(size) != len(content):
        raise InvalidObjectError("the header doesn't hold")
    return kind, content


class LooseReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        base = f"{self.path}/objects" if list_files(f"{self.path}/objects") else self.path
        if len(self.prefix) >= 2:
            base = f"{base}/{self.prefix[:2]}"
        kept = []
        for path, _ in list_files(base):
            folder, name = path.rsplit("/", 2)[-2:]
            if len(folder) == 2 and len(name) == 38 and all(c in "0123456789abcdef" for c in folder + name) and self.hit(folder + name):
                kept.append(path)
        return _parts(kept)

    def read(self, partition):
        for path in partition.paths:
            oid = "".join(path.rsplit("/", 2)[-2:])
            kind, content = read_loose(read_file(path))
            yield oid, kind, len(content), content


class PackReader(_Reader):
    def partitions(self):
        return [FilePart([p]) for p, _ in list_files(self.path, ".pack")] or [FilePart([])]

    def read(self, partition):
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            try:
                for e in packfile.read_objects(read_file(path)):
                    if self.hit(e.oid):
                        yield name, e.offset, e.type, e.base_offset, e.base_oid, e.oid, e.content, None
            except VersionDataError as error:
                yield name, None, None, None, None, None, None, str(error)


class IndexReader(_Reader):
    def partitions(self):
        return _parts([p for p, _ in list_files(self.path, ".idx")])

    def read(self, partition):
        for path in partition.paths:
            rows, _ = packfile.read_index(read_file(path))
            low = bisect.bisect_left(rows, (self.prefix,))
            for oid, offset, crc in rows[low:]:
                if not self.hit(oid):
                    break
                yield path.rsplit("/", 1)[-1].removesuffix(".idx") + ".pack", oid, offset, crc


class MidxReader(_Reader):
    def partitions(self):
        return _parts([p for p, _ in list_files(self.path) if p.endswith(".midx") or p.endswith("multi-pack-index")])

    def read(self, partition):
        for path in partition.paths:
            names, rows = packfile.read_midx(read_file(path))
            low = bisect.bisect_left(rows, (self.prefix,))
            for oid, pack, offset in rows[low:]:
                if not self.hit(oid):
                    break
                yield oid, pack, names[pack].removesuffix(".idx") + ".pack", offset


def parse_packed_refs(text: str) -> Iterator[tuple[str, str]]:
    for line in text.splitlines():
        if line and line[0] not in "#^":
            oid, _, name = line.partition(" ")
            if name:
                yield name, oid


class RefsReader(_Reader):
    column = "name"

    def partitions(self):
        return [FilePart([self.path])]

    def read(self, partition):
        """Loose references hide packed ones of the same name."""
        found: dict[str, str] = {}
        for path, _ in list_files(self.path, recursive=False):
            if path.endswith("/packed-refs"):
                found |= dict(parse_packed_refs(read_file(path).decode()))
        names = [(p, p[p.index("/refs/", len(self.path) - 1) + 1 :]) for p, _ in list_files(f"{self.path}/refs") if "/refs/" in p]
        for path, name in [*names, (f"{self.path}/HEAD", "HEAD")]:
            if not path.endswith(".lock") and self.hit(name) and list_files(path):
                found[name] = read_file(path).decode().rstrip("\r\n")
        yield from sorted((n, t) for n, t in found.items() if self.hit(n))


class TreeReader(_Reader):
    """A local directory; links are read as links, and repository folders are passed over."""

    column = "path"

    def partitions(self):
        return [FilePart([self.path])]

    def read(self, partition):
        def walk(folder: str, prefix: str):
            for item in sorted(os.scandir(folder), key=lambda i: i.name):
                if item.name == ".git":
                    continue
                path = f"{prefix}{item.name}"
                if item.is_symlink():
                    content = os.readlink(item.path).encode()
                    yield path, SYMLINK, object_id("blob", content), content
                elif item.is_dir():
                    yield from walk(item.path, f"{path}/")
                elif item.is_file():
                    content = read_file(item.path)
                    mode = EXECUTABLE if item.stat().st_mode & stat.S_IXUSR else FILE
                    yield path, mode, object_id("blob", content), content

        yield from walk(self.path, "")


class RemoteReader(_Reader):
    """Files that hold a server's listing, of either protocol version."""

    column = "name"

    def partitions(self):
        return _parts([p for p, _ in list_files(self.path)])

    def read(self, partition):
        for path in partition.paths:
            data = read_file(path)
            old = data[4:14] == b"# service=" or b"\0" in data[:2000]
            for r in protocol.parse_advertisement(data).refs if old else protocol.parse_listing(data):
                if self.hit(r["name"]):
                    yield r["name"], r["oid"], r["peeled"], r["symref_target"]


class SizesReader(_Reader):
    def partitions(self):
        return _parts([p for p, _ in list_files(self.path)])

    def read(self, partition):
        for path in partition.paths:
            yield from ((o, n) for o, n in protocol.parse_sizes(read_file(path)).items() if self.hit(o))


def _source(name: str, schema, reader) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return reader(self.options)

    return Source


SOURCES = {
    "repo_loose": (OBJECTS, LooseReader),
    "repo_pack": (PACK_OBJECTS, PackReader),
    "repo_index": (PACK_INDEX, IndexReader),
    "repo_midx": (MIDX, MidxReader),
    "repo_refs": (REFS, RefsReader),
    "repo_remote": (REMOTE_REFS, RemoteReader),
    "repo_sizes": ("oid string, size bigint", SizesReader),
    "repo_tree": ("path string, mode string, oid string, content binary", TreeReader),
}


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for name, (schema, reader) in SOURCES.items():
        spark.dataSource.register(_source(name, schema, reader))
