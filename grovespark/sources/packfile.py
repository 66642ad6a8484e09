"""Packs, their indexes, multi-pack indexes and reachability bitmaps: reading and writing the bytes.

Pure functions over bytes; grovespark.sources.datasource makes tables of them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from grovespark.errors import InvalidPackError, PackError, PackIndexError
from grovespark.functions.codecs import apply_delta, decode_base_offset, decode_object_header, encode_object_header, object_id
from grovespark.schema import PACK_TYPE_NUMBERS

# Fixed values of the formats.
NAMES = {v: k for k, v in PACK_TYPE_NUMBERS.items()}
PACK_MAGIC, INDEX_MAGIC, MIDX_MAGIC, BITMAP_MAGIC = b"PACK", b"\xfftOc", b"MIDX", b"BITM"
LARGE = 1 << 31


@dataclass
class Entry:
    offset: int
    type: str
    content: bytes | None
    oid: str | None
    base_offset: int | None = None
    base_oid: str | None = None
    end: int = 0


def read_header(data: bytes) -> int:
    """The number of objects; the magic, version and trailing checksum are checked."""
    if len(data) < 32 or data[:4] != PACK_MAGIC:
        raise InvalidPackError("no pack")
    version, count = struct.unpack(">II", data[4:12])
    if version != 2:
        raise InvalidPackError(f"pack version {version}")
    if hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise InvalidPackError("the checksum differs")
    return count


def read_entries(data: bytes) -> list[Entry]:
    """Entries in order, with deltas as they are stored."""
    out, at = [], 12
    for _ in range(read_header(data)):
        start = at
        try:
            number, size, n = decode_object_header(data, at)
            at += n
            if number not in NAMES:
                raise InvalidPackError(f"object type {number}")
            entry = Entry(start, NAMES[number], None, None)
            if number == 6:
                back, n = decode_base_offset(data, at)
                at += n
                entry.base_offset = start - back
            elif number == 7:
                entry.base_oid = data[at : at + 20].hex()
                at += 20
            engine = zlib.decompressobj()
            entry.content = engine.decompress(data[at:-20]) + engine.flush()
        except (ValueError, zlib.error) as e:
            raise InvalidPackError(f"the entry at {start}: {e}") from None
        at = len(data) - 20 - len(engine.unused_data)
        if len(entry.content) != size:
            raise InvalidPackError(f"the entry at {start} has another size")
        entry.end = at
        if number < 5:
            entry.oid = object_id(entry.type, entry.content)
        out.append(entry)
    if at != len(data) - 20:
        raise InvalidPackError("bytes after the last entry")
    return out


def read_objects(data: bytes, external=None) -> list[Entry]:
    """Entries with deltas resolved. external: oid -> (type, content) or None, for bases outside the pack (a thin pack)."""
    entries = read_entries(data)
    by_offset, by_oid = {}, {}
    waiting = []

    def settle(e: Entry, kind: str, content: bytes) -> None:
        e.type, e.content, e.oid = kind, content, object_id(kind, content)
        by_offset[e.offset] = e
        by_oid.setdefault(e.oid, e)

    for e in entries:
        if e.base_offset is None and e.base_oid is None:
            settle(e, e.type, e.content)
        elif e.base_offset is not None and e.base_offset in by_offset:
            base = by_offset[e.base_offset]
            settle(e, base.type, apply_delta(base.content, e.content))
        else:
            waiting.append(e)
    while waiting:
        left = []
        for e in waiting:
            base = by_offset.get(e.base_offset) if e.base_offset is not None else by_oid.get(e.base_oid)
            if base:
                settle(e, base.type, apply_delta(base.content, e.content))
            elif e.base_oid and external and (found := external(e.base_oid)):
                settle(e, found[0], apply_delta(found[1], e.content))
            else:
                left.append(e)
        if len(left) == len(waiting):
            raise PackError(f"no base for the entry at {left[0].offset}")
        waiting = left
    return entries


@dataclass
class Written:
    data: bytes
    checksum: str
    index: list[tuple[str, int, int]] = field(default_factory=list)  # oid, offset, crc32


def write_pack(objects) -> Written:
    """A pack of (type, content) in order, whole objects, each id once."""
    seen, body, index = set(), [], []
    at = 12
    for kind, content in objects:
        o = object_id(kind, content)
        if o in seen:
            continue
        seen.add(o)
        raw = encode_object_header(PACK_TYPE_NUMBERS[kind], len(content)) + zlib.compress(content)
        index.append((o, at, zlib.crc32(raw)))
        body.append(raw)
        at += len(raw)
    data = PACK_MAGIC + struct.pack(">II", 2, len(body)) + b"".join(body)
    digest = hashlib.sha1(data)
    return Written(data + digest.digest(), digest.hexdigest(), index)


def _fanout(oids: list[str]) -> bytes:
    counts = [0] * 256
    for o in oids:
        counts[int(o[:2], 16)] += 1
    total, out = 0, []
    for n in counts:
        total += n
        out.append(total)
    return struct.pack(">256I", *out)


def write_index(rows: list[tuple[str, int, int]], pack_checksum: str) -> bytes:
    """Version 2: ids sorted, with fan-out, CRCs, offsets of 31 bits and a table of larger ones."""
    rows = sorted(rows)
    small, large = [], []
    for _, offset, _ in rows:
        if offset < LARGE:
            small.append(offset)
        else:
            small.append(LARGE | len(large))
            large.append(offset)
    n = len(rows)
    body = INDEX_MAGIC + struct.pack(">I", 2) + _fanout([r[0] for r in rows]) + b"".join(bytes.fromhex(r[0]) for r in rows)
    body += struct.pack(f">{n}I", *[r[2] for r in rows]) + struct.pack(f">{n}I", *small) + struct.pack(f">{len(large)}Q", *large) + bytes.fromhex(pack_checksum)
    return body + hashlib.sha1(body).digest()


def read_index(data: bytes) -> tuple[list[tuple[str, int, int]], str]:
    """((oid, offset, crc32) by id, the pack's checksum)."""
    if len(data) < 1072 or data[:4] != INDEX_MAGIC or data[4:8] != b"\0\0\0\2":
        raise PackIndexError("no index of version 2")
    if hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise PackIndexError("the checksum differs")
    n = struct.unpack(">I", data[1028:1032])[0]
    at = 1032
    oids = [data[at + 20 * k : at + 20 * k + 20].hex() for k in range(n)]
    at += 20 * n
    crcs = struct.unpack_from(f">{n}I", data, at)
    offsets = list(struct.unpack_from(f">{n}I", data, at + 4 * n))
    large = at + 8 * n
    for k, o in enumerate(offsets):
        if o & LARGE:
            offsets[k] = struct.unpack_from(">Q", data, large + 8 * (o ^ LARGE))[0]
    return list(zip(oids, offsets, crcs, strict=True)), data[-40:-20].hex()


def read_chunks(data: bytes, at: int, count: int) -> dict[bytes, bytes]:
    """The chunks that a table of contents of 12-byte rows names."""
    rows = list(struct.iter_unpack(">4sQ", data[at : at + 12 * (count + 1)]))
    if len(rows) != count + 1 or rows[-1][0] != b"\0\0\0\0":
        raise PackIndexError("the table of contents is damaged")
    out = {}
    for (name, low), (_, high) in zip(rows, rows[1:], strict=False):
        if name in out or not low <= high <= len(data):
            raise PackIndexError("a chunk is damaged")
        out[name] = data[low:high]
    return out


def _padded_names(names: list[str]) -> bytes:
    raw = b"".join(n.encode() + b"\0" for n in names)
    return raw + bytes(-len(raw) % 4)


def midx_pieces(packs: list[str], counts: list[int], large: int, parts, base_layers: int = 0):
    """The bytes of a multi-pack index, piece by piece, its checksum last. counts: ids by first byte; large: how many offsets
    take more than 31 bits; parts(): an iterator over (ids, packs, offsets) in the order of ids, each one's bytes in a row
    (20, 4 and 8 for each), which is read three times."""
    n = sum(counts)
    total, fan = 0, []
    for c in counts:
        total += c
        fan.append(total)
    names = _padded_names(packs)
    chunks = [(b"PNAM", len(names)), (b"OIDF", 1024), (b"OIDL", 20 * n), (b"OOFF", 8 * n)] + [(b"LOFF", 8 * large)] * bool(large)
    head = MIDX_MAGIC + struct.pack(">BBBBI", 1, 1, len(chunks), base_layers, len(packs))
    at, toc = len(head) + 12 * (len(chunks) + 1), b""
    for name, size in chunks:
        toc += struct.pack(">4sQ", name, at)
        at += size

    def body():
        yield head + toc + struct.pack(">4sQ", b"\0\0\0\0", at) + names + struct.pack(">256I", *fan)
        for oids, _, _ in parts():
            yield oids
        far = 0
        for _, owners, offsets in parts():
            place = np.frombuffer(offsets, ">u8").astype(np.int64)
            beyond = place >= LARGE
            place[beyond] = LARGE | (far + np.arange(int(beyond.sum())))
            far += int(beyond.sum())
            yield np.stack([np.frombuffer(owners, ">u4").astype(np.int64), place], axis=1).astype(">u4").tobytes()
        for _, _, offsets in parts() if large else ():
            place = np.frombuffer(offsets, ">u8")
            yield place[place >= LARGE].tobytes()

    digest = hashlib.sha1()
    for piece in body():
        digest.update(piece)
        yield piece
    yield digest.digest()


def write_midx(packs: list[str], rows: list[tuple[str, int, int]], base_layers: int = 0) -> bytes:
    """rows: (oid, pack number, offset), each id once. packs: names in the order of their numbers."""
    rows = sorted(rows)
    counts = [0] * 256
    for o, _, _ in rows:
        counts[int(o[:2], 16)] += 1
    part = (b"".join(bytes.fromhex(o) for o, _, _ in rows), struct.pack(f">{len(rows)}I", *[p for _, p, _ in rows]), struct.pack(f">{len(rows)}Q", *[o for _, _, o in rows]))
    return b"".join(midx_pieces(packs, counts, sum(o >= LARGE for _, _, o in rows), lambda: iter([part]), base_layers))


def read_midx(data: bytes) -> tuple[list[str], list[tuple[str, int, int]]]:
    """(pack names, (oid, pack number, offset) by id)."""
    if data[:4] != MIDX_MAGIC or data[4] not in (1, 2) or data[5] != 1:
        raise PackIndexError("no multi-pack index")
    if hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise PackIndexError("the checksum differs")
    count, packs = data[6], struct.unpack(">I", data[8:12])[0]
    chunks = read_chunks(data[:-20], 12, count)
    for name in (b"PNAM", b"OIDF", b"OIDL", b"OOFF"):
        if name not in chunks:
            raise PackIndexError(f"no chunk {name.decode()}")
    names = [n.decode() for n in chunks[b"PNAM"].split(b"\0") if n][:packs]
    large = [x[0] for x in struct.iter_unpack(">Q", chunks.get(b"LOFF", b""))]
    rows = []
    for k, (pack, offset) in enumerate(struct.iter_unpack(">II", chunks[b"OOFF"])):
        rows.append((chunks[b"OIDL"][20 * k : 20 * k + 20].hex(), pack, large[offset ^ LARGE] if offset & LARGE and large else offset))
    return names, rows


def decode_ewah(data: bytes, at: int = 0) -> tuple[set[int], int]:
    """(positions of set bits, bytes read) of a compressed bitmap: runs of 64-bit words and literal words, by the published
    scheme (the run's bit lowest, then its length in words, then the number of literals)."""
    bits, words = struct.unpack_from(">II", data, at)
    row = struct.unpack_from(f">{words}Q", data, at + 8)
    out, place, k = set(), 0, 0
    while k < words:
        marker = row[k]
        run, literals = marker >> 1 & 0xFFFFFFFF, marker >> 33
        if marker & 1:
            out.update(range(place, place + 64 * run))
        place += 64 * run
        for word in row[k + 1 : k + 1 + literals]:
            out.update(place + b for b in range(64) if word >> b & 1)
            place += 64
        k += 1 + literals
    return {b for b in out if b < bits}, 8 + 8 * words + 4


def encode_ewah(positions: set[int], bits: int) -> bytes:
    """One run of no words and literals for all: valid, and read back as it is."""
    words = [0] * ((bits + 63) // 64)
    for p in positions:
        words[p >> 6] |= 1 << (p & 63)
    row = [len(words) << 33, *words]
    return struct.pack(">II", bits, len(row)) + struct.pack(f">{len(row)}Q", *row) + struct.pack(">I", 0)


def read_bitmap(data: bytes) -> tuple[dict[str, set[int]], dict[int, set[int]], str]:
    """(positions by type, positions reached by a commit's position, the pack's checksum)."""
    if data[:4] != BITMAP_MAGIC or data[4:6] != b"\0\1":
        raise PackIndexError("no bitmap of version 1")
    count, at, types = struct.unpack(">I", data[8:12])[0], 32, {}
    for kind in ("commit", "tree", "blob", "tag"):
        types[kind], n = decode_ewah(data, at)
        at += n
    rows, entries = [], {}
    for _ in range(count):
        position, back, _flags = struct.unpack_from(">IBB", data, at)
        own, n = decode_ewah(data, at + 6)
        at += 6 + n
        rows.append(own ^ rows[len(rows) - back] if back else own)
        entries[position] = rows[-1]
    return types, entries, data[12:32].hex()


def write_bitmap(types: dict[str, set[int]], entries: dict[int, set[int]], objects: int, pack_checksum: str, xor: bool = False) -> bytes:
    """xor: every entry but the first as its difference from the one before."""
    body = BITMAP_MAGIC + struct.pack(">HHI", 1, 1, len(entries)) + bytes.fromhex(pack_checksum)
    for kind in ("commit", "tree", "blob", "tag"):
        body += encode_ewah(types.get(kind, set()), objects)
    before = None
    for position, reached in entries.items():
        back = int(xor and before is not None)
        body += struct.pack(">IBB", position, back, 0) + encode_ewah(reached ^ before if back else reached, objects)
        before = reached
    return body + hashlib.sha1(body).digest()
