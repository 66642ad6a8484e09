"""Byte formats in Python: trees, commits, tags, variable-length numbers, deltas, frames.

Pure functions over bytes, wrapped at the end as Arrow-batched UDFs and table functions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grovespark.errors import DeltaError, InvalidObjectError, PktLineError
from grovespark.functions.authors import parse_author_text
from grovespark.schema import AUTHOR, HEADERS


def framed(kind: str, content: bytes) -> bytes:
    return b"%s %d\0%s" % (kind.encode(), len(content), content)


def object_id(kind: str, content: bytes) -> str:
    return hashlib.sha1(framed(kind, content)).hexdigest()


# Trees


def encode_tree(entries: list[tuple[str, str, str]]) -> bytes:
    """(mode, name, oid) in the order given."""
    return b"".join(f"{mode.removeprefix('0') if mode == '040000' else mode} {name}".encode() + b"\0" + bytes.fromhex(oid) for mode, name, oid in entries)


def decode_tree(body: bytes) -> list[tuple[str, str, str]]:
    out, at = [], 0
    while at < len(body):
        space = body.find(b" ", at)
        nul = body.find(b"\0", space)
        if space < 0 or nul < 0 or nul + 21 > len(body):
            raise InvalidObjectError("a tree entry is cut off")
        mode = body[at:space].decode()
        out.append(("040000" if mode == "40000" else mode, body[space + 1 : nul].decode(errors="surrogateescape"), body[nul + 1 : nul + 21].hex()))
        at = nul + 21
    return out


# Headers of commits and tags


def author_text(a: dict) -> str:
    return f"{a['name']} <{a['email']}> {a['timestamp']} {a['timezone']}"


def split_headers(text: str, required_blank: bool) -> tuple[list[tuple[str, str]], str]:
    """((name, value) in order, message). Lines that begin with a space go on the value before."""
    head, blank, message = text.partition("\n\n")
    if text.startswith("\n"):
        head, blank, message = "", "\n", text[1:]
    if not blank and required_blank:
        raise InvalidObjectError("no blank line before the message")
    headers: list[list[str]] = []
    for line in head.removesuffix("\n").split("\n") if head else []:
        if line.startswith(" "):
            if not headers:
                raise InvalidObjectError("a continuation without a header")
            headers[-1][1] += "\n" + line[1:]
            continue
        name, space, value = line.partition(" ")
        if not space:
            raise InvalidObjectError(f"a header without a value: {line}")
        headers.append([name, value])
    return [(n, v) for n, v in headers], message


def header_lines(name: str, value: str) -> str:
    return f"{name} {value}".replace("\n", "\n ") + "\n"


def check_extra_header(name: str, built_in: tuple[str, ...]) -> None:
    if not name or name in built_in or " " in name or "\0" in name or "\n" in name:
        raise InvalidObjectError(f"no name for an extra header: {name!r}")


COMMIT_HEADERS = ("tree", "parent", "author", "committer", "encoding", "gpgsig", "mergetag")
TAG_HEADERS = ("object", "type", "tag", "tagger", "gpgsig")


def _singles(found: dict[str, list[str]], names: tuple[str, ...], needed: tuple[str, ...]) -> None:
    for name in names:
        if len(found[name]) > 1:
            raise InvalidObjectError(f"{name} is there twice")
    for name in needed:
        if not found[name]:
            raise InvalidObjectError(f"no {name}")


def decode_commit(content: bytes) -> dict:
    headers, message = split_headers(content.decode(errors="surrogateescape"), False)
    found: dict[str, list[str]] = defaultdict(list)
    for name, value in headers:
        found[name].append(value)
    _singles(found, ("tree", "author", "committer", "encoding", "gpgsig"), ("tree", "author", "committer"))
    people = {k: parse_author_text(found[k][0]) for k in ("author", "committer")}
    if None in people.values():
        raise InvalidObjectError("an author line has another form")
    return {
        "tree": found["tree"][0], "parents": found["parent"], **people, "encoding": next(iter(found["encoding"]), None), "gpgsig": next(iter(found["gpgsig"]), None),
        "mergetag": found["mergetag"], "extra_headers": [{"name": n, "value": v} for n, v in headers if n not in COMMIT_HEADERS], "message": message.removesuffix("\n"),
    }


def encode_commit(c: dict) -> bytes:
    """Headers in canonical order; the message ends in one line end."""
    extra = c.get("extra_headers") or []
    for h in extra:
        check_extra_header(h["name"], COMMIT_HEADERS)
    parts = [header_lines("tree", c["tree"]), *[header_lines("parent", p) for p in c.get("parents") or []], header_lines("author", author_text(c["author"])), header_lines("committer", author_text(c.get("committer") or c["author"]))]
    parts += [header_lines(k, c[k]) for k in ("encoding", "gpgsig") if c.get(k)]
    parts += [header_lines("mergetag", m) for m in c.get("mergetag") or []] + [header_lines(h["name"], h["value"]) for h in extra]
    return ("".join(parts) + "\n" + c["message"].rstrip("\n") + "\n").encode(errors="surrogateescape")


def decode_tag(content: bytes) -> dict:
    headers, message = split_headers(content.decode(errors="surrogateescape"), True)
    found: dict[str, list[str]] = defaultdict(list)
    for name, value in headers:
        found[name].append(value)
    _singles(found, TAG_HEADERS, ("object", "type", "tag", "tagger"))
    tagger = parse_author_text(found["tagger"][0])
    if tagger is None:
        raise InvalidObjectError("an author line has another form")
    return {
        "object": found["object"][0], "object_type": found["type"][0], "tag": found["tag"][0], "tagger": tagger, "gpgsig": next(iter(found["gpgsig"]), None),
        "extra_headers": [{"name": n, "value": v} for n, v in headers if n not in TAG_HEADERS], "message": message.removesuffix("\n"),
    }


def encode_tag(t: dict) -> bytes:
    extra = t.get("extra_headers") or []
    for h in extra:
        check_extra_header(h["name"], TAG_HEADERS)
    parts = [header_lines("object", t["object"]), header_lines("type", t["object_type"]), header_lines("tag", t["tag"]), header_lines("tagger", author_text(t["tagger"]))]
    parts += [header_lines("gpgsig", t["gpgsig"])] if t.get("gpgsig") else []
    parts += [header_lines(h["name"], h["value"]) for h in extra]
    return ("".join(parts) + "\n" + t["message"].rstrip("\n") + "\n").encode(errors="surrogateescape")


# Numbers


def encode_varint(n: int) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow."""
    if n < 0:
        raise ValueError("negative")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, bytes read)."""
    value = shift = 0
    for k in range(at, len(data)):
        value |= (data[k] & 127) << shift
        if data[k] < 128:
            return value, k + 1 - at
        shift += 7
    raise ValueError("a number is cut off")


def encode_object_header(number: int, size: int) -> bytes:
    """Type and size before a packed object: four bits of size with the type, then seven a byte."""
    first, rest = number << 4 | size & 15, size >> 4
    return bytes([first]) if not rest else bytes([first | 128]) + encode_varint(rest)


def decode_object_header(data: bytes, at: int = 0) -> tuple[int, int, int]:
    """(type, size, bytes read)."""
    if at >= len(data):
        raise ValueError("a header is cut off")
    first = data[at]
    size, read = first & 15, 1
    if first & 128:
        rest, more = decode_varint(data, at + 1)
        size, read = size | rest << 4, 1 + more
    return first >> 4 & 7, size, read


def encode_base_offset(n: int) -> bytes:
    """Highest seven bits first; each further byte counts one more."""
    if n <= 0:
        raise ValueError("a base lies before its delta")
    out = [n & 127]
    while n := n >> 7:
        n -= 1
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def decode_base_offset(data: bytes, at: int = 0) -> tuple[int, int]:
    value = 0
    for k in range(at, len(data)):
        value = (value << 7) | data[k] & 127
        if data[k] < 128:
            return value, k + 1 - at
        value += 1
    raise ValueError("an offset is cut off")


# Deltas


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target of a delta: copies from base and inserted bytes, with both sizes checked."""
    try:
        source, at = decode_varint(delta)
        size, more = decode_varint(delta, at)
    except ValueError as e:
        raise DeltaError(str(e)) from None
    if source != len(base):
        raise DeltaError("the base has another size")
    at, out = at + more, bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            fields = []
            for first, count in ((0, 4), (4, 3)):
                value = 0
                for k in range(count):
                    if op >> (first + k) & 1:
                        if at >= len(delta):
                            raise DeltaError("a copy is cut off")
                        value |= delta[at] << 8 * k
                        at += 1
                fields.append(value)
            low, n = fields[0], fields[1] or 0x10000
            if low + n > len(base):
                raise DeltaError("a copy leaves the base")
            out += base[low : low + n]
        elif op:
            if at + op > len(delta):
                raise DeltaError("an insert is cut off")
            out += delta[at : at + op]
            at += op
        else:
            raise DeltaError("an unknown instruction")
    if len(out) != size:
        raise DeltaError("the target has another size")
    return bytes(out)


def _agree(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many bytes from a[i:] and b[j:] on are the same."""
    n, step, most = 0, 64, min(len(a) - i, len(b) - j)
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return n


def _copies(base: bytes, target: bytes, block: int) -> list[tuple[int, int]]:
    """(place in target, place in base) wherever the target holds one of the base's blocks; by sums over all windows at once."""
    if min(len(base), len(target)) < block:
        return []
    powers = np.cumprod(np.full(block, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    sums = lambda data: (np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), block) * powers).sum(1, dtype=np.uint64)
    blocks = np.frombuffer(base[: len(base) // block * block], np.uint8).reshape(-1, block)
    keys, first = np.unique((blocks * powers).sum(1, dtype=np.uint64), return_index=True)
    out = []
    for low in range(0, len(target) - block + 1, 1 << 16):  # so that windows of long targets aren't all in memory
        found = sums(target[low : low + (1 << 16) + block - 1])
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == found)
        out += zip((hit + low).tolist(), (first[at[hit]] * block).tolist(), strict=True)
    return out


def create_delta(base: bytes, target: bytes, block: int = 16) -> bytes:
    """A delta from base to target: the base's blocks are looked up at every place of the target, and a match is
    extended forward as far as it goes and backward over what would be inserted."""
    out = bytearray(encode_varint(len(base)) + encode_varint(len(target)))

    def insert(part: bytes) -> None:
        for k in range(0, len(part), 127):
            out.append(len(part[k : k + 127]))
            out.extend(part[k : k + 127])

    done = 0
    for at, low in _copies(base, target, block):
        if at < done or base[low : low + block] != target[at : at + block]:
            continue
        n = block + _agree(base, low + block, target, at + block)
        while at > done and low and target[at - 1] == base[low - 1]:
            low, at, n = low - 1, at - 1, n + 1
        insert(target[done:at])
        done = at + n
        while n:
            part = min(n, 0xFFFF)
            op, extra = 128, bytearray()
            for bit, value in [(k, low >> 8 * k & 255) for k in range(4)] + [(4 + k, part >> 8 * k & 255) for k in range(3)]:
                if value:
                    op |= 1 << bit
                    extra.append(value)
            out.append(op)
            out.extend(extra)
            low, n = low + part, n - part
    insert(target[done:])
    return bytes(out)


# Frames of the wire protocol

# Fixed values of the protocol; lengths are in capitals.
LONGEST_PAYLOAD = 65520
FLUSH, DELIMITER, RESPONSE_END = b"0000", b"0001", b"0002"
_KINDS = {0: "flush", 1: "delimiter", 2: "end"}


def pkt_line(payload: bytes | str) -> bytes:
    data = payload.encode() if isinstance(payload, str) else payload
    if len(data) > LONGEST_PAYLOAD:
        raise PktLineError("a frame is too long")
    return b"%04X" % (len(data) + 4) + data


def split_frames(data: bytes, strict: bool = True) -> tuple[list[tuple[str, bytes]], bytes]:
    """((kind, payload) of each frame, bytes that follow the last one). Strict: nothing may follow."""
    out, at = [], 0
    while at < len(data):
        try:
            n = int(data[at : at + 4], 16) if len(data) - at >= 4 else -1
        except ValueError:
            n = -1
        if n in _KINDS:
            out.append((_KINDS[n], b""))
            at += 4
        elif n >= 4 and at + n <= len(data):
            out.append(("data", data[at + 4 : at + n]))
            at += n
        elif strict:
            raise PktLineError("a frame is damaged or cut off")
        else:
            break
    return out, data[at:]


def side_band(frames: list[tuple[str, bytes]], channel: int) -> bytes:
    """What a channel carries: 1 the pack, 2 progress, 3 a fatal error."""
    return b"".join(p[1:] for kind, p in frames if kind == "data" and p[:1] == bytes([channel]))


def side_band_frames(data: bytes, channel: int = 1) -> bytes:
    step = LONGEST_PAYLOAD - 1
    return b"".join(pkt_line(bytes([channel]) + data[k : k + step]) for k in range(0, len(data), step))


# Column functions

_COMMIT = f"STRUCT<tree: STRING, parents: ARRAY<STRING>, author: {AUTHOR}, committer: {AUTHOR}, encoding: STRING, gpgsig: STRING, mergetag: ARRAY<STRING>, extra_headers: {HEADERS}, message: STRING, error: STRING>"
_TAG = f"STRUCT<object: STRING, object_type: STRING, tag: STRING, tagger: {AUTHOR}, gpgsig: STRING, extra_headers: {HEADERS}, message: STRING, error: STRING>"


def _safely(f, data, empty: dict) -> dict:
    try:
        return empty | f(bytes(data)) | {"error": None}
    except (InvalidObjectError, ValueError) as e:
        return empty | {"error": str(e)}


class Lazy:
    """A column function that is made at its first call: making one needs a session, importing this module doesn't."""

    def __init__(self, make):
        self.make, self.made = make, None

    def get(self):
        if self.made is None:
            self.made = self.make()
        return self.made

    def __call__(self, *columns):
        return self.get()(*columns)


def _commit_fields(content):
    if content is None:
        return None
    return _safely(decode_commit, content, dict.fromkeys(("tree", "parents", "author", "committer", "encoding", "gpgsig", "mergetag", "extra_headers", "message")))


def _tag_fields(content):
    if content is None:
        return None
    return _safely(decode_tag, content, dict.fromkeys(("object", "object_type", "tag", "tagger", "gpgsig", "extra_headers", "message")))


def _tree_fields(content):
    try:
        return None if content is None else [{"mode": m, "name": n, "oid": o} for m, n, o in decode_tree(bytes(content))]
    except InvalidObjectError:
        return None


def _each(f):
    """A function of binaries; null for null and for damaged input."""

    def one(*values):
        try:
            return None if any(v is None for v in values) else f(*(bytes(v) for v in values))
        except (DeltaError, ValueError, zlib.error):
            return None

    return one


def _by_batch(f, kind: str = "binary") -> Lazy:
    """f by Arrow batches."""

    def apply(*columns: pd.Series) -> pd.Series:
        out = [f(*row) for row in zip(*columns, strict=True)]
        return pd.Series(out, dtype="Int64" if kind == "long" else object)

    if f in _TWO:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return apply(a, b)

        return Lazy(lambda: F.pandas_udf(two, kind))

    def one(a: pd.Series) -> pd.Series:
        return apply(a)

    return Lazy(lambda: F.pandas_udf(one, kind))


_apply, _create = _each(apply_delta), _each(create_delta)
_TWO = (_apply, _create)
#: A commit's or tag's fields, or why it has none in `error`; a tree's entries in stored order, null for a damaged one.
parse_commit = Lazy(lambda: F.udf(_commit_fields, _COMMIT, useArrow=True))
parse_tag = Lazy(lambda: F.udf(_tag_fields, _TAG, useArrow=True))
parse_tree = Lazy(lambda: F.udf(_tree_fields, "ARRAY<STRUCT<mode: STRING, name: STRING, oid: STRING>>", useArrow=True))
inflate, deflate = _by_batch(_each(zlib.decompress)), _by_batch(_each(zlib.compress))
delta_target, delta_between = _by_batch(_apply), _by_batch(_create)
varint_bytes = _by_batch(lambda n: None if pd.isna(n) or n < 0 else encode_varint(int(n)))
varint_value = _by_batch(_each(lambda d: decode_varint(d)[0]), "long")
#: pkt_line() of texts; null where one is too long for a frame.
frame_bytes = _by_batch(lambda p: None if p is None or len(p.encode()) > LONGEST_PAYLOAD else pkt_line(p))


class ParseTree:
    def eval(self, content: bytes):
        if content is not None:
            for k, entry in enumerate(decode_tree(bytes(content))):
                yield (k, *entry)


class ParseFrames:
    def eval(self, data: bytes):
        if data is not None:
            for k, (kind, payload) in enumerate(split_frames(bytes(data))[0]):
                yield k, kind, payload


class ParsePack:
    def eval(self, data: bytes):
        from grovespark.sources.packfile import read_objects

        if data is not None:
            for e in read_objects(bytes(data)):
                yield e.offset, e.type, e.oid, e.content


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL."""
    for name, f in (("inflate", inflate), ("deflate", deflate), ("apply_delta", delta_target), ("create_delta", delta_between), ("varint_bytes", varint_bytes), ("varint_value", varint_value), ("pkt_line", frame_bytes), ("parse_commit", parse_commit), ("parse_tag", parse_tag)):
        spark.udf.register(name, f.get())
    spark.udtf.register("parse_tree", F.udtf(ParseTree, returnType="ord INT, mode STRING, name STRING, oid STRING"))
    spark.udtf.register("parse_pkt_lines", F.udtf(ParseFrames, returnType="ord INT, kind STRING, payload BINARY"))
    spark.udtf.register("parse_pack", F.udtf(ParsePack, returnType="offset BIGINT, type STRING, oid STRING, content BINARY"))
