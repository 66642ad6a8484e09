"""Object ids as column expressions: SHA-1 over "<type> <bytes>\\0" and the content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grovespark.schema import OBJECT_TYPES

_HEX40 = "^[0-9a-f]{40}$"


def frame(content: Column, kind: Column | str = "blob") -> Column:
    """The framed bytes of an object."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.concat(kind, F.lit(" "), F.octet_length(content).cast("string")).cast("binary"), F.lit(b"\0"), content.cast("binary"))


def oid(content: Column, kind: Column | str = "blob") -> Column:
    return F.sha1(frame(content, kind))


def hash_data(data: Column) -> Column:
    return F.sha1(data.cast("binary"))


def is_oid(text: Column) -> Column:
    """Exactly 40 lower-case hex digits; null is no id."""
    return F.coalesce(text.rlike(_HEX40), F.lit(False))


def checked_oid(text: Column) -> Column:
    return F.when(is_oid(text), text).otherwise(F.raise_error(F.concat(F.lit("no object id: "), F.coalesce(text, F.lit("null")))))


def is_object_type(kind: Column) -> Column:
    return F.coalesce(kind.isin(*OBJECT_TYPES), F.lit(False))


def checked_object_type(kind: Column) -> Column:
    return F.when(is_object_type(kind), kind).otherwise(F.raise_error(F.concat(F.lit("no object type: "), F.coalesce(kind, F.lit("null")))))


def loose_path(o: Column) -> Column:
    """Where a loose object lies: aa/bbbb..."""
    return F.concat_ws("/", F.substring(o, 1, 2), F.substring(o, 3, 38))


def path_oid(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit(""))


def unframe(framed: Column) -> Column:
    """struct(type, size, content, error) of framed bytes; error is null where the header and size hold."""
    # Latin-1 keeps one character a byte, so positions are those of bytes
    text = F.decode(framed, "ISO-8859-1")
    at = F.instr(text, "\0")
    head = F.substring(text, F.lit(1), at - 1)
    kind, size = F.regexp_extract(head, r"^(commit|tree|blob|tag) (\d+)$", 1), F.regexp_extract(head, r"^(commit|tree|blob|tag) (\d+)$", 2)
    content = F.substring(framed, at + 1, F.octet_length(framed) - at)
    error = F.when(at == 0, "no header").when(kind == "", "bad header").when(size.try_cast("bigint") != F.octet_length(content), "size differs")
    good = error.isNull()
    return F.struct(F.when(good, kind).alias("type"), F.when(good, size.try_cast("bigint")).alias("size"), F.when(good, content).alias("content"), error.alias("error"))
