import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovespark.errors import DeltaError, InvalidObjectError, PktLineError, RefSpecError
from grovespark.functions import authors, codecs, names, oid, paths
from tests.conftest import rows


def test_ids(spark):
    df = spark.createDataFrame([("Hello!",), ("",), ("ä",)], "x string")
    got = dict(rows(df.select("x", oid.oid(F.col("x")))))
    assert got["Hello!"] == "05a682bd4e7c7117c5856be7142fea67465415e3"
    assert got["ä"] == hashlib.sha1(b"blob 2\0\xc3\xa4").hexdigest()
    empty = df.limit(1).select(oid.oid(F.lit(b""), "tree")).first()[0]
    assert empty == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def test_frames_come_apart(spark):
    data = [(codecs.framed("blob", b"a\0b\xff"),), (b"blob 3\0ab",), (b"nothing",), (b"thing 1\0a",)]
    got = [r[0] for r in spark.createDataFrame(data, "f binary").select(oid.unframe(F.col("f"))).collect()]
    assert (got[0]["type"], got[0]["size"], bytes(got[0]["content"]), got[0]["error"]) == ("blob", 4, b"a\0b\xff", None)
    assert [g["error"] for g in got[1:]] == ["size differs", "no header", "bad header"]


NAMES = {
    "HEAD": True, "refs/heads/main": True, "refs/heads/a/b-c": True, "refs/tags/v1.0": True, "refs/heads": False, "refs/heads/": False, "heads/main": False, "refs/heads/a..b": False,
    "refs/heads/a b": False, "refs/heads/a~b": False, "refs/heads/x.lock": False, "refs/heads/x.lock/y": False, "refs/heads/.": False, "refs/heads/a//b": False, "refs/heads/a.": False, "refs/heads/a@{b": False,
    "refs/heads/a\\b": False, "refs/heads/a?": False, "refs/heads/a*": False, "refs/heads/a[": False, "refs/heads/a\x7f": False, "": False, "refs/heads/ä": True, "refs/heads/@": True,
}


def test_ref_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "n string")
    got = {r[0]: r[1] for r in df.select("n", names.is_ref_name(F.col("n"))).collect()}
    assert got == NAMES | {None: False}
    assert {n: names.valid_ref_name(n) for n in NAMES} == NAMES


def test_globs(spark):
    df = spark.createDataFrame([(n,) for n in ("refs/heads/a", "refs/heads/a/b", "refs/tags/v1", "refs/heads/a?c", "refs/heads/abc")], "n string")
    pick = lambda p: [r[0] for r in rows(df.where(names.matches_glob(F.col("n"), p)))]
    assert pick("refs/heads/*") == ["refs/heads/a", "refs/heads/a/b", "refs/heads/a?c", "refs/heads/abc"]
    assert pick("refs/*/v*") == ["refs/tags/v1"]
    assert pick("refs/*a?c") == ["refs/heads/a?c"]
    assert pick("refs/heads/a") == ["refs/heads/a"]


def test_refspecs():
    s = names.RefSpec.parse("+refs/heads/*:refs/remotes/o/*")
    assert (s.force, s.source, s.target, s.wildcard) == (True, "refs/heads/", "refs/remotes/o/", True)
    assert names.RefSpec.parse(":refs/heads/x") == names.RefSpec(False, "", "refs/heads/x", False)
    assert names.RefSpec.of_rule("+a", "b", False).force is False
    assert names.RefSpec.parse("+a:b").rule() == ("a", "b", True)
    for bad in ("a", "a*b:c*", "a*:b", "a**:b*", "a:b*"):
        with pytest.raises(RefSpecError):
            names.RefSpec.parse(bad)


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c",), ("a",), ("",), ("/a",), ("a//b",), ("a/../b",), (None,)], "p string")
    p = F.col("p")
    got = df.select(paths.parent_path(p), paths.base_name(p), paths.is_path(p)).collect()
    assert [tuple(r) for r in got][:2] == [("a/b", "c", True), ("", "a", True)]
    assert [r[2] for r in got][2:] == [False] * 5
    assert df.limit(1).select(paths.ancestors(p)).first()[0] == ["", "a", "a/b"]
    assert df.limit(2).select(paths.join_path(F.lit(""), p), paths.join_path(F.lit("x"), p)).first()[1] == "x/a/b/c"


def test_authors(spark):
    lines = ["A B <a@b> 1700000000 +0800", "Ä <x> 1 -0000", "A <a@b> 5", " <a> 1 +0000", "A <> 1 +0000", "A <a> -1 +0000", ""]
    df = spark.createDataFrame([(x,) for x in lines], "x string").withColumn("a", authors.parse_author(F.col("x")))
    got = {r["x"]: r["a"] for r in df.collect()}
    assert got[lines[0]].asDict() == {"name": "A B", "email": "a@b", "timestamp": 1700000000, "timezone": "+0800"}
    assert [got[x] for x in lines[2:]] == [None] * 5
    assert {r[0] for r in df.where("a IS NOT NULL").select(authors.format_author(F.col("a"))).collect()} == set(lines[:2])
    for x in lines:
        assert (codecs.parse_author_text(x) is None) == (got[x] is None)


COMMIT = b"""tree 4b825dc642cb6eb9a060e54bf8d69288fbee4904
parent 05a682bd4e7c7117c5856be7142fea67465415e3
author A <a@b> 1 +0000
committer C <c@d> 2 -0130
encoding latin1
gpgsig -----BEGIN-----
 line

 end
x-more one
x-more two

Subject

Body
"""


def test_commits(spark):
    body = COMMIT.replace(b" line\n\n end", b" line\n \n end")
    c = codecs.decode_commit(body)
    assert c["gpgsig"] == "-----BEGIN-----\nline\n\nend"
    assert [h["value"] for h in c["extra_headers"]] == ["one", "two"]
    assert c["message"] == "Subject\n\nBody" and c["committer"]["timezone"] == "-0130"
    assert codecs.encode_commit(c) == body
    bad = [body.replace(b"tree ", b"tree x\ntree ", 1), body.replace(b"author A <a@b> 1 +0000\n", b""), body.replace(b"1 +0000", b"x")]
    for b in bad:
        with pytest.raises(InvalidObjectError):
            codecs.decode_commit(b)
    got = spark.createDataFrame([(body,), (bad[0],), (None,)], "c binary").select(codecs.parse_commit("c").alias("c")).collect()
    assert got[0]["c"]["message"] == "Subject\n\nBody" and got[0]["c"]["error"] is None and got[1]["c"]["error"] and got[2]["c"] is None
    assert codecs.decode_commit(b"tree x\nauthor A <a> 1 +0000\ncommitter A <a> 1 +0000\n")["message"] == ""


def test_tags():
    t = {"object": "a" * 40, "object_type": "commit", "tag": "v1", "tagger": {"name": "A", "email": "b", "timestamp": 1, "timezone": "+0000"}, "gpgsig": "s\nt", "extra_headers": [{"name": "x", "value": "y"}], "message": "m"}
    assert codecs.decode_tag(codecs.encode_tag(t)) == t
    with pytest.raises(InvalidObjectError):
        codecs.decode_tag(b"object a\ntype commit\ntag v\ntagger A <a> 1 +0000\n")
    with pytest.raises(InvalidObjectError):
        codecs.encode_tag(t | {"extra_headers": [{"name": "tag", "value": "y"}]})


def test_trees(spark):
    entries = [("100644", "a", "1" * 40), ("040000", "b", "2" * 40), ("120000", "ä", "3" * 40)]
    body = codecs.encode_tree(entries)
    assert body.startswith(b"100644 a\0") and b"\x1140000 b\0" in body
    assert codecs.decode_tree(body) == entries
    with pytest.raises(InvalidObjectError):
        codecs.decode_tree(body[:-1])
    codecs.register(spark)
    assert rows(spark.sql(f"SELECT * FROM parse_tree(X'{body.hex()}')")) == [(k, *e) for k, e in enumerate(entries)]


@given(st.integers(0, 1 << 40))
def test_numbers(n):
    assert codecs.decode_varint(codecs.encode_varint(n)) == (n, len(codecs.encode_varint(n)))
    head = codecs.encode_object_header(3, n)
    assert codecs.decode_object_header(head) == (3, n, len(head))
    if n:
        raw = codecs.encode_base_offset(n)
        assert codecs.decode_base_offset(raw) == (n, len(raw))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400), st.integers(0, 400))
def test_deltas(a, b, k):
    for base, target in ((a, b), (a, a[k:] + b + a[:k]), (a * 40, a * 41 + b), (a, a), (b"", a), (a, b"")):
        assert codecs.apply_delta(base, codecs.create_delta(base, target)) == target


def test_damaged_deltas():
    good = codecs.create_delta(b"x" * 100, b"x" * 100 + b"y")
    for bad in (b"", good[:-1], b"\x05\x01\x01a", b"\x64\x01\x00", b"\x64\x04\x91\x62\x04"):
        with pytest.raises(DeltaError):
            codecs.apply_delta(b"x" * 100, bad)
    assert codecs.apply_delta(b"z" * 0x10000, codecs.encode_varint(0x10000) * 2 + b"\x80") == b"z" * 0x10000


def test_frames(spark):
    assert codecs.pkt_line("hello") == b"0009hello" and codecs.pkt_line("a" * 6) == b"000Aaaaaaa"
    stream = codecs.pkt_line("a") + codecs.DELIMITER + codecs.pkt_line("") + codecs.FLUSH
    assert codecs.split_frames(stream) == ([("data", b"a"), ("delimiter", b""), ("data", b""), ("flush", b"")], b"")
    assert codecs.split_frames(stream + b"PACK", strict=False)[1] == b"PACK"
    for bad in (b"0003", b"00", b"zzzz", b"0009hel"):
        with pytest.raises(PktLineError):
            codecs.split_frames(bad)
    with pytest.raises(PktLineError):
        codecs.pkt_line(b"x" * 65521)
    banded = codecs.side_band_frames(b"q" * 70000)
    assert codecs.side_band(codecs.split_frames(banded)[0], 1) == b"q" * 70000
    assert codecs.side_band(codecs.split_frames(banded)[0], 2) == b""


def test_batched_functions(spark):
    df = spark.createDataFrame([(zlib.compress(b"abc"), 300), (b"no", 0), (None, None)], "z binary, n bigint")
    got = df.select(codecs.inflate("z"), codecs.varint_value(codecs.varint_bytes("n"))).collect()
    assert [(None if r[0] is None else bytes(r[0]), r[1]) for r in got] == [(b"abc", 300), (None, 0), (None, None)]


AUTHORS = {
    "A <a@x> 1 +0000": ("A", "a@x", 1, "+0000"), "A B <a b> c> 12 -0530": ("A B", "a b> c", 12, "-0530"), "A <x <y> 5 +0000": ("A", "x <y", 5, "+0000"), "Ä <ä@x> 99 +0800": ("Ä", "ä@x", 99, "+0800"),
    "  <a> 1 +0000": (" ", "a", 1, "+0000"), " <a> 1 +0000": None, "A <> 1 +0000": None, "A <a> -1 +0000": None, "A <a> 1 0000": None, "A <a> 1": None, "A a 1 +0000": None, "": None, "A\nB <a> 1 +0000": None, "A <a> 1 +00000": None,
}


def test_authors_by_both_readers(spark):
    """The column function and the plain one agree."""
    fields = ("name", "email", "timestamp", "timezone")
    want = [None if w is None else dict(zip(fields, w, strict=True)) for w in AUTHORS.values()]
    assert [authors.parse_author_text(a) for a in AUTHORS] == want
    got = spark.createDataFrame(list(enumerate(AUTHORS)), "k int, a string").select("k", authors.parse_author(F.col("a")).alias("p")).orderBy("k").collect()
    assert [r["p"].asDict() if r["p"] else None for r in got] == want


def test_deltas_of_random_edits():
    r = random.Random(1)
    for n in (0, 1, 15, 16, 17, 200, 5000, 200_000):
        base = bytes(r.randrange(256) for _ in range(n)) if n < 6000 else r.randbytes(n)
        target = bytearray(base)
        for _ in range(r.randrange(6)):
            at = r.randrange(len(target) + 1)
            target[at : at + r.randrange(30)] = r.randbytes(r.randrange(40))
        target = bytes(target) + base[: n // 2]
        delta = codecs.create_delta(base, target)
        assert codecs.apply_delta(base, delta) == target
        assert n < 200 or len(delta) < len(target) // 4
    assert len(codecs.create_delta(bytes(100_000), bytes(100_000))) < 60
