import subprocess

import pytest
from pyspark.sql import functions as F

from grovespark.errors import InvalidPackError, PackError, PackIndexError, ProtocolError, SideBandError
from grovespark.functions import codecs
from grovespark.operators import packs
from grovespark.plans import protocol
from grovespark.schema import ZERO_OID
from grovespark.sources import datasource, packfile, writers
from tests.conftest import rows

BLOBS = [("blob", b"hello"), ("blob", b""), ("blob", b"x" * 5000), ("tree", b""), ("blob", b"hello")]


def test_pack_round_trip():
    made = packfile.write_pack(BLOBS)
    got = packfile.read_objects(made.data)
    assert [(e.type, e.content) for e in got] == BLOBS[:4], "each id once"
    assert [(e.oid, e.offset) for e in got] == [(o, at) for o, at, _ in made.index]
    data = packfile.write_index(made.index, made.checksum)
    assert packfile.read_index(data) == (sorted(made.index), made.checksum)
    large = [("a" * 40, 1 << 33, 7), ("b" * 40, 12, 9)]
    assert packfile.read_index(packfile.write_index(large, made.checksum))[0] == large
    for bad in (made.data[:-1], b"KCAP" + made.data[4:], made.data[:20] + b"!" + made.data[21:]):
        with pytest.raises(InvalidPackError):
            packfile.read_entries(bad)
    with pytest.raises(PackIndexError):
        packfile.read_index(data[:-1] + b"!")


def delta_pack(thin: bool):
    """A base, a delta by place on it, and one by id on that (or on an object outside)."""
    import hashlib
    import struct
    import zlib

    a, b, c = b"base " * 50, b"base " * 50 + b"more", b"base " * 50 + b"more and more"
    first = codecs.encode_object_header(3, len(a)) + zlib.compress(a)
    d1 = codecs.create_delta(a, b)
    second = codecs.encode_object_header(6, len(d1)) + codecs.encode_base_offset(len(first)) + zlib.compress(d1)
    base = b"outside" if thin else b
    d2 = codecs.create_delta(base, c)
    third = codecs.encode_object_header(7, len(d2)) + bytes.fromhex(codecs.object_id("blob", base)) + zlib.compress(d2)
    data = b"PACK" + struct.pack(">II", 2, 3) + first + second + third
    return data + hashlib.sha1(data).digest(), [a, b, c], base


def test_deltas_in_packs(spark):
    data, want, _ = delta_pack(False)
    assert [e.content for e in packfile.read_objects(data)] == want
    thin, want, base = delta_pack(True)
    with pytest.raises(PackError):
        packfile.read_objects(thin)
    assert [e.content for e in packfile.read_objects(thin, lambda o: ("blob", base))] == want
    # the same by joins
    table = spark.createDataFrame([("p", e.offset, e.type, e.base_offset, e.base_oid, e.content) for e in packfile.read_entries(thin)], "pack string, offset long, type string, base_offset long, base_oid string, content binary")
    outside = spark.createDataFrame([(codecs.object_id("blob", base), "blob", base)], "oid string, type string, content binary")
    got = packs.resolve_deltas(table, outside).orderBy("offset").collect()
    assert [bytes(r["content"]) for r in got] == want and {r["type"] for r in got} == {"blob"}
    assert [r["oid"] for r in packs.resolve_deltas(table).orderBy("offset").collect()][2] is None


def test_multi_pack_index_and_bitmaps():
    rows_ = [("a" * 40, 0, 12), ("b" * 40, 1, 1 << 35), ("c" * 40, 1, 99)]
    data = packfile.write_midx(["p0.idx", "p1.idx"], rows_)
    assert packfile.read_midx(data) == (["p0.idx", "p1.idx"], rows_)
    with pytest.raises(PackIndexError):
        packfile.read_midx(data[:30] + b"?" + data[31:])
    bits = {0, 1, 63, 64, 200}
    assert packfile.decode_ewah(packfile.encode_ewah(bits, 201))[0] == bits
    import struct

    run = struct.pack(">II", 200, 2) + struct.pack(">QQ", 1 | 2 << 1 | 1 << 33, 5) + struct.pack(">I", 0)
    assert packfile.decode_ewah(run)[0] == set(range(128)) | {128, 130}
    types = {"commit": {0, 2}, "blob": {1}}
    got = packfile.read_bitmap(packfile.write_bitmap(types, {0: {0, 1}, 2: {0, 1, 2}}, 3, "a" * 40))
    assert got == ({"commit": {0, 2}, "tree": set(), "blob": {1}, "tag": set()}, {0: {0, 1}, 2: {0, 1, 2}}, "a" * 40)


def test_repository_files(spark, tmp_path):
    datasource.register(spark)
    repo = str(tmp_path / "r")
    writers.init_repository(repo)
    objects = spark.createDataFrame([("blob", bytearray(c)) for _, c in BLOBS], "type string, content binary")
    written = sorted({r[0] for r in writers.write_loose(objects, f"{repo}/objects").collect()})
    got = spark.read.format("repo_loose").load(repo)
    assert sorted(r["oid"] for r in got.collect()) == written
    one = got.where(F.col("oid") == written[0])
    assert one.count() == 1 and got.where(F.col("oid").startswith(written[0][:4])).count() == 1
    writers.write_refs(repo, [("refs/heads/a", "a" * 40), ("refs/heads/b/c", "b" * 40)])
    (tmp_path / "r/packed-refs").write_text(f"# pack-refs with: peeled\n{'c' * 40} refs/heads/a\n{'d' * 40} refs/tags/v\n^{'e' * 40}\n")
    refs = spark.read.format("repo_refs").load(repo)
    assert rows(refs) == [("HEAD", "ref: refs/heads/main"), ("refs/heads/a", "a" * 40), ("refs/heads/b/c", "b" * 40), ("refs/tags/v", "d" * 40)]
    assert rows(refs.where(F.col("name").startswith("refs/heads/b"))) == [("refs/heads/b/c", "b" * 40)]
    writers.delete_packed_ref(repo, "refs/tags/v")
    assert (tmp_path / "r/packed-refs").read_text() == f"# pack-refs with: peeled\n{'c' * 40} refs/heads/a\n"
    many = spark.createDataFrame([(k % 2, k, t, bytearray(c)) for k, (t, c) in enumerate(BLOBS)], "pack int, seq int, type string, content binary")
    made = writers.write_packs(many, f"{repo}/objects/pack").collect()
    packed = spark.read.format("repo_pack").load(f"{repo}/objects/pack")
    index = spark.read.format("repo_index").load(f"{repo}/objects/pack")
    assert sum(r["objects"] for r in made) == packed.count() == index.count()
    assert rows(packed, "pack", "oid", "offset") == rows(index, "pack", "oid", "offset")
    assert writers.write_multi_index(index, f"{repo}/objects/pack/multi-pack-index") == len(set(r["oid"] for r in index.collect()))
    midx = spark.read.format("repo_midx").load(f"{repo}/objects/pack/multi-pack-index")
    assert rows(midx.join(index, ["oid", "pack", "offset"], "left_anti")) == []
    assert writers.delete_loose(spark, f"{repo}/objects", index) == len(written)
    (tmp_path / "w/sub").mkdir(parents=True)
    (tmp_path / "w/sub/run").write_text("#!")
    (tmp_path / "w/sub/run").chmod(0o755)
    (tmp_path / "w/link").symlink_to("sub/run")
    assert rows(spark.read.format("repo_tree").load(str(tmp_path / "w")), "path", "mode") == [("link", "120000"), ("sub/run", "100755")]
    writers.swap_table(refs, str(tmp_path / "t"))
    version = writers.swap_table(refs.limit(1), str(tmp_path / "t"))
    assert writers.read_table(spark, str(tmp_path / "t")).count() == writers.read_table(spark, str(tmp_path / "t"), version).count() == 1


def test_packs_agree_with_git(tmp_path):
    try:
        subprocess.run(["git", "init", "-q", "--bare", tmp_path], check=True)
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git")
    made = packfile.write_pack(BLOBS)
    path = tmp_path / "x.pack"
    path.write_bytes(made.data)
    out = subprocess.run(["git", "index-pack", str(path)], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.strip() == made.checksum
    assert path.with_suffix(".idx").read_bytes() == packfile.write_index(made.index, made.checksum)


def test_pack_tables(spark):
    e = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (1, 0, 3)], "pack int, seq int, len long")
    assert rows(packs.offsets(e)) == [(0, 0, 5, 12), (0, 1, 7, 17), (1, 0, 3, 12)]
    index = spark.createDataFrame([("00" + "a" * 38, 0, 12), ("00" + "a" * 38, 2, 40), ("ff" + "b" * 38, 1, 12), ("00" + "a" * 38, 1, 90)], "oid string, pack_id int, offset long")
    assert rows(packs.winners(index)) == [("00" + "a" * 38, 2, 40), ("ff" + "b" * 38, 1, 12)]
    assert rows(packs.winners(index, 1)) == [("00" + "a" * 38, 1, 90), ("ff" + "b" * 38, 1, 12)]
    fan = dict(rows(packs.fanout(index)))
    assert len(fan) == 256 and (fan[0], fan[254], fan[255]) == (3, 3, 4)
    layers = spark.createDataFrame([(0, 1, 10), (1, 2, 5), (2, 1, 1)], "layer int, packs long, objects long")
    assert rows(packs.layer_offsets(layers), "layer", "first_pack", "first_object") == [(0, 0, 0), (1, 1, 10), (2, 3, 15)]


def test_protocol():
    a, b = "a" * 40, "b" * 40
    refs = [{"name": "HEAD", "oid": a, "peeled": None, "symref_target": "refs/heads/main"}, {"name": "refs/tags/v", "oid": b, "peeled": a, "symref_target": None}]
    got = protocol.parse_advertisement(protocol.write_advertisement(refs, ["report-status", "symref=HEAD:refs/heads/main"], "git-receive-pack"))
    assert got.refs == refs and "report-status" in got.capabilities
    assert protocol.parse_advertisement(protocol.write_advertisement([], ["x"], "s")).refs == []
    caps = {"ls-refs": ["unborn"], "fetch": ["shallow"], "object-info": []}
    assert protocol.parse_capabilities(protocol.write_capabilities(caps)) == caps
    args = protocol.list_arguments(["refs/heads/"])
    assert protocol.parse_command(protocol.write_command("ls-refs", args, ["agent=x"])) == ("ls-refs", ["agent=x"], args)
    assert protocol.parse_list_arguments(args) == {"peel": True, "symrefs": True, "prefixes": ["refs/heads/"]}
    assert protocol.parse_listing(protocol.write_listing(refs)) == refs
    assert protocol.parse_sizes(protocol.write_sizes({a: 5, b: None})) == {a: 5, b: None}
    fetched = protocol.parse_fetch(protocol.write_fetch(b"P" * 70000, [a], True, [b]))
    assert fetched["pack"] == b"P" * 70000 and fetched["acknowledged"] == [a] and fetched["ready"] and fetched["shallow"] == [b]
    with pytest.raises(SideBandError):
        protocol.parse_fetch(codecs.pkt_line("packfile\n") + codecs.pkt_line(b"\3stop") + codecs.FLUSH)
    assert "shallow " + a not in protocol.fetch_arguments([a], shallow=[a]) and "shallow " + a in protocol.fetch_arguments([a], shallow=[a], features=["shallow"])
    assert protocol.parse_fetch_arguments(protocol.fetch_arguments([a], [b], True))["haves"] == [b]
    assert [len(r) for r in protocol.have_rounds([a] * 400)] == [32] * 10
    push = [(ZERO_OID, a, "refs/heads/n"), (a, ZERO_OID, "refs/heads/o")]
    assert protocol.parse_push(protocol.write_push(push, b"PACK", ["report-status"])) == (push, ["report-status"], b"PACK")
    assert protocol.parse_push(protocol.write_push(push[1:], b"PACK", []))[2] == b""
    states = [("refs/heads/n", None), ("refs/heads/o", "no")]
    for banded in (True, False):
        assert protocol.parse_report(protocol.write_report("ok", states, banded)) == ("ok", [("refs/heads/n", True, None), ("refs/heads/o", False, "no")])
    with pytest.raises(ProtocolError):
        protocol.parse_report(codecs.pkt_line("what\n"))


def test_recorded_listings(spark, tmp_path):
    datasource.register(spark)
    refs = [{"name": "HEAD", "oid": "a" * 40, "peeled": None, "symref_target": "refs/heads/main"}, {"name": "refs/tags/v", "oid": "b" * 40, "peeled": "a" * 40, "symref_target": None}]
    (tmp_path / "new").write_bytes(protocol.write_listing(refs))
    (tmp_path / "old").write_bytes(protocol.write_advertisement(refs, ["symref=HEAD:refs/heads/main"], "git-upload-pack"))
    want = sorted((tuple(r[k] for k in ("name", "oid", "peeled", "symref_target")) for r in refs), key=repr)
    for name in ("new", "old"):
        got = spark.read.format("repo_remote").load(str(tmp_path / name))
        assert rows(got) == want and got.where(F.col("name").startswith("refs/tags/")).count() == 1
    (tmp_path / "sizes").write_bytes(protocol.write_sizes({"a" * 40: 7, "b" * 40: None}))
    assert rows(spark.read.format("repo_sizes").load(str(tmp_path / "sizes"))) == [("a" * 40, 7), ("b" * 40, None)]


def test_shallow_list_is_written_by_ranges(spark, tmp_path, monkeypatch):
    """No more than a range's lines are on the driver: the list isn't collected."""
    from pyspark.sql.classic.dataframe import DataFrame

    from grovespark import queries_files

    monkeypatch.setattr(DataFrame, "collect", lambda _: pytest.fail("the list was collected"))
    folder = f"file://{tmp_path}"
    ids = spark.range(30_000).select(F.sha1(F.col("id").cast("string")).alias("oid")).repartition(7)
    writers.write_shallow(folder, ids)
    monkeypatch.undo()
    want = sorted(r["oid"] for r in ids.collect())
    assert (tmp_path / "shallow").read_text() == "\n".join(want) + "\n" and [p.name for p in tmp_path.iterdir()] == ["shallow"]
    writers.write_shallow(folder, ids.where("false"))
    writers.write_shallow(folder, ids.where("false"))
    assert not list(tmp_path.iterdir()), "an empty list is no file"
    monkeypatch.setattr(DataFrame, "collect", lambda _: pytest.fail("the list was collected"))
    assert queries_files.shallow_file(spark, "/root/testdata/sf0.001").count() > 0
