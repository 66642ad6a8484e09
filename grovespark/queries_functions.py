"""Registered queries over functions: ids, names, paths, numbers, headers, frames and messages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark import fixtures as X
from grovespark.functions import codecs, names, paths
from grovespark.functions.oid import checked_object_type, checked_oid, hash_data, is_object_type, is_oid, loose_path, oid, path_oid
from grovespark.operators import refs
from grovespark.plans import protocol, pushing
from grovespark.queries import _B, _LIVE, _PATH, _live, _oid, _query


def _mapped(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f of each row (as values of its columns), by Arrow batches: a value for each column of schema."""
    fields = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}

    def apply(batches):
        for batch in batches:
            rows = [f(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return df.mapInArrow(apply, schema)


# Ids


@_query("SELECT doc_id, sha1(text) AS digest FROM documents")
def hash_of_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", hash_data(F.col("text")).alias("digest"))


@_query(f"SELECT doc_id, {_oid('text')} AS oid FROM documents")
def path_to_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.blobs(spark, sf_dir).select("doc_id", path_oid(loose_path(checked_oid(F.col("oid")))).alias("oid"))


@_query("SELECT event_id, regexp_full_match(x, '[0-9a-f]{40}') AS valid FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(sha1(props)) WHEN event_id % 5 = 0 THEN substr(sha1(props), 2) ELSE sha1(props) END AS x FROM events)")
def oid_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in capitals, cut off, and as they should be."""
    e = X.table(spark, sf_dir, "events").withColumn("x", hash_data(F.col("props")))
    shape = F.when(F.col("event_id") % 3 == 0, F.upper("x")).when(F.col("event_id") % 5 == 0, F.substring("x", 2, 40)).otherwise(F.col("x"))
    return e.select("event_id", is_oid(shape).alias("valid"))


_KINDS = "CASE event_type WHEN 'error' THEN 'commit' WHEN 'signup' THEN 'tree' WHEN 'view' THEN 'blob' WHEN 'click' THEN 'tag' ELSE event_type END"


@_query(f"SELECT event_id, k IN ('commit', 'tree', 'blob', 'tag') AS valid, CASE k WHEN 'commit' THEN 1 WHEN 'tree' THEN 2 WHEN 'blob' THEN 3 WHEN 'tag' THEN 4 END AS number, CASE WHEN k IN ('commit', 'tree', 'blob', 'tag') THEN k END AS back FROM (SELECT event_id, {_KINDS} AS k FROM events)")
def object_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types to their numbers in packs and back."""
    e = X.table(spark, sf_dir, "events").withColumn("k", F.expr(_KINDS))
    number = paths.type_number(F.when(is_object_type(F.col("k")), checked_object_type(F.col("k"))))
    return e.select("event_id", is_object_type(F.col("k")).alias("valid"), number.alias("number"), paths.number_type(number).alias("back"))


@_query("SELECT l_orderkey, l_linenumber, l_linenumber IN (6, 7) AS delta FROM lineitem")
def delta_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", paths.is_delta_type(F.col("l_linenumber")).alias("delta"))


# Names


@_query("SELECT name, short, CASE WHEN short THEN 'refs/heads/' || name END AS branch, CASE WHEN short THEN 'refs/tags/' || name END AS tag FROM (SELECT name, length(name) > 0 AND NOT regexp_matches(name, '[ ~^:?*]|\\.\\.|//|(^|/)\\.|\\.lock(/|$)|[/.]$') AS short FROM (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN 'user-' || user_id WHEN 1 THEN 'a..b' || user_id WHEN 2 THEN 'x y' || user_id ELSE event_type || '.lock' END AS name FROM events))")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch and tag names without their prefix."""
    kind = F.col("event_id") % 4
    name = F.when(kind == 0, F.concat(F.lit("user-"), F.col("user_id").cast("string"))).when(kind == 1, F.concat(F.lit("a..b"), F.col("user_id").cast("string"))).when(kind == 2, F.concat(F.lit("x y"), F.col("user_id").cast("string"))).otherwise(F.concat("event_type", F.lit(".lock")))
    rows = X.table(spark, sf_dir, "events").select(name.alias("name")).distinct()
    good = names.is_short_name(F.col("name"))
    return rows.select("name", good.alias("short"), F.when(good, names.branch_ref(F.col("name"))).alias("branch"), F.when(good, names.tag_ref(F.col("name"))).alias("tag"))


@_query(f"SELECT name, 'refs/heads/' AS prefix, true AS valid, false AS name_valid, true AS forward FROM ({_LIVE})")
def ref_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The space of each name, as a prefix; a name itself is none. forward: whether it may only move forward."""
    prefix = F.concat(paths.parent_path(F.col("name")), F.lit("/"))
    return _live(spark, sf_dir).select("name", prefix.alias("prefix"), names.is_ref_prefix(prefix).alias("valid"), names.is_ref_prefix(F.col("name")).alias("name_valid"), names.needs_fast_forward(F.col("name")).alias("forward"))


@_query(f"SELECT name, CASE WHEN name LIKE '%1' THEN regexp_extract(name, '^(.*/)') END AS prefix FROM ({_LIVE})")
def pattern_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the star of a pattern."""
    pattern = F.when(F.col("name").endswith("1"), F.concat(paths.parent_path(F.col("name")), F.lit("/*"))).otherwise(F.col("name"))
    return _live(spark, sf_dir).select("name", names.pattern_prefix(pattern).alias("prefix"))


@_query("SELECT * FROM (VALUES (0, 'refs/heads/*', 'refs/remotes/origin/*', false), (1, 'refs/heads/*', 'refs/mirror/*', true), (2, 'refs/heads/a', 'refs/heads/b', false), (3, 'refs/heads/a', 'refs/heads/b', true)) t(spec, source, target, force)")
def refspec_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping rules to refspecs and back."""
    specs = [names.RefSpec.of_rule("refs/heads/*", "refs/remotes/origin/*"), names.RefSpec.of_rule("+refs/heads/*", "refs/mirror/*"), names.RefSpec.of_rule("+refs/heads/a", "refs/heads/b", False), names.RefSpec.of_rule("refs/heads/a", "refs/heads/b", True)]
    return spark.createDataFrame([(k, *s.rule()) for k, s in enumerate(specs)], "spec int, source string, target string, force boolean")


# Paths and modes


_BAD = "CASE doc_id % 6 WHEN 0 THEN {p} WHEN 1 THEN '/' || {p} WHEN 2 THEN {p} || '/' WHEN 3 THEN source || '//' || lang WHEN 4 THEN source || '/../' || lang ELSE '' END"


@_query(f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'a slash at an end' WHEN 2 THEN 'a slash at an end' WHEN 3 THEN 'an empty segment' WHEN 4 THEN 'a dot segment' ELSE 'empty' END AS error, len(list_filter(string_split(x, '/'), lambda s: s <> '')) AS segments, coalesce(x, '') AS directory FROM (SELECT doc_id, {_BAD.format(p=_PATH)} AS x FROM documents)")
def path_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents").withColumn("p", F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt"))).withColumn("x", F.expr(_BAD.format(p="p")))
    return d.select("doc_id", paths.path_error(F.col("x")).alias("error"), F.size(paths.segments(F.col("x"))).cast("bigint").alias("segments"), paths.directory_path(F.col("x")).alias("directory"))


@_query(f"SELECT path, mode, mode AS origin, mode AS canonical, parent || '/x' AS child FROM (SELECT path, mode, regexp_extract(path, '^(.*)/', 1) AS parent FROM ({_B}))")
def path_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes on their way to the disk and back, and a path beside each."""
    m = F.col("mode")
    return X.snapshot_b(spark, sf_dir).select("path", "mode", paths.origin_mode(paths.disk_mode(m)).alias("origin"), paths.canonical_mode(paths.disk_mode(m)).alias("canonical"), paths.join_path(paths.parent_path(F.col("path")), F.lit("x")).alias("child"))


# Numbers and headers


_VARINT = "CASE WHEN n < 128 THEN printf('%02x', n) WHEN n < 16384 THEN printf('%02x%02x', (n & 127) | 128, n >> 7) ELSE printf('%02x%02x%02x', (n & 127) | 128, ((n >> 7) & 127) | 128, n >> 14) END"


@_query(f"SELECT doc_id, {_VARINT} AS hex, n AS value FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)")
def varint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.blobs(spark, sf_dir).withColumn("v", codecs.varint_bytes("size"))
    return d.select("doc_id", F.lower(F.hex("v")).alias("hex"), codecs.varint_value("v").alias("value"))


_HEADER = "CASE WHEN n < 16 THEN printf('%02x', 48 | n) WHEN n < 2048 THEN printf('%02x%02x', 176 | (n & 15), n >> 4) WHEN n < 262144 THEN printf('%02x%02x%02x', 176 | (n & 15), ((n >> 4) & 127) | 128, n >> 11) ELSE printf('%02x%02x%02x%02x', 176 | (n & 15), ((n >> 4) & 127) | 128, ((n >> 11) & 127) | 128, n >> 18) END"


@_query(f"SELECT doc_id, {_HEADER} AS hex, 3 AS number, n AS size, length({_HEADER}) // 2 AS read FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)")
def object_header_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and size before a packed object."""

    def both(doc_id, size):
        data = codecs.encode_object_header(3, size)
        return doc_id, data.hex(), *codecs.decode_object_header(data)

    return _mapped(X.blobs(spark, sf_dir).select("doc_id", "size"), both, "doc_id bigint, hex string, number int, size bigint, read bigint")


_OFFSET = "CASE WHEN n < 128 THEN printf('%02x', n) WHEN n < 16512 THEN printf('%02x%02x', ((n - 128) >> 7) | 128, n & 127) ELSE printf('%02x%02x%02x', ((n - 16512) >> 14) | 128, (((n - 128) >> 7) & 127) | 128, n & 127) END"


@_query(f"SELECT doc_id, {_OFFSET} AS hex, n AS value FROM (SELECT doc_id, octet_length(encode(text)) + 1 AS n FROM documents)")
def base_offset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far back the base of a delta lies."""

    def both(doc_id, size):
        data = codecs.encode_base_offset(size + 1)
        return doc_id, data.hex(), codecs.decode_base_offset(data)[0]

    return _mapped(X.blobs(spark, sf_dir).select("doc_id", "size"), both, "doc_id bigint, hex string, value bigint")


@_query("SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def deflate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents").select("doc_id", codecs.inflate(codecs.deflate(F.col("text").cast("binary"))).alias("x"))
    return d.select("doc_id", F.sha2("x", 256).alias("content_sha256"))


_WHO = "'Clerk <c@x> ' || cast(epoch(o_orderdate) AS BIGINT) || ' +0000'"
_COMMIT = f"'tree ' || lpad(cast(o_custkey AS VARCHAR), 40, '0') || chr(10) || 'parent ' || lpad(cast(o_orderkey AS VARCHAR), 40, '0') || chr(10) || 'author ' || {_WHO} || chr(10) || 'committer ' || {_WHO} || chr(10) || 'encoding UTF-8' || chr(10) || 'gpgsig one' || chr(10) || ' two' || chr(10) || 'x-clerk ' || o_orderstatus || chr(10) || chr(10) || o_orderpriority || chr(10)"


@_query(f"SELECT o_orderkey, {_oid(_COMMIT, 'commit')} AS oid, o_orderstatus AS extra, 'one' || chr(10) || 'two' AS gpgsig FROM orders")
def commit_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits written from their fields, with a signature of two lines and a header of their own, and parsed back."""

    def write(key, cust, ts, clerk, message):
        who = {"name": "Clerk", "email": "c@x", "timestamp": ts, "timezone": "+0000"}
        data = codecs.encode_commit({"tree": f"{cust:040d}", "parents": [f"{key:040d}"], "author": who, "committer": who, "encoding": "UTF-8", "gpgsig": "one\ntwo", "extra_headers": [{"name": "x-clerk", "value": clerk}], "message": message})
        back = codecs.decode_commit(data)
        return key, codecs.object_id("commit", data), back["extra_headers"][0]["value"], back["gpgsig"]

    o = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.unix_timestamp("o_orderdate"), "o_orderstatus", "o_orderpriority")
    return _mapped(o, write, "o_orderkey bigint, oid string, extra string, gpgsig string")


_TAG = "'object ' || lpad(cast(o_orderkey AS VARCHAR), 40, '0') || chr(10) || 'type commit' || chr(10) || 'tag v' || o_orderkey || chr(10) || 'tagger Clerk <c@x> 1000 -0500' || chr(10) || chr(10) || o_orderpriority || chr(10)"


@_query(f"SELECT o_orderkey, {_oid(_TAG, 'tag')} AS oid, lpad(cast(o_orderkey AS VARCHAR), 40, '0') AS object, 'v' || o_orderkey AS tag, o_orderpriority AS message FROM orders")
def tag_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags written from their fields; parsed by the column function."""

    def write(key, message):
        data = codecs.encode_tag({"object": f"{key:040d}", "object_type": "commit", "tag": f"v{key}", "tagger": {"name": "Clerk", "email": "c@x", "timestamp": 1000, "timezone": "-0500"}, "message": message})
        return key, codecs.object_id("tag", data), data

    made = _mapped(X.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), write, "o_orderkey bigint, oid string, data binary")
    return made.select("o_orderkey", "oid", codecs.parse_tag("data").alias("t")).select("o_orderkey", "oid", "t.object", "t.tag", "t.message")


@_query("SELECT n_nationkey, sha1(encode('tree ' || octet_length(b)) || '\\x00'::blob || b) AS oid, 2 AS entries FROM (SELECT n_nationkey, encode('100644 ' || n_name) || '\\x00'::blob || unhex(sha1(n_name)) || encode('40000 ' || n_name || '.d') || '\\x00'::blob || unhex(sha1(n_name || '!')) AS b FROM nation)")
def tree_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees written from entries and parsed by the table function."""

    def write(key, name):
        data = codecs.encode_tree([("100644", name, hashlib.sha1(name.encode()).hexdigest()), ("040000", f"{name}.d", hashlib.sha1(f"{name}!".encode()).hexdigest())])
        return key, codecs.object_id("tree", data), data

    codecs.register(spark)
    _mapped(X.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), write, "n_nationkey bigint, oid string, data binary").createOrReplaceTempView("nation_trees")
    return spark.sql("SELECT n_nationkey, n.oid, count(*) AS entries FROM nation_trees n, LATERAL parse_tree(n.data) t GROUP BY n_nationkey, n.oid").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "oid", F.col("entries").cast("int").alias("entries"))


# Frames


@_query("""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ord, text FROM conversations)
SELECT conv_id, cast(ord AS INTEGER) AS ord, 'data' AS kind, sha256(text) AS payload FROM t
UNION ALL SELECT conv_id, cast(count(*) AS INTEGER), 'delimiter', sha256('') FROM t GROUP BY conv_id UNION ALL SELECT conv_id, cast(count(*) + 1 AS INTEGER), 'flush', sha256('') FROM t GROUP BY conv_id""")
def pkt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a stream of frames that ends in a delimiter and a flush, split by the table function."""
    codecs.register(spark)
    c = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", codecs.frame_bytes("text").alias("f"))
    stream = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "f"))).alias("x")).select("conv_id", F.expr("concat(array_join(transform(x, e -> hex(e.f)), ''), hex('00010000'))").alias("h"))
    stream.select("conv_id", F.unhex("h").alias("data")).createOrReplaceTempView("pkt_streams")
    return spark.sql("SELECT conv_id, ord, kind, sha2(payload, 256) AS payload FROM pkt_streams, LATERAL parse_pkt_lines(data) p")


@_query("SELECT doc_id, sha256(text) AS pack, 'doc ' || doc_id AS progress, cast((octet_length(encode(text)) + 65518) // 65519 AS BIGINT) + 2 AS frames, true AS fatal FROM documents")
def side_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text on the channel of packs, progress between, and a fatal message that is seen."""

    def both(doc_id, text):
        data = codecs.side_band_frames(text.encode()) + codecs.side_band_frames(f"doc {doc_id}".encode(), 2)
        frames, rest = codecs.split_frames(data + codecs.FLUSH + b"00", strict=False)
        bad = codecs.split_frames(data + codecs.side_band_frames(b"broken", 3))[0]
        return doc_id, hashlib.sha256(codecs.side_band(frames, 1)).hexdigest(), codecs.side_band(frames, 2).decode(), len(frames), codecs.side_band(bad, 3) == b"broken" and rest == b"00"

    return _mapped(X.table(spark, sf_dir, "documents").select("doc_id", "text"), both, "doc_id bigint, pack string, progress string, frames bigint, fatal boolean")


# Messages


@_query("SELECT event_id, 'ls-refs' AS command, 'agent=x' AS capabilities, 'refs/heads/user-' || user_id AS prefixes, true AS peel, false AS symrefs FROM events")
def listing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for a listing, written and parsed."""

    def both(event_id, user):
        command, capabilities, arguments = protocol.parse_command(protocol.write_command("ls-refs", protocol.list_arguments([f"refs/heads/user-{user}"], symrefs=False), ["agent=x"]))
        asked = protocol.parse_list_arguments(arguments)
        return event_id, command, ",".join(capabilities), ",".join(asked["prefixes"]), asked["peel"], asked["symrefs"]

    return _mapped(X.table(spark, sf_dir, "events").select("event_id", "user_id"), both, "event_id bigint, command string, capabilities string, prefixes string, peel boolean, symrefs boolean")


@_query("SELECT doc_id, sha1(text) AS wants, sha1(lang) || ',' || sha1(source) AS haves, sha1('s' || doc_id) AS shallow, true AS done FROM documents")
def fetch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(doc_id, want, a, b, shallow):
        asked = protocol.parse_fetch_arguments(protocol.parse_command(protocol.write_command("fetch", protocol.fetch_arguments([want], [a, b], True, [shallow], features=["shallow"])))[2])
        return doc_id, ",".join(asked["wants"]), ",".join(asked["haves"]), ",".join(asked["shallow"]), asked["done"]

    d = X.table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.sha1(F.col("text").cast("binary")), F.sha1(F.col("lang").cast("binary")), F.sha1(F.col("source").cast("binary")), F.sha1(F.concat(F.lit("s"), F.col("doc_id").cast("string")).cast("binary")))
    return _mapped(rows, both, "doc_id bigint, wants string, haves string, shallow string, done boolean")


@_query("SELECT doc_id, sha256(text) AS pack, sha1(lang) AS acknowledged, true AS ready, sha1(source) AS shallow FROM documents")
def fetch_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server's answer with acknowledgments, a shallow list and the pack."""

    def both(doc_id, text, common, shallow):
        got = protocol.parse_fetch(protocol.write_fetch(text.encode(), [common], True, [shallow]))
        return doc_id, hashlib.sha256(got["pack"]).hexdigest(), ",".join(got["acknowledged"]), got["ready"], ",".join(got["shallow"])

    d = X.table(spark, sf_dir, "documents").select("doc_id", "text", F.sha1(F.col("lang").cast("binary")), F.sha1(F.col("source").cast("binary")))
    return _mapped(d, both, "doc_id bigint, pack string, acknowledged string, ready boolean, shallow string")


@_query("SELECT doc_id, 2 AS commands, 'refs/heads/' || lang AS ref, 'report-status,ofs-delta' AS capabilities, sha256(text) AS pack FROM documents")
def push_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(doc_id, text, lang):
        commands, capabilities, pack = protocol.parse_push(protocol.write_push([("0" * 40, "a" * 40, f"refs/heads/{lang}"), ("b" * 40, "0" * 40, "refs/tags/x")], text.encode(), ["report-status", "ofs-delta"]))
        return doc_id, len(commands), commands[0][2], ",".join(capabilities), hashlib.sha256(pack).hexdigest()

    return _mapped(X.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), both, "doc_id bigint, commands int, ref string, capabilities string, pack string")


@_query("SELECT o_orderkey, 'ok' AS unpacked, 'refs/heads/a' AS good, CASE WHEN o_orderstatus = 'F' THEN 'refs/heads/b' END AS bad, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS message FROM orders")
def push_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a push, plain and by side band, parsed alike."""

    def both(key, status, message):
        rows = [("refs/heads/a", None)] + ([("refs/heads/b", message)] if status == "F" else [])
        got = protocol.parse_report(protocol.write_report("ok", rows))
        assert got == protocol.parse_report(protocol.write_report("ok", rows, banded=False))
        bad = next((x for x in got[1] if not x[1]), (None, False, None))
        return key, got[0], next(x[0] for x in got[1] if x[1]), bad[0], bad[2]

    return _mapped(X.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), both, "o_orderkey bigint, unpacked string, good string, bad string, message string")


@_query("SELECT DISTINCT event_type AS command, 'shallow wait-for-done' AS features, true AS has, 'report-status' AS shared FROM events")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An advertisement of commands with their features."""

    def both(kind):
        got = protocol.parse_capabilities(protocol.write_capabilities({"agent": ["x"], kind: ["shallow", "wait-for-done"]}))
        return kind, " ".join(got[kind]), kind in got, ",".join(pushing.shared_capabilities(["report-status", "atomic"], ["report-status", "ofs-delta"]))

    return _mapped(X.table(spark, sf_dir, "events").select("event_type").distinct(), both, "command string, features string, has boolean, shared string")


# References as tables


@_query(f"WITH r AS ({_LIVE}) SELECT name, oid FROM r UNION ALL SELECT 'HEAD', oid FROM r WHERE name = (SELECT min(name) FROM r)")
def local_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name that comes to an id, HEAD through the branch it names; a name that leads nowhere is left out."""
    live = _live(spark, sf_dir)
    first = live.agg(F.min("name")).first()[0]
    return refs.current_refs(live.select("name", F.col("oid").alias("target")).unionByName(spark.createDataFrame([("HEAD", f"ref: {first}"), ("refs/x/broken", "ref: refs/heads/none")], "name string, target string")))


@_query(f"WITH r AS ({_LIVE}) SELECT 'write' AS op, name, repeat('a', 40) AS target FROM r WHERE name LIKE '%4' UNION ALL SELECT 'delete', name, NULL FROM r WHERE name LIKE '%3'")
def frozen_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and deletes of a transaction as hooks see them."""
    r = _live(spark, sf_dir)
    both = r.where(F.col("name").endswith("3") | F.col("name").endswith("4")).select(F.lit(1).alias("seq"), F.lit("write").alias("op"), "name", F.lit("a" * 40).alias("target"))
    gone = r.where(F.col("name").endswith("3")).select(F.lit(2).alias("seq"), F.lit("delete").alias("op"), "name", F.lit(None).cast("string").alias("target"))
    writes, deletes = refs.frozen(both.unionByName(gone))
    return writes.select(F.lit("write").alias("op"), "name", "target").unionByName(deletes.select(F.lit("delete").alias("op"), "name", F.lit(None).cast("string").alias("target")))


@_query(f"SELECT 'refs/heads/' AS common, count(*) + 1 AS names FROM ({_LIVE})")
def ref_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch is made, another one deleted and made again, and what all names begin with."""
    live = _live(spark, sf_dir).select("name", F.col("oid").alias("target"))
    new = refs.create_refs(live, spark.createDataFrame([("refs/heads/zz", "a" * 40)], "name string, target string"))
    one = new.agg(F.min("name")).first()[0]
    back = refs.create_refs(refs.delete_branch(new, one), new.where(F.col("name") == one))
    return spark.createDataFrame([(refs.common_prefix(back), back.count())], "common string, names bigint")


@_query(f"WITH r AS ({_LIVE}) SELECT name, upper(oid) AS oid FROM r")
def refs_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several rows of a name the last one."""
    r = _live(spark, sf_dir)
    return refs.last_by_name(r.withColumn("ord", F.lit(0)).unionByName(r.select("name", F.upper("oid").alias("oid"), F.lit(1).alias("ord")))).select("name", "oid")


@_query(f"SELECT 'refs/heads/main' AS symref, 'refs/heads/main' AS branch, {_oid(chr(39) + 'x' + chr(39))} AS oid")
def default_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HEAD of a new repository, resolved, and the branch that a listing with HEAD's id alone is taken for."""
    tip = oid(F.lit("x"))
    table = refs.empty_refs(spark).unionByName(spark.range(1).select(F.lit("refs/heads/main").alias("name"), tip.alias("target")))
    listing = refs.resolve(table).select("name", "oid", F.lit(None).cast("string").alias("symref_target"))
    spec = pushing.default_spec(table)
    return spark.createDataFrame([(spec.target, refs.default_branch(listing), refs.target_oid(table))], "symref string, branch string, oid string")
