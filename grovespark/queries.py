"""The registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark import fixtures as X
from grovespark.functions import authors, codecs, names, paths
from grovespark.functions.oid import loose_path, oid, unframe, frame
from grovespark.operators import graph, packs, refs, trees, worktree
from grovespark.plans import importing, pushing

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _load() -> None:
    """The other modules register what they hold as they are imported."""
    for name in ("files", "functions", "worktrees"):
        importlib.import_module(f"grovespark.queries_{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


# Pieces of SQL that several oracles share.


def _oid(x: str, kind: str = "blob") -> str:
    return f"sha1(encode('{kind} ' || octet_length(encode({x}))) || '\\x00'::blob || encode({x}))"


_PATH = "concat(source, '/', lang, '/', doc_id, '.txt')"
_A = f"SELECT {_PATH} AS path, '100644' AS mode, {_oid('text')} AS oid FROM documents"
_B = f"""
SELECT {_PATH} AS path, CASE WHEN doc_id % 17 = 0 THEN '120000' WHEN doc_id % 13 = 0 THEN '100755' ELSE '100644' END AS mode,
  {_oid("CASE WHEN doc_id % 11 = 0 THEN concat(text, chr(10)) ELSE text END")} AS oid
FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT concat('bench/', item_id, '.txt'), '100644', {_oid('text')} FROM benchmark"""
_DAG = """
o AS (SELECT o_orderkey AS oid, o_custkey AS cust, cast(epoch(o_orderdate) AS BIGINT) AS ts,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p1 FROM orders),
e AS (SELECT oid AS child, p1 AS parent, 0 AS ord FROM o WHERE p1 IS NOT NULL
  UNION ALL SELECT o.oid, r.oid, 1 FROM o JOIN o r ON r.rn = 1 AND r.cust = o.cust + 1 AND r.ts < o.ts WHERE o.oid % 10 = 0 AND o.p1 IS NOT NULL)"""
_REF_LOG = f"""
SELECT event_id AS seq, ts, concat('refs/heads/user-', user_id) AS name, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op,
  {_oid("concat(event_id, ':', props)")} AS oid FROM events"""
_LIVE = f"""
SELECT name, oid FROM (SELECT name, op, oid, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS k FROM ({_REF_LOG})) WHERE k = 1 AND op = 'write'"""


# Ids and blobs


@_query(f"SELECT doc_id, {_oid('text')} AS oid, octet_length(encode(text)) AS size FROM documents")
def blob_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.blobs(spark, sf_dir).select("doc_id", "oid", "size")


@_query(f"SELECT oid, octet_length(encode(min(text))) AS size FROM (SELECT text, {_oid('text')} AS oid FROM documents) GROUP BY oid")
def object_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store never holds an id twice."""
    b = X.blobs(spark, sf_dir).select("oid", "size")
    return refs.ingest(b.limit(0), b)


@_query(f"SELECT doc_id, concat(substr(oid, 1, 2), '/', substr(oid, 3)) AS path FROM (SELECT doc_id, {_oid('text')} AS oid FROM documents)")
def loose_object_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.blobs(spark, sf_dir).select("doc_id", loose_path(F.col("oid")).alias("path"))


@_query("SELECT doc_id, 'blob' AS type, octet_length(encode(text)) AS size, true AS same FROM documents")
def object_frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.blobs(spark, sf_dir).withColumn("u", unframe(frame(F.col("text"))))
    return rows.select("doc_id", F.col("u.type").alias("type"), F.col("u.size").alias("size"), (F.col("u.content") == F.col("text").cast("binary")).alias("same"))


@_query(f"""
WITH s AS (SELECT 0 AS p, item_id AS id, {_oid('text')} AS oid FROM benchmark UNION ALL SELECT 1, doc_id, {_oid('text')} FROM documents)
SELECT oid, min(p) AS source, arg_min(id, p * 1000000000000 + id) AS id FROM s GROUP BY oid""")
def composite_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = X.table(spark, sf_dir, "benchmark").select(oid(F.col("text")).alias("oid"), F.col("item_id").alias("id"), F.lit(0).alias("source")).groupBy("oid").agg(F.min("id").alias("id"), F.min("source").alias("source"))
    second = X.blobs(spark, sf_dir).groupBy("oid").agg(F.min("doc_id").alias("id")).withColumn("source", F.lit(1))
    return refs.composite([first, second.select("oid", "id", "source")])


@_query(f"SELECT count(*) AS objects, cast(sum(size) AS BIGINT) AS bytes FROM (SELECT DISTINCT {_oid('text')} AS oid, octet_length(encode(text)) AS size FROM documents)")
def store_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.blobs(spark, sf_dir).select("oid", "size")
    store = b.limit(0)
    once = refs.ingest(store, b)
    return refs.ingest(once, b).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


# Snapshots and trees


_KIND = "CASE {m} WHEN '120000' THEN 'symlink' WHEN '040000' THEN 'tree' ELSE 'blob' END"


@_query(f"""
WITH a AS ({_A}), b AS ({_B})
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'create' WHEN b.path IS NULL THEN 'remove' ELSE 'update' END AS change,
  CASE WHEN a.path IS NOT NULL THEN {_KIND.format(m='a.mode')} END AS old_kind, a.mode AS old_mode, a.oid AS old_oid,
  CASE WHEN b.path IS NOT NULL THEN {_KIND.format(m='b.mode')} END AS new_kind, b.mode AS new_mode, b.oid AS new_oid,
  a.path IS NOT NULL AND b.path IS NOT NULL AND {_KIND.format(m='a.mode')} <> {_KIND.format(m='b.mode')} AS kind_changed,
  coalesce(a.mode <> b.mode, false) AS mode_changed, coalesce(a.oid <> b.oid, false) AS content_changed
FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.mode <> b.mode OR a.oid <> b.oid""")
def diff_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.diff(X.snapshot_a(spark, sf_dir), X.snapshot_b(spark, sf_dir))


@_query(f"""
WITH a AS ({_A}), b AS ({_B})
SELECT CASE WHEN a.path IS NULL THEN 'create' WHEN b.path IS NULL THEN 'remove' ELSE 'update' END AS change, count(*) AS n
FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.mode <> b.mode OR a.oid <> b.oid GROUP BY 1""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_trees(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


_TREE = "sha1(encode('tree ' || octet_length(body)) || '\\x00'::blob || body)"
_MERKLE = f"""
l AS (SELECT r_name AS r, n_name AS n, c_name AS c, {_oid('c_mktsegment')} AS oid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t2 AS (SELECT r, n, unhex(string_agg(hex(encode('100644 ' || c) || '\\x00'::blob || unhex(oid)), '' ORDER BY c)) AS body FROM l GROUP BY r, n),
t1 AS (SELECT r, unhex(string_agg(hex(encode('40000 ' || n) || '\\x00'::blob || unhex({_TREE})), '' ORDER BY n || '/')) AS body FROM t2 GROUP BY r),
t0 AS (SELECT unhex(string_agg(hex(encode('40000 ' || r) || '\\x00'::blob || unhex({_TREE})), '' ORDER BY r || '/')) AS body FROM t1)"""


@_query(f"WITH {_MERKLE} SELECT concat(r, '/', n) AS path, {_TREE} AS oid FROM t2")
def merkle_nation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.build(X.merkle_leaves(spark, sf_dir), deepest=2).where(paths.depth(F.col("path")) == 1).select("path", "oid")


@_query(f"WITH {_MERKLE} SELECT {_TREE} AS oid FROM t0")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.build(X.merkle_leaves(spark, sf_dir), deepest=2).where("path = ''").select("oid")


def _tree_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entries, root) parsed from the trees that a build wrote."""
    made = trees.build(X.merkle_leaves(spark, sf_dir), deepest=2)
    parsed = made.select(F.col("oid").alias("tree_oid"), F.posexplode(codecs.parse_tree("content")).alias("ord", "e"))
    entries = parsed.select("tree_oid", "ord", F.col("e.mode").alias("mode"), F.col("e.name").alias("name"), F.col("e.oid").alias("oid")).dropDuplicates(["tree_oid", "ord"])
    return entries, made.where("path = ''").select("path", "oid")


@_query(f"WITH {_MERKLE} SELECT concat(r, '/', n, '/', c) AS path, '100644' AS mode, oid FROM l")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.flatten(*_tree_entries(spark, sf_dir))


@_query(f"WITH {_MERKLE} SELECT r || '/' || n AS directory, c AS name, row_number() OVER (PARTITION BY r, n ORDER BY c) - 1 AS ord FROM l")
def tree_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = trees.build(X.merkle_leaves(spark, sf_dir), deepest=2).where(paths.depth(F.col("path")) == 1)
    rows = made.select(F.col("path").alias("directory"), F.posexplode(codecs.parse_tree("content")).alias("ord", "e"))
    return rows.select("directory", F.col("e.name").alias("name"), F.col("ord").cast("bigint").alias("ord"))


_OPS = f"""
SELECT doc_id AS seq, 'delete' AS op, {_PATH} AS path, NULL AS mode, NULL AS oid FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id + 1000000000, 'upsert', {_PATH}, '100644', {_oid("concat(text, chr(10))")} FROM documents WHERE doc_id % 11 = 0"""


@_query(f"SELECT path, seq, op, mode, oid FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM ({_OPS})) WHERE k = 1")
def patch_last_op_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.last_ops(X.overlay_ops(spark, sf_dir))


_OVERLAY = f"""
WITH a AS ({_A}), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM ({_OPS})) WHERE k = 1)
SELECT coalesce(p.path, a.path) AS path, coalesce(p.mode, a.mode) AS mode, coalesce(p.oid, a.oid) AS oid
FROM a FULL JOIN p ON a.path = p.path WHERE p.op IS NULL OR p.op <> 'delete'"""


@_query(_OVERLAY)
def worktree_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worktree.overlay(X.snapshot_a(spark, sf_dir), X.overlay_ops(spark, sf_dir))


@_query(f"""
WITH left_over AS ({_OVERLAY.strip()})
SELECT path, mode, oid FROM left_over UNION ALL
SELECT DISTINCT source || '/' || lang, '040000', '4b825dc642cb6eb9a060e54bf8d69288fbee4904' FROM documents
WHERE source || '/' || lang NOT IN (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM left_over)""")
def tree_patch_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.patch(X.snapshot_a(spark, sf_dir), X.overlay_ops(spark, sf_dir).withColumn("from_path", F.lit(None).cast("string")).withColumn("to_path", F.lit(None).cast("string"))).leaves


@_query(f"""
SELECT CASE WHEN path LIKE 'src1/%' THEN 'moved/' || substr(path, 6) ELSE path END AS path, mode, oid FROM ({_A})
UNION ALL SELECT 'copy/' || substr(path, 6), mode, oid FROM ({_A}) WHERE path LIKE 'src2/%'""")
def worktree_move_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worktree.Worktree(X.snapshot_a(spark, sf_dir)).move("src1", "moved").copy("src2", "copy").current


@_query(f"""
WITH c AS (SELECT {_PATH} AS path FROM documents WHERE doc_id % 11 = 0)
SELECT DISTINCT unnest(['', string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2]]) AS path FROM c""")
def worktree_dirty_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.dirty_directories(X.snapshot_a(spark, sf_dir).where(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("int") % 11 == 0))


@_query(f"""
WITH c AS (SELECT {_PATH} AS path, source AS s, lang AS l FROM documents WHERE doc_id % 11 = 0),
u AS (SELECT '' AS directory, s AS name FROM c UNION ALL SELECT s, l FROM c UNION ALL SELECT s || '/' || l, substr(path, length(s || '/' || l) + 2) FROM c)
SELECT directory, count(*) AS dirty_descendants, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM u GROUP BY directory""")
def worktree_changed_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = X.snapshot_a(spark, sf_dir).where(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("int") % 11 == 0)
    return trees.changed_children(changed).withColumn("names", F.array_join("names", ","))


@_query(f"""
SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, string_split(path, '/')[-1] AS base, cast(len(string_split(path, '/')) - 1 AS INTEGER) AS depth FROM ({_A})""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return X.snapshot_a(spark, sf_dir).select("path", paths.parent_path(p).alias("parent"), paths.base_name(p).alias("base"), paths.depth(p).alias("depth"))


# Commits


@_query(f"WITH {_DAG} SELECT child, parent, ord FROM e")
def commit_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of commits that hold their parents as a list."""
    made = X.commit_edges(spark, sf_dir).groupBy("child").agg(F.array_sort(F.collect_list(F.struct("ord", "parent"))).alias("p"))
    return graph.commit_edges(made.select(F.col("child").alias("oid"), F.col("p.parent").alias("parents")))


def _heads(spark: SparkSession, sf_dir: str, divisor: int, rest: int = 0) -> DataFrame:
    return X.commits(spark, sf_dir).where(F.col("oid") % divisor == rest).select("oid")


def _closure_sql(start: str, edges: str = "e", name: str = "reach") -> str:
    return f"{name}(oid) AS ({start} UNION SELECT {edges}.parent FROM {name} JOIN {edges} ON {edges}.child = {name}.oid)"


def _longest_sql(nodes: str) -> str:
    """depth by repeated relaxing: generation of every node from its roots."""
    return f"g(oid, d) AS (SELECT oid, 0 FROM {nodes} UNION SELECT e.child, g.d + 1 FROM g JOIN e ON e.parent = g.oid), gen AS (SELECT oid, max(d) AS generation FROM g GROUP BY oid)"


@_query(f"WITH RECURSIVE {_DAG}, {_closure_sql('SELECT oid FROM o WHERE oid % 100 = 0')} SELECT oid FROM reach")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(X.commit_edges(spark, sf_dir), _heads(spark, sf_dir, 100))


@_query(f"WITH RECURSIVE {_DAG}, {_closure_sql('SELECT oid FROM o WHERE oid % 3 = 0')} SELECT oid FROM o WHERE oid NOT IN (SELECT oid FROM reach)")
def gc_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.gc(X.commit_edges(spark, sf_dir), X.commits(spark, sf_dir), _heads(spark, sf_dir, 3))


@_query(f"""
WITH RECURSIVE {_DAG}, {_closure_sql('SELECT oid FROM o WHERE oid % 50 = 0', name='want')}, {_closure_sql('SELECT oid FROM o WHERE oid % 20 = 1', name='have')}
SELECT oid FROM want EXCEPT SELECT oid FROM have""")
def objects_to_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.to_send(X.commit_edges(spark, sf_dir), _heads(spark, sf_dir, 50), _heads(spark, sf_dir, 20, 1))


@_query("SELECT DISTINCT o_orderkey AS oid FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def have_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    haves = X.table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("oid"))
    return graph.common(haves, X.commits(spark, sf_dir))


_ANCESTORS = f"""
WITH RECURSIVE {_DAG}, pairs AS (SELECT a.oid AS old, b.oid AS new FROM o a JOIN o b ON a.cust = b.cust AND a.rn = 1
  UNION SELECT b.oid, a.oid FROM o a JOIN o b ON a.cust = b.cust AND a.rn = 1),
w(new, here) AS (SELECT DISTINCT new, new FROM pairs UNION SELECT w.new, e.parent FROM w JOIN e ON e.child = w.here)
SELECT old, new, EXISTS (SELECT 1 FROM w WHERE w.new = pairs.new AND w.here = pairs.old) AS ancestor FROM pairs"""


def _first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit with its customer's first one, both ways."""
    o = X.commit_table(spark, sf_dir)
    both = o.select(F.col("oid").alias("b"), "cust").join(o.where("rn = 1").select(F.col("oid").alias("a"), "cust"), "cust")
    return both.select(F.col("a").alias("old"), F.col("b").alias("new")).union(both.select("b", "a")).distinct()


@_query(_ANCESTORS)
def is_ancestor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.is_ancestor(X.commit_edges(spark, sf_dir), _first_pairs(spark, sf_dir)).select("old", "new", "ancestor")


_LOG = "SELECT h.oid, h.ts, row_number() OVER (ORDER BY ts DESC, generation DESC, h.oid) - 1 AS position FROM h JOIN gen ON gen.oid = h.oid"


def _log_sql(start: str, where: str = "true", edges: str = "e", extra: str = "") -> str:
    return f"""
WITH RECURSIVE {_DAG}{extra}, {_closure_sql(start, edges)}, h AS (SELECT o.oid, o.ts FROM o JOIN reach ON reach.oid = o.oid WHERE {where}),
g(oid, d) AS (SELECT oid, 0 FROM h UNION SELECT e.child, g.d + 1 FROM g JOIN e ON e.parent = g.oid JOIN h ON h.oid = e.child),
gen AS (SELECT oid, max(d) AS generation FROM g GROUP BY oid) """


_START = "SELECT oid FROM o WHERE oid % 40 = 0"


_START_CLOSURE = f"WITH RECURSIVE {_DAG}, {_closure_sql(_START)} SELECT oid FROM reach"


def _log(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = graph.log(X.commits(spark, sf_dir), X.commit_edges(spark, sf_dir), _heads(spark, sf_dir, 40), **options)
    return found.select("oid", "ts", "position")


@_query(_log_sql(_START) + _LOG)
def log_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)


@_query("SELECT * FROM (" + _log_sql(_START) + _LOG + ") WHERE position >= 25 AND position < 125")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, skip=25, max_count=100).withColumn("position", F.col("position") + 25)


_SINCE, _UNTIL = 852076800, 883612800  # 1997


@_query(f"""
WITH RECURSIVE {_DAG}, late AS (SELECT e.* FROM e JOIN o ON o.oid = e.child AND o.ts >= {_SINCE}), {_closure_sql(_START, 'late')},
h AS (SELECT o.oid, o.ts FROM o JOIN reach ON reach.oid = o.oid WHERE o.ts >= {_SINCE}),
g(oid, d) AS (SELECT oid, 0 FROM h UNION SELECT e.child, g.d + 1 FROM g JOIN e ON e.parent = g.oid JOIN h ON h.oid = e.child),
gen AS (SELECT oid, max(d) AS generation FROM g GROUP BY oid)
SELECT h.oid, h.ts, row_number() OVER (ORDER BY ts DESC, generation DESC, h.oid) - 1 AS position FROM h JOIN gen ON gen.oid = h.oid WHERE h.ts <= {_UNTIL}""")
def log_since_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, since=_SINCE, until=_UNTIL)


@_query(_log_sql(_START, edges="f", extra=", f AS (SELECT * FROM e WHERE ord = 0)") + _LOG)
def log_first_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, first_parent=True)


@_query(_log_sql(_START, "o.oid NOT IN (SELECT oid FROM gone)", extra=", " + _closure_sql("SELECT oid FROM o WHERE oid % 7 = 0", name="gone")) + _LOG)
def log_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, exclude=_heads(spark, sf_dir, 7))


@_query(f"""
WITH RECURSIVE {_DAG}, {_closure_sql(_START)}, k(oid, d) AS (SELECT oid, 0 FROM reach UNION SELECT e.parent, k.d + 1 FROM k JOIN e ON e.child = k.oid)
SELECT oid, max(d) AS level FROM k GROUP BY oid""")
def log_topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = X.commit_edges(spark, sf_dir)
    return graph.topo_levels(edges, graph.closure(edges, _heads(spark, sf_dir, 40)))


@_query()
def log_topo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, order="topo")


@_query(f"WITH {_DAG} SELECT parent AS oid, count(*) AS children FROM e GROUP BY parent")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.child_counts(X.commit_edges(spark, sf_dir))


# The same walks level by level, as for graphs that no driver holds


@_query(_START_CLOSURE)
def closure_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(X.commit_edges(spark, sf_dir), _heads(spark, sf_dir, 40), small=0)


@_query(_log_sql(_START) + _LOG)
def log_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, small=0)


@_query(f"WITH RECURSIVE {_DAG}, {_longest_sql('o')} SELECT oid, generation FROM gen")
def generations_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.generations(X.commit_edges(spark, sf_dir), X.commits(spark, sf_dir), small=0)


@_query(_ANCESTORS)
def is_ancestor_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.is_ancestor(X.commit_edges(spark, sf_dir), _first_pairs(spark, sf_dir), small=0).select("old", "new", "ancestor")


# References


_NAMES = ["'refs/heads/user-' || user_id", "'refs/heads/a..b' || user_id", "'refs/tags/' || event_type", "'heads/' || user_id", "'refs/heads/x.lock'", "'refs/x/y ' || user_id", "'HEAD'"]


@_query("SELECT name, name = 'HEAD' OR (name LIKE 'refs/%/_%' AND NOT regexp_matches(name, '[\\x00-\\x20\\x7f~^:?*\\[\\\\]|\\.\\.|@\\{|//') AND NOT regexp_matches(name, '(^|/)(\\.|\\.\\.)(/|$)|\\.lock(/|$)') AND NOT regexp_matches(name, '[/.]$')) AS valid FROM (" + " UNION ".join(f"SELECT {n} AS name FROM events" for n in _NAMES) + ")")
def ref_name_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    rows = None
    for n in _NAMES:
        part = e.select(F.expr(n).alias("name"))
        rows = part if rows is None else rows.union(part)
    return rows.distinct().select("name", names.is_ref_name(F.col("name")).alias("valid"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovespark.streaming.ref_log import live

    return live(X.ref_log(spark, sf_dir)).where("op = 'write'").select("name", "oid")


@_query(_LIVE)
def ref_state_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir)


@_query(f"""
WITH l AS ({_REF_LOG}), q AS (SELECT DISTINCT name, cast('2024-01-15 00:00:00' AS TIMESTAMP) AS moment FROM l)
SELECT name, CASE WHEN op = 'write' THEN oid END AS oid FROM (
  SELECT q.name, l.op, l.oid, row_number() OVER (PARTITION BY q.name ORDER BY l.ts DESC, l.seq DESC) AS k FROM q LEFT JOIN l ON l.name = q.name AND l.ts <= q.moment) WHERE k = 1""")
def ref_state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = X.ref_log(spark, sf_dir)
    moments = log.select("name", F.lit("2024-01-15 00:00:00").cast(log.schema["ts"].dataType).alias("at")).distinct()
    return refs.state_at(log, moments).select("name", "oid")


@_query(f"SELECT name, oid FROM ({_LIVE}) WHERE regexp_matches(name, '^refs/heads/.*1$')")
def ref_glob_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.select_refs(_live(spark, sf_dir), ["refs/heads/*1"]).select("name", "oid")


@_query(f"SELECT name, oid FROM ({_LIVE}) WHERE name NOT LIKE 'refs/heads/user-1%'")
def ref_view_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.exclude_refs(_live(spark, sf_dir), "refs/heads/user-1*")


@_query(f"""
WITH l AS ({_LIVE}) SELECT name, oid FROM l WHERE name LIKE '%1' UNION ALL
SELECT name, upper(oid) AS oid FROM l WHERE name LIKE 'refs/heads/user-1%' AND name NOT LIKE '%1'""")
def ref_view_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _live(spark, sf_dir)
    return refs.union_refs(refs.select_refs(r, ["*1"]).select("name", "oid"), refs.select_refs(r, ["refs/heads/user-1*"]).select("name", F.upper("oid").alias("oid")))


@_query(f"SELECT name, oid FROM ({_LIVE}) WHERE name LIKE 'refs/heads/user-2%' OR name = 'HEAD'")
def ref_prefix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.list_refs(_live(spark, sf_dir), ["refs/heads/user-2"])


def _symbolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    name = lambda turn: F.concat(F.lit("refs/chain/"), F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))
    return c.select(name(F.col("turn")).alias("name"), F.when(F.col("turn") == 0, oid(F.col("text"))).otherwise(F.concat(F.lit("ref: "), name(F.col("turn") - 1))).alias("target"))


@_query(f"""
WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn), f AS (SELECT conv_id, {_oid('text')} AS oid FROM c WHERE turn = 0)
SELECT concat('refs/chain/', c.conv_id, '/', turn) AS name, CASE WHEN turn > 0 THEN concat('refs/chain/', c.conv_id, '/0') END AS symref, f.oid AS oid FROM c JOIN f ON f.conv_id = c.conv_id""")
def symbolic_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.resolve(_symbolic(spark, sf_dir)).select("name", "symref", "oid")


@_query("SELECT conv_id * 100000 + turn AS oid, conv_id * 100000 AS peeled FROM conversations GROUP BY conv_id, turn")
def peel_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    ids = c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("oid"), "turn")
    return refs.peel(ids.where("turn > 0").select("oid", (F.col("oid") - 1).alias("object")), ids.select("oid"))


@_query(f"""
WITH s AS (SELECT o_orderkey AS oid FROM orders WHERE o_orderkey % 4 = 0), u AS (SELECT o_orderkey AS oid FROM orders WHERE o_orderkey % 8 = 0), a AS (SELECT o_orderkey AS oid FROM orders WHERE o_orderkey % 5 = 0)
(SELECT oid FROM s EXCEPT SELECT oid FROM u) UNION SELECT oid FROM a""")
def shallow_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.commits(spark, sf_dir).select("oid")
    return refs.shallow_update(c.where("oid % 4 = 0"), c.where("oid % 5 = 0"), c.where("oid % 8 = 0"))


@_query(f"""
WITH r AS ({_LIVE}) SELECT name, oid FROM r WHERE name NOT LIKE '%3' AND name NOT LIKE '%4' UNION ALL SELECT name, repeat('a', 40) FROM r WHERE name LIKE '%4'""")
def ref_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _live(spark, sf_dir)
    gone = r.where(F.col("name").endswith("3")).select(F.lit(2).alias("seq"), F.lit("delete").alias("op"), "name", F.lit(None).cast("string").alias("target"))
    first = r.where(F.col("name").endswith("3") | F.col("name").endswith("4")).select(F.lit(1).alias("seq"), F.lit("write").alias("op"), "name", F.lit("a" * 40).alias("target"))
    return refs.transaction(r.withColumnRenamed("oid", "target"), first.unionByName(gone)).select("name", F.col("target").alias("oid"))


# Plans


_SPECS = ["refs/heads/*:refs/remotes/origin/*", "+refs/heads/user-1*:refs/mirror/*", ":refs/heads/user-2"]


@_query(f"""
WITH r AS ({_LIVE}), m AS (
  SELECT 0 AS spec, name AS local_ref, 'refs/remotes/origin/' || substr(name, 12) AS remote_ref, oid AS local_oid, false AS force FROM r
  UNION ALL SELECT 1, name, 'refs/mirror/' || substr(name, 18), oid, true FROM r WHERE name LIKE 'refs/heads/user-1%'
  UNION ALL SELECT 2, '', 'refs/heads/user-2', NULL, false)
SELECT m.spec, m.local_ref, m.remote_ref, m.local_oid, r.oid AS remote_oid, m.force, count(*) OVER (PARTITION BY remote_ref) > 1 AS conflict FROM m LEFT JOIN r ON r.name = m.remote_ref""")
def push_ref_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _live(spark, sf_dir)
    return pushing.plan_refs(r, r, [names.RefSpec.parse(s) for s in _SPECS], strict=False)


@_query(f"""
WITH r AS ({_LIVE}), m AS (SELECT name AS local_ref, 'refs/all/' || substr(name, 12) AS remote_ref FROM r UNION ALL SELECT name, 'refs/all/user-' || substr(name, 18) FROM r WHERE name LIKE 'refs/heads/user-1%')
SELECT remote_ref, count(*) AS n FROM m GROUP BY remote_ref HAVING count(*) > 1""")
def push_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _live(spark, sf_dir)
    specs = [names.RefSpec.parse(s) for s in ("refs/heads/*:refs/all/*", "refs/heads/user-1*:refs/all/user-*")]
    return pushing.plan_refs(r, r.limit(0), specs, strict=False).where("conflict").groupBy("remote_ref").agg(F.count("*").alias("n"))


def _import_inputs(spark: SparkSession, sf_dir: str):
    """Branches of customers: here at their first order, at the remote at their last; every ninth is here at its last and at the
    remote at its first, which is no fast-forward."""
    o = X.commit_table(spark, sf_dir)
    ends = o.groupBy("cust").agg(F.min_by("oid", "rn").alias("first"), F.max_by("oid", "rn").alias("last"))
    text = lambda c: F.lpad(F.col(c).cast("string"), 40, "0")
    name = F.concat(F.lit("refs/heads/c"), F.col("cust").cast("string"))
    back = F.col("cust") % 9 == 0
    remote = ends.where("cust % 5 <> 0").select(name.alias("name"), F.when(back, text("first")).otherwise(text("last")).alias("oid"))
    local = ends.where("cust % 4 <> 0").select(name.alias("name"), F.when(back, text("last")).otherwise(text("first")).alias("target"))
    objects = o.select(text("oid").alias("oid"), F.lit("commit").alias("type"))
    edges = X.commit_edges(spark, sf_dir).select(text("child").alias("child"), text("parent").alias("parent"), "ord")
    return remote, local, objects, edges


_IMPORT = f"""
WITH {_DAG}, ends AS (SELECT cust, arg_min(oid, rn) AS first, arg_max(oid, rn) AS last FROM o GROUP BY cust),
j AS (SELECT 'refs/heads/c' || cust AS local_ref, cust % 9 = 0 AS back, cust % 4 <> 0 AS here, cust % 5 <> 0 AS there, lpad(cast(first AS VARCHAR), 40, '0') AS first, lpad(cast(last AS VARCHAR), 40, '0') AS last FROM ends)
"""


@_query(_IMPORT + """
SELECT local_ref, CASE WHEN back THEN first ELSE last END AS new_oid,
  CASE WHEN NOT here THEN 'create' WHEN first = last THEN 'same' WHEN back THEN 'no fast-forward' ELSE 'update' END AS verdict FROM j WHERE there""")
def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local, objects, edges = _import_inputs(spark, sf_dir)
    mapped = remote.select(F.lit(0).alias("seq"), "name", "oid", F.col("name").alias("local_ref"), F.lit(importing.FAST_FORWARD).alias("policy"), F.lit(None).cast("string").alias("label"))
    return importing.finalize(mapped, local, objects, edges)["judged"].select("local_ref", "new_oid", "verdict")


@_query(_IMPORT + "SELECT local_ref AS name FROM j WHERE here AND NOT there")
def import_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local, objects, edges = _import_inputs(spark, sf_dir)
    plan = importing.Plan(spark).to_namespace(importing.View(remote), "refs/heads/*", importing.MIRROR, prune=True)
    return importing.preview(plan, local, objects, edges).prune_operations.select("name")


@_query(_IMPORT + "SELECT local_ref, 'no fast-forward' AS reason FROM j WHERE there AND here AND back AND first <> last")
def policy_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local, objects, edges = _import_inputs(spark, sf_dir)
    updates = remote.join(local, "name", "left").select(F.col("name").alias("local_ref"), F.col("oid").alias("remote_oid"), F.col("target").alias("current_oid"), F.lit(False).alias("force"))
    return importing.apply_updates(updates, local, objects, edges)[1]


@_query(_IMPORT + "SELECT local_ref AS remote_ref, 'no fast-forward' AS reason FROM j WHERE there AND here AND NOT back AND first <> last")
def push_fast_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local, objects, edges = _import_inputs(spark, sf_dir)
    items = pushing.plan_refs(local.select("name", F.col("target").alias("oid")), remote, [names.RefSpec.parse("refs/heads/*:refs/heads/*")])
    return pushing.check_fast_forward(items, objects, edges).where("reason IS NOT NULL").select("remote_ref", "reason")


# Packs


_PACK = f"""
p AS (SELECT cast(doc_id % 3 AS INTEGER) AS pack, doc_id AS seq, {_oid('text')} AS oid, octet_length(encode(text)) AS len FROM documents
  UNION ALL SELECT 3, doc_id, {_oid('text')}, octet_length(encode(text)) FROM documents WHERE doc_id % 10 = 0),
w AS (SELECT pack, seq, oid, cast(12 + coalesce(sum(len) OVER (PARTITION BY pack ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p)"""


@_query(f'WITH {_PACK} SELECT pack, seq, oid, "offset" FROM w')
def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.offsets(X.pack_entries(spark, sf_dir)).select("pack", "seq", "oid", "offset")


@_query(f"""
WITH {_PACK}, n AS (SELECT pack, cast('0x' || substr(oid, 1, 2) AS INTEGER) AS first_byte, count(*) AS n FROM p GROUP BY 1, 2),
g AS (SELECT pack, first_byte FROM (SELECT DISTINCT pack FROM p), (SELECT cast(range AS INTEGER) AS first_byte FROM range(256)))
SELECT g.pack, g.first_byte, cast(sum(coalesce(n.n, 0)) OVER (PARTITION BY g.pack ORDER BY g.first_byte) AS BIGINT) AS count FROM g LEFT JOIN n ON n.pack = g.pack AND n.first_byte = g.first_byte""")
def pack_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.fanout(X.pack_entries(spark, sf_dir), ["pack"])


@_query(f"""
WITH {_PACK} SELECT oid, pack_id, "offset" FROM (SELECT oid, pack AS pack_id, "offset", row_number() OVER (PARTITION BY oid ORDER BY (pack = 1) DESC, pack DESC, "offset") AS k FROM w) WHERE k = 1""")
def midx_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = packs.offsets(X.pack_entries(spark, sf_dir)).select("oid", F.col("pack").alias("pack_id"), "offset")
    return packs.winners(index, 1)


@_query(f"""
WITH {_PACK} SELECT oid, pack AS layer, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY pack DESC, "offset" DESC) AS k FROM w WHERE seq IN (SELECT min(doc_id) FROM documents GROUP BY text)) WHERE k = 1""")
def midx_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packs.offsets(X.pack_entries(spark, sf_dir))
    first = X.blobs(spark, sf_dir).groupBy("oid").agg(F.min("doc_id").alias("seq"))
    return packs.newest_layer(rows.join(first, ["oid", "seq"], "left_semi").select(F.col("pack").alias("layer"), "oid", "offset"))


@_query(f"WITH {_PACK} SELECT oid FROM p WHERE pack = 3 EXCEPT SELECT oid FROM p WHERE pack = 1")
def midx_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packs.offsets(X.pack_entries(spark, sf_dir)).select("oid", F.col("pack").alias("pack_id"), "offset")
    return packs.incremental(rows.where("pack_id = 3"), rows.where("pack_id = 1")).select("oid")


@_query(f"""
WITH b AS (SELECT DISTINCT {_oid('text')} AS oid, octet_length(encode(text)) AS size, 'blob' AS type FROM documents UNION SELECT DISTINCT {_oid('html')}, octet_length(encode(html)), 'page' FROM pages)
SELECT type, count(*) AS objects, cast(sum(size) AS BIGINT) AS bytes FROM b GROUP BY ROLLUP (type)""")
def size_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = X.table(spark, sf_dir, "pages").select(oid(F.col("html")).alias("oid"), F.octet_length("html").cast("bigint").alias("size"), F.lit("page").alias("type"))
    both = X.blobs(spark, sf_dir).select("oid", "size", F.lit("blob").alias("type")).unionByName(html)
    return packs.size_by_type(both.distinct())


@_query("""
WITH RECURSIVE s(i, k, c) AS (SELECT cast(range AS UBIGINT), 0, cast(range AS UBIGINT) FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM s WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS steps FROM s WHERE k = 8),
d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: cast('0x' || h AS UBIGINT)) AS bytes FROM documents)
SELECT doc_id, cast(xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: xor(c >> 8, t.steps[cast(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS crc32 FROM d, t""")
def crc32_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.with_crc(X.blobs(spark, sf_dir), "text").select("doc_id", "crc32")


@_query("SELECT doc_id, true AS same, octet_length(encode(text)) + 5 AS size, length(text) > 200 AS smaller FROM documents")
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to one whose first characters have moved to the end, and back; a delta of a long one is the smaller."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").cast("binary").alias("base"), F.concat(F.substring("text", 51, 1 << 30), F.lit("!new!"), F.substring("text", 1, 50)).cast("binary").alias("target"))
    made = d.withColumn("delta", codecs.delta_between("base", "target"))
    smaller = (F.octet_length("delta") < F.octet_length("target")) & (F.length("text") > 200)
    return made.select("doc_id", (codecs.delta_target("base", "delta") == F.col("target")).alias("same"), F.octet_length(codecs.delta_target("base", "delta")).cast("bigint").alias("size"), smaller.alias("smaller"))


@_query("SELECT conv_id, turn, CASE WHEN n <= 65520 THEN upper(lpad(to_hex(n + 4), 4, '0')) END AS head, CASE WHEN n <= 65520 THEN n + 4 END AS size FROM (SELECT conv_id, turn, octet_length(encode(text)) AS n FROM conversations)")
def pkt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each turn; null for a text that is too long for one."""
    c = X.table(spark, sf_dir, "conversations").withColumn("f", codecs.frame_bytes("text"))
    return c.select("conv_id", "turn", F.substring("f", 1, 4).cast("string").alias("head"), F.octet_length("f").cast("bigint").alias("size"))


@_query("""
SELECT c_custkey, c_name AS name, lower(c_name) || '@example.org' AS email, cast(cast(abs(round(c_acctbal)) AS BIGINT) AS VARCHAR) AS timestamp, CASE WHEN c_nationkey % 2 = 0 THEN '+0000' ELSE '-0530' END AS timezone
FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 10 = 0""")
def author_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "customer")
    a = F.struct(F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"), F.abs(F.round("c_acctbal")).cast("bigint").alias("timestamp"), F.when(F.col("c_nationkey") % 2 == 0, "+0000").otherwise("-0530").alias("timezone"))
    line = F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(authors.format_author(a))
    return c.select("c_custkey", authors.parse_author(line).alias("p")).select("c_custkey", "p.name", "p.email", F.col("p.timestamp").cast("string").alias("timestamp"), "p.timezone")


@_query(f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) FILTER (op = 'write') AS writes, count(*) FILTER (op = 'delete') AS deletes FROM ({_REF_LOG}) GROUP BY 1")
def ref_log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovespark.streaming.ref_log import windowed

    return windowed(X.ref_log(spark, sf_dir)).select("start", F.col("writes").cast("bigint"), F.col("deletes").cast("bigint"))


# Smaller operators


@_query(f'WITH {_PACK} SELECT w.oid, w.pack, w."offset" FROM w WHERE oid IN (SELECT {_oid("text")} FROM documents WHERE doc_id % 25 = 0)')
def pack_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = packs.offsets(X.pack_entries(spark, sf_dir)).select("oid", "pack", "offset")
    return packs.lookup(index, X.blobs(spark, sf_dir).where("doc_id % 25 = 0"))


@_query(f"WITH {_PACK} SELECT DISTINCT pack FROM p WHERE pack NOT IN (SELECT pack FROM p WHERE seq % 3 = 1 AND pack < 3)")
def packs_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.pack_entries(spark, sf_dir)
    return packs.uncovered(e.select("pack").distinct(), e.where("seq % 3 = 1 AND pack < 3"))


@_query(f"WITH {_PACK} SELECT oid, row_number() OVER (ORDER BY oid) - 1 AS position FROM (SELECT DISTINCT oid FROM p)")
def pack_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.positions(X.pack_entries(spark, sf_dir).select("oid").distinct())


@_query(f"SELECT name, 'refs/remotes/origin/' || substr(name, 12) AS local_ref FROM ({_LIVE})")
def refspec_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = names.RefSpec.parse("refs/heads/*:refs/remotes/origin/*")
    return _live(spark, sf_dir).where(spec.matches(F.col("name"))).select("name", spec.maps(F.col("name")).alias("local_ref"))


@_query(f"SELECT path, {_KIND.format(m='mode')} AS kind, mode AS disk_mode, mode IN ('100644', '100755') AS is_blob FROM ({_B})")
def mode_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mode")
    return X.snapshot_b(spark, sf_dir).select("path", paths.kind(m).alias("kind"), paths.disk_mode(m).alias("disk_mode"), paths.is_blob_mode(m).alias("is_blob"))


@_query("SELECT DISTINCT source AS name, 'tree' AS kind FROM documents")
def worktree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worktree.Worktree(X.snapshot_a(spark, sf_dir)).children("").select("name", "kind")


@_query(f"""
WITH o AS ({_OVERLAY}), a AS ({_A}) SELECT path, mode, oid FROM o WHERE path NOT LIKE 'src1/%' UNION ALL SELECT path, mode, oid FROM a WHERE path LIKE 'src1/%'""")
def worktree_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = X.snapshot_a(spark, sf_dir)
    return worktree.Worktree(base, worktree.overlay(base, X.overlay_ops(spark, sf_dir))).restore("src1").current


@_query(f"""
WITH r AS ({_LIVE}) SELECT coalesce(t.oid, repeat('0', 40)) AS old_oid, r.oid AS new_oid, 'refs/heads/user-1' || substr(r.name, 17) AS ref
FROM r LEFT JOIN r t ON t.name = 'refs/heads/user-1' || substr(r.name, 17) WHERE r.name LIKE 'refs/heads/user-%'""")
def push_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _live(spark, sf_dir)
    return pushing.commands(pushing.plan_refs(r, r, [names.RefSpec.parse("refs/heads/user-*:refs/heads/user-1*")]))


@_query(_IMPORT + """
SELECT local_ref AS ref, CASE WHEN NOT here THEN CASE WHEN back THEN 'it isn''t there' END WHEN NOT back THEN 'it is there already' WHEN first <> last THEN 'it has another value' END AS error FROM j WHERE there""")
def receive_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remote's tips sent as new branches, and every ninth as a move from its first commit."""
    remote, local, objects, _ = _import_inputs(spark, sf_dir)
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    sent = remote.select(F.when(number % 9 == 0, F.col("oid")).otherwise(F.lit("0" * 40)).alias("old_oid"), F.col("oid").alias("new_oid"), F.col("name").alias("ref"))
    return pushing.check_updates(sent, local, objects).select("ref", "error")


@_query("SELECT oid FROM (SELECT o_orderkey AS oid FROM orders WHERE o_orderkey % 9 = 0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0)")
def push_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.commits(spark, sf_dir).select("oid")
    return refs.push_boundaries(c.where("oid % 9 = 0"), c.where("oid % 6 = 0"))


@_query("""
SELECT o_orderkey, lpad(cast(o_custkey AS VARCHAR), 40, '0') AS tree, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS parents, 'Clerk <c@x>' AS author, cast(epoch(o_orderdate) AS BIGINT) AS ts, o_orderpriority AS message FROM orders""")
def commit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits written as text expressions and parsed back."""
    o = X.table(spark, sf_dir, "orders")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 40, "0")
    who = F.concat(F.lit("Clerk <c@x> "), F.unix_timestamp("o_orderdate").cast("string"), F.lit(" +0000"))
    parent = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("parent "), pad("o_orderkey"), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("tree "), pad("o_custkey"), F.lit("\n"), parent, F.lit("author "), who, F.lit("\ncommitter "), who, F.lit("\n\n"), "o_orderpriority", F.lit("\n"))
    c = o.select("o_orderkey", codecs.parse_commit(body.cast("binary")).alias("c"))
    return c.select("o_orderkey", "c.tree", F.size("c.parents").alias("parents"), F.concat("c.author.name", F.lit(" <"), "c.author.email", F.lit(">")).alias("author"), F.col("c.committer.timestamp").alias("ts"), "c.message")


@_query(f"""
WITH r AS ({_LIVE}), s AS (SELECT count(*) FILTER (name LIKE '%1') AS a, count(*) FILTER (name LIKE '%2') AS b FROM r)
SELECT 'refs/heads/' AS prefix, a + b AS selected FROM s""")
def import_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = importing.View(_live(spark, sf_dir))
    both = view.select("*1").union(view.select("*2")).exclude("refs/tags/*")
    return both.refs.agg(F.count("*").alias("selected")).select(F.lit(refs.common_prefix(both.refs)).alias("prefix"), "selected")
