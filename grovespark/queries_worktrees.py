"""Registered queries over worktrees, patches and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark import fixtures as X
from grovespark.errors import NotDirectoryError, NotFileError, NotSymlinkError, PathExistsError, PathNotFoundError
from grovespark.functions import names, nodes
from grovespark.functions.oid import oid
from grovespark.operators import graph, packs, trees, worktree
from grovespark.plans import importing, pushing
from grovespark.queries import _A, _B, _DAG, _IMPORT, _LIVE, _OPS, _import_inputs, _live, _oid, _query
from grovespark.schema import EMPTY_TREE
from grovespark.storage import Scratch, numbered


def _tree(spark: SparkSession, sf_dir: str) -> worktree.Worktree:
    return worktree.Worktree(X.snapshot_a(spark, sf_dir))


_ID = "repeat('a', 40)"
_NEW = "a" * 40


# Single operations


@_query(f"SELECT path, mode, oid FROM ({_A}) UNION ALL SELECT 'src1/new.txt', '100755', {_ID}")
def worktree_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file is written, then written again with another mode."""
    return _tree(spark, sf_dir).write("src1/new.txt", _NEW[::-1]).write("src1/new.txt", _NEW, "100755").current


@_query(f"SELECT path, mode, oid FROM ({_A}) UNION ALL SELECT 'made/deep/er', '040000', '{EMPTY_TREE}' UNION ALL SELECT 'made/file', '120000', {_ID}")
def worktree_mkdir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories are made with those above, again without effect, and a link is written into one."""
    return _tree(spark, sf_dir).mkdir("made/deep/er", recursive=True).mkdir("made/deep", recursive=True).write("made/file", _NEW, "120000").current


@_query(f"SELECT path, mode, oid FROM ({_A}) WHERE path NOT LIKE 'src1/%'")
def worktree_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory goes; what was deleted, made again and deleted stays so."""
    return _tree(spark, sf_dir).delete("src1").delete("nothing", force=True).mkdir("src1").delete("src1").current


@_query(f"SELECT CASE WHEN path LIKE 'src1/%' THEN 'moved/to' || substr(path, 5) ELSE path END AS path, mode, oid FROM ({_A})")
def worktree_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).move("src1", "moved/to").current


@_query(f"SELECT path, mode, oid FROM ({_A}) UNION ALL SELECT 'copy' || substr(path, 5), mode, oid FROM ({_A}) WHERE path LIKE 'src2/%'")
def worktree_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).copy("src2", "copy").current


@_query(f"SELECT CASE WHEN path LIKE 'src1/%' THEN 'moved/' || substr(path, 6) ELSE path END AS path, mode, oid FROM ({_A}) UNION ALL SELECT 'copy/' || substr(path, 6), mode, oid FROM ({_A}) WHERE path LIKE 'src2/%'")
def worktree_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves and copies of many prefixes at once."""
    moves = spark.createDataFrame([("move", "src1", "moved"), ("copy", "src2", "copy")], "op string, from_path string, to_path string")
    return worktree.rewrite(X.snapshot_a(spark, sf_dir), moves)


@_query(f"""
SELECT CASE WHEN path LIKE 'src1/%' THEN 'moved/' || substr(path, 6) ELSE path END AS path, mode, oid FROM ({_A}) WHERE path NOT LIKE 'src2/%'
UNION ALL SELECT 'moved/new.txt', '100644', {_ID} UNION ALL SELECT 'dir', '040000', '{EMPTY_TREE}'""")
def worktree_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of operations: a write, a move over it, a directory, a delete."""
    ops = [(1, "write", "src1/new.txt", None, "100644", _NEW), (2, "move", "src1", "moved", None, None), (3, "mkdir", "dir", None, None, None), (4, "delete", "src2", None, None, None)]
    return _tree(spark, sf_dir).apply(spark.createDataFrame(ops, "seq bigint, op string, path string, to_path string, mode string, oid string")).current


@_query(f"SELECT path, 'remove' AS change, oid AS old_oid, cast(NULL AS VARCHAR) AS new_oid FROM ({_A}) WHERE path LIKE 'src1/%' UNION ALL SELECT 'src2/new.txt', 'create', NULL, {_ID}")
def worktree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes against the base; a path that was written and deleted is none."""
    tree = _tree(spark, sf_dir).delete("src1").write("src2/new.txt", _NEW).write("src2/gone.txt", _NEW).delete("src2/gone.txt")
    return tree.diff().select("path", "change", "old_oid", "new_oid")


@_query(f"WITH p AS (SELECT min(path) AS path FROM ({_A})) SELECT path, 'update' AS change, oid AS old_oid, {_ID} AS new_oid FROM ({_A}) WHERE path = (SELECT path FROM p)")
def worktree_diff_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path's change."""
    base = X.snapshot_a(spark, sf_dir)
    first = base.agg(F.min("path")).first()[0]
    return worktree.Worktree(base).write(first, _NEW).diff_path(first).select("path", "change", "old_oid", "new_oid")


@_query(f"SELECT path, mode, oid FROM ({_B})")
def worktree_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).delete("src1").reset(X.snapshot_b(spark, sf_dir)).current


@_query("SELECT * FROM (VALUES ('', 'tree'), ('src1', 'tree'), ('link', 'symlink'), ('none', NULL)) t(path, kind)")
def worktree_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at a path: the root, a directory, a link, nothing."""
    tree = _tree(spark, sf_dir).write("link", _NEW, "120000")
    return spark.createDataFrame([(p, (tree.stat(p) or {}).get("kind")) for p in ("", "src1", "link", "none")], "path string, kind string")


@_query("SELECT * FROM (VALUES ('children of a file', 'NotDirectoryError'), ('copy onto src2', 'PathExistsError'), ('delete nothing', 'PathNotFoundError'), ('mkdir src1', 'PathExistsError'), ('move into itself', 'PathExistsError'), ('move nothing', 'PathNotFoundError'), ('read a directory', 'NotFileError'), ('read a link that is none', 'NotSymlinkError'), ('write over a directory', 'NotFileError')) t(what, error)")
def worktree_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be done names why."""
    base = X.snapshot_a(spark, sf_dir)
    tree, first = worktree.Worktree(base), base.agg(F.min("path")).first()[0]
    objects = X.blobs(spark, sf_dir).select("oid", F.col("text").cast("binary").alias("content"))
    tries = {
        "children of a file": lambda: tree.children(first), "copy onto src2": lambda: tree.copy("src1", "src2"), "delete nothing": lambda: tree.delete("none"), "mkdir src1": lambda: tree.mkdir("src1"),
        "move into itself": lambda: tree.move("src1", "src1/below"), "move nothing": lambda: tree.move("none", "x"), "read a directory": lambda: tree.read("src1", objects), "read a link that is none": lambda: tree.read(first, objects, "symlink"),
        "write over a directory": lambda: tree.write("src1", _NEW),
    }
    rows = []
    for what, attempt in tries.items():
        try:
            attempt()
            rows.append((what, None))
        except (NotDirectoryError, NotFileError, NotSymlinkError, PathExistsError, PathNotFoundError) as error:
            rows.append((what, type(error).__name__))
    return spark.createDataFrame(rows, "what string, error string")


@_query(f"WITH p AS (SELECT min(path) AS path FROM ({_A})) SELECT sha256(text) AS file, sha256('target') AS link FROM documents WHERE concat(source, '/', lang, '/', doc_id, '.txt') = (SELECT path FROM p)")
def worktree_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of the base, and a link that was written here."""
    import hashlib

    base = X.snapshot_a(spark, sf_dir)
    first = base.agg(F.min("path")).first()[0]
    content = spark.createDataFrame([(_NEW, b"target")], "oid string, content binary")
    tree = worktree.Worktree(base, contents=content).write("link", _NEW, "120000")
    tree = worktree.Worktree(base, tree.current, content)
    objects = X.blobs(spark, sf_dir).select("oid", F.col("text").cast("binary").alias("content"))
    return spark.createDataFrame([(hashlib.sha256(tree.read(first, objects)).hexdigest(), hashlib.sha256(tree.read("link", objects, "symlink")).hexdigest())], "file string, link string")


@_query(f"WITH a AS ({_A}) SELECT count(*) AS files, true AS same FROM a")
def worktree_write_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worktree's tree is that of its snapshot: written, flattened and compared; unchanged by what is undone."""
    tree = _tree(spark, sf_dir)
    base_root, made = tree.write_tree()
    root, _ = tree.write("src1/new.txt", _NEW).delete("src1/new.txt").write_tree()
    return made.where("path = ''").crossJoin(tree.current.agg(F.count("*").alias("files"))).select("files", (F.col("oid") == F.lit(root)).alias("same")).where(F.lit(root == base_root))


@_query(f"SELECT path, 'remove' AS change FROM ({_A}) WHERE path LIKE 'src1/%' UNION ALL SELECT 'src2/new.txt', 'create' UNION ALL SELECT 'kept/x', 'create'")
def worktree_change_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes kept from state to state: a write and a delete refresh one path, a move compares everything."""
    tree = _tree(spark, sf_dir)
    index = worktree.ChangeIndex(tree)
    steps = [("write", "src2/new.txt", lambda t: t.write("src2/new.txt", _NEW)), ("write", "src2/gone", lambda t: t.write("src2/gone", _NEW)), ("delete", "src2/gone", lambda t: t.delete("src2/gone")), ("mkdir", "kept", lambda t: t.mkdir("kept")), ("write", "kept/x", lambda t: t.write("kept/x", _NEW)), ("delete", "src1", lambda t: t.delete("src1"))]
    plans = []
    for op, path, step in steps:
        plans.append(index.plan(op, path))
        index = index.after(op, path, step(index.tree))
    assert plans == ["path"] * 5 + ["all"]
    return index.changes.select("path", "change")


@_query("SELECT doc_id, 'origin-path:' || concat(source, '/', lang, '/', doc_id, '.txt') AS id, k AS kind, CASE WHEN k <> 'none' THEN sha1(text) END AS oid, CASE WHEN k = 'repo-blob' THEN '100644' END AS mode, CASE doc_id % 5 WHEN 3 THEN 'an unknown kind' WHEN 4 THEN 'no id' END AS error FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'repo-tree' WHEN 2 THEN 'repo-blob' END AS k FROM documents)")
def node_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of nodes from columns, through JSON and back; what is none says why."""
    d = X.table(spark, sf_dir, "documents").withColumn("path", F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt")))
    five = F.col("doc_id") % 5
    kind = F.when(five == 0, "none").when(five == 1, "repo-tree").when(five == 3, "other").otherwise("repo-blob")
    oid_ = F.when(five != 4, F.sha1(F.col("text").cast("binary")))
    made = d.select("doc_id", nodes.path_node_id(F.col("path")).alias("id"), nodes.origin(kind, oid_, F.lit("100644")).alias("o"), nodes.origin_error(kind, oid_, F.lit("100644")).alias("error"))
    back = made.withColumn("o", F.when(F.col("o").isNotNull(), nodes.origin_of_json(nodes.origin_to_json(F.col("o")))))
    return back.select("doc_id", "id", "o.kind", "o.oid", "o.mode", "error")


@_query("SELECT source, count(DISTINCT lang) AS added, cast(count(DISTINCT doc_id) AS INTEGER) AS deleted, true AS dirty, false AS clean, true AS content FROM documents GROUP BY source")
def node_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays of directories as JSON and back, and which nodes they make dirty."""
    d = X.table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"), F.collect_set(F.col("doc_id").cast("string")).alias("gone"))
    added = F.map_from_entries(F.transform("langs", lambda x: F.struct(x, nodes.new_node_id(x, F.lit(1)))))
    d = d.withColumn("o", nodes.overlay_of_json(nodes.overlay_to_json(added, F.col("gone")))).withColumn("none", nodes.overlay_of_json(F.lit(None).cast("string")))
    return d.select("source", F.size(F.map_keys("o.added")).cast("bigint").alias("added"), F.size("o.deleted").alias("deleted"), nodes.is_dirty(F.lit("tree"), F.col("o.added"), F.col("o.deleted"), F.lit(None)).alias("dirty"), nodes.is_dirty(F.lit("tree"), F.col("none.added"), F.col("none.deleted"), F.lit(None)).alias("clean"), nodes.is_dirty(F.lit("blob"), F.col("none.added"), F.col("none.deleted"), F.lit("")).alias("content"))


# Patches


_RENAMED = f"SELECT CASE WHEN path LIKE 'src1/%' THEN 'kept/' || substr(path, 6) ELSE path END AS path, mode, oid FROM ({_A})"


@_query(f"SELECT path, mode, oid FROM ({_RENAMED}) WHERE path NOT LIKE 'src2/%' UNION ALL SELECT 'src2', '100644', {_ID}")
def patch_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory is renamed twice, one onto itself, another is replaced by a file."""
    ops = [(1, "rename", None, None, None, "src1", "x"), (2, "rename", None, None, None, "x", "kept"), (3, "rename", None, None, None, "src3", "src3"), (4, "upsert", "src2", "100644", _NEW, None, None)]
    return trees.patch(X.snapshot_a(spark, sf_dir), spark.createDataFrame(ops, "seq bigint, op string, path string, mode string, oid string, from_path string, to_path string")).leaves


@_query("SELECT * FROM (VALUES (1, 'nowhere', 'nothing there to rename'), (2, 'none', 'nothing there to delete'), (3, 'a//b', 'an empty segment')) t(seq, path, error)")
def patch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that can't be done are listed, not done."""
    ops = [(1, "rename", None, None, None, "nowhere", "x"), (2, "delete", "none", None, None, None, None), (3, "upsert", "a//b", "100644", _NEW, None, None)]
    return trees.patch(X.snapshot_a(spark, sf_dir), spark.createDataFrame(ops, "seq int, op string, path string, mode string, oid string, from_path string, to_path string")).errors


@_query(f"WITH a AS ({_A}), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM ({_OPS})) WHERE k = 1 AND op = 'upsert') SELECT count(*) AS paths, true AS same FROM (SELECT path FROM a UNION SELECT path FROM p)")
def patch_tree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of a patched tree is that of the patched snapshot built anew."""
    base = X.snapshot_a(spark, sf_dir)
    none = F.lit(None).cast("string")
    ops = X.overlay_ops(spark, sf_dir).where("op = 'upsert'").withColumns({"from_path": none, "to_path": none})
    root, _ = trees.patch_tree(base, ops)
    after = Scratch(spark).keep(worktree.overlay(base, ops))
    return after.agg(F.count("*").alias("paths"), F.lit(root == trees.root(trees.build(after))).alias("same"))


@_query(f"SELECT path, row_number() OVER (ORDER BY path) - 1 AS position FROM ({_A})")
def paths_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths bytewise, numbered as they come."""
    return numbered(trees.ordered(X.snapshot_a(spark, sf_dir).select("path")), [F.col("path")])


@_query(f"SELECT path FROM ({_A}) UNION SELECT source FROM documents UNION SELECT source || '/' || lang FROM documents")
def flattened_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and directories of trees that were built."""
    made = Scratch(spark).keep(trees.build(X.snapshot_a(spark, sf_dir)))
    from grovespark.functions.codecs import parse_tree

    parsed = made.select(F.col("oid").alias("tree_oid"), F.explode(parse_tree("content")).alias("e")).select("tree_oid", "e.mode", "e.name", "e.oid").distinct()
    return trees.flatten(parsed, trees.root(made), directories=True).select("path")


# Graphs


@_query(f"WITH RECURSIVE {_DAG}, reach(oid) AS (SELECT oid FROM o WHERE rn = 1 UNION SELECT e.child FROM reach JOIN e ON e.parent = reach.oid) SELECT count(*) AS reached, 0 AS missing FROM o")
def reachable_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit reaches itself; ids that aren't there are named and forgiven below a boundary."""
    edges, commits = X.commit_edges(spark, sf_dir), X.commits(spark, sf_dir).select("oid")
    gone = edges.withColumn("parent", F.when(F.col("child") % 2 == 0, -F.col("child")).otherwise(F.col("parent")))
    reached = graph.reachable(edges, commits, commits)
    left = graph.missing(gone, commits, graph.closure(gone, commits), commits)
    return reached.agg(F.count("*").alias("reached")).crossJoin(left.agg(F.count("*").cast("int").alias("missing")))


@_query("SELECT o_custkey AS tree, 'tree' AS kind, count(*) AS edges FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 'entry', 2 FROM customer")
def object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of their customer's tree, which holds two files and a submodule that is no object here."""
    commits = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("tree"), F.array().cast("array<bigint>").alias("parents"))
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tree_oid"), F.explode(F.array(F.lit("100644"), F.lit("100755"), F.lit("160000"))).alias("mode"), F.col("c_nationkey").cast("bigint").alias("oid"))
    edges = graph.object_edges(commits, c)
    return edges.groupBy(F.when(F.col("kind") == "tree", F.col("parent")).otherwise(F.col("child")).alias("tree"), "kind").agg(F.count("*").alias("edges"))


@_query(f"SELECT oid FROM ({_LIVE}) WHERE name LIKE '%1'")
def gc_root_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HEAD, branches and tags are roots; other names aren't."""
    r = _live(spark, sf_dir)
    return graph.gc_roots(r.select(F.when(F.col("name").endswith("1"), F.col("name")).otherwise(F.concat(F.lit("refs/x/"), "name")).alias("name"), "oid"))


@_query(f"SELECT type, count(*) AS objects FROM (SELECT DISTINCT {_oid('text')} AS oid, 'blob' AS type FROM documents UNION ALL SELECT DISTINCT {_oid('html', 'tree')}, 'tree' FROM pages) GROUP BY type")
def type_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of each type as bitmaps, counted."""
    html = X.table(spark, sf_dir, "pages").select(oid(F.col("html"), "tree").alias("oid"), F.lit("tree").alias("type")).distinct()
    bits = graph.type_bitmaps(X.blobs(spark, sf_dir).select("oid", F.lit("blob").alias("type")).distinct().unionByName(html))
    return bits.groupBy("type").agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("objects"))


@_query(f"WITH RECURSIVE {_DAG}, ends AS (SELECT cust, min(oid) AS lo, max(oid) AS hi FROM o GROUP BY cust) SELECT layer, packs, objects, first_pack, cast(sum(objects) OVER (ORDER BY layer) - objects AS BIGINT) AS first_object FROM (SELECT n_regionkey AS layer, count(*) AS objects, 1 AS packs, n_regionkey AS first_pack FROM nation GROUP BY n_regionkey)")
def midx_layer_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the layers below hold, with a layer for each region."""
    n = X.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("layer")).agg(F.lit(1).alias("packs"), F.count("*").alias("objects"))
    return packs.layer_offsets(n).select("layer", "packs", "objects", F.col("first_pack").cast("int").alias("first_pack"), "first_object")


# Plans


@_query(_IMPORT + "SELECT local_ref AS name, CASE WHEN back THEN first ELSE last END AS target FROM j WHERE there AND NOT here")
def import_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import that may only make names writes."""
    remote, local, objects, edges = _import_inputs(spark, sf_dir)
    updates = remote.join(local, "name", "left").where("target IS NULL").select(F.col("name").alias("local_ref"), F.col("oid").alias("remote_oid"), F.col("target").alias("current_oid"), F.lit(False).alias("force"))
    after = importing.apply_updates(updates, local, objects, edges)[0]
    return after.join(local.select("name"), "name", "left_anti").select("name", "target")


@_query(f"SELECT name AS ref, repeat('0', 40) AS old_oid, oid AS new_oid, true AS ok FROM ({_LIVE})")
def push_report_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands with the server's statuses."""
    r = _live(spark, sf_dir)
    sent = r.select(F.lit("0" * 40).alias("old_oid"), F.col("oid").alias("new_oid"), F.col("name").alias("ref"))
    return pushing.report(sent, r.select(F.col("name").alias("ref"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("message"))).select("ref", "old_oid", "new_oid", "ok")


@_query(_IMPORT + "SELECT local_ref AS name, CASE WHEN NOT here THEN CASE WHEN back THEN first ELSE last END WHEN back THEN last ELSE first END AS target FROM j WHERE here OR (there AND NOT back)")
def receive_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a server after the commands that hold."""
    remote, local, objects, _ = _import_inputs(spark, sf_dir)
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    sent = remote.select(F.when(number % 9 == 0, F.col("oid")).otherwise(F.lit("0" * 40)).alias("old_oid"), F.col("oid").alias("new_oid"), F.col("name").alias("ref"))
    checked = Scratch(spark).keep(pushing.check_updates(sent, local, objects))
    return pushing.apply_commands(checked, local)


@_query(f"WITH r AS ({_LIVE}) SELECT name AS local_ref, 'refs/copy/' || substr(name, 12) AS remote_ref, oid AS local_oid FROM r")
def push_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All branches under another space: the specs as a table joined with the references."""
    r = _live(spark, sf_dir)
    return pushing.plan_refs(r, r.limit(0), [names.RefSpec.parse("refs/heads/*:refs/copy/*")]).select("local_ref", "remote_ref", "local_oid")
