"""Registered queries over files: what writers put into the shared folder, read back by the data sources."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark import fixtures as X
from grovespark.catalog import Repository
from grovespark.functions import codecs
from grovespark.functions.oid import hash_data, oid
from grovespark.operators import graph, packs, refs, worktree
from grovespark.operators.worktree_store import WorktreeStore
from grovespark.plans import protocol, services
from grovespark.queries import _A, _DAG, _LIVE, _live, _oid, _query
from grovespark.sources import datasource, packfile, writers
from grovespark.storage import Scratch, numbered, shared_folder


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, and the sources to read it with."""
    datasource.register(spark)
    return f"{shared_folder(spark)}/grovespark/files-{uuid.uuid4().hex}"


def _objects(spark: SparkSession, sf_dir: str, name: str = "documents", text: str = "text") -> DataFrame:
    rows = X.table(spark, sf_dir, name)
    return rows.withColumn("content", F.col(text).cast("binary")).withColumn("type", F.lit("blob"))


_SHA = "sha256(text) AS content_sha256"
_BLOBS = f"SELECT DISTINCT {_oid('text')} AS oid, 'blob' AS type, octet_length(encode(text)) AS size, {_SHA} FROM documents"


# Loose objects


def _loose(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark)
    writers.write_loose(_objects(spark, sf_dir), f"{folder}/objects").count()
    return folder


@_query(_BLOBS)
def loose_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a loose object, listed and read back."""
    rows = spark.read.format("repo_loose").load(_loose(spark, sf_dir))
    return rows.select("oid", "type", "size", F.sha2("content", 256).alias("content_sha256"))


@_query(f"SELECT oid FROM ({_BLOBS}) WHERE oid LIKE 'a%'")
def loose_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids under a prefix: the filter is pushed down and chooses folders."""
    return spark.read.format("repo_loose").load(_loose(spark, sf_dir)).where(F.col("oid").startswith("a")).select("oid")


@_query(f"SELECT oid FROM (SELECT {_oid('text')} AS oid FROM documents) GROUP BY oid HAVING count(*) = 1")
def loose_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that several documents have are deleted again."""
    folder = _loose(spark, sf_dir)
    many = X.blobs(spark, sf_dir).groupBy("oid").count().where("count > 1")
    writers.delete_loose(spark, f"{folder}/objects", many)
    return spark.read.format("repo_loose").load(folder).select("oid")


# Packs and their indexes


def _packs(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark)
    rows = _objects(spark, sf_dir).select((F.col("doc_id") % 3).alias("pack"), F.col("doc_id").alias("seq"), "type", "content")
    writers.write_packs(rows, folder).count()
    return folder


_PACKED = f"SELECT DISTINCT doc_id % 3 AS pack, {_oid('text')} AS oid, 'blob' AS type, octet_length(encode(text)) AS size, {_SHA} FROM documents"


@_query(f"SELECT oid, type, size, content_sha256, count(*) AS packs FROM ({_PACKED}) GROUP BY ALL")
def pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three packs written and read, their checksums and every object's size checked."""
    rows = spark.read.format("repo_pack").load(_packs(spark, sf_dir)).where("error IS NULL")
    return rows.groupBy("oid", "type", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("content_sha256")).agg(F.count("*").alias("packs"))


@_query(f"SELECT oid, count(*) AS packs, count(*) AS found FROM ({_PACKED}) GROUP BY oid")
def pack_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of the packs; found: entries whose offset is where the pack has the object."""
    folder = _packs(spark, sf_dir)
    index = spark.read.format("repo_index").load(folder)
    there = spark.read.format("repo_pack").load(folder).select("pack", "oid", F.col("offset").alias("at"))
    return index.join(there, ["pack", "oid"], "left").groupBy("oid").agg(F.count("*").alias("packs"), F.count(F.when(F.col("offset") == F.col("at"), 1)).alias("found"))


@_query(f"SELECT pack, count(*) AS objects FROM ({_PACKED}) GROUP BY pack")
def pack_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each pack as its index counts them."""
    folder = _folder(spark)
    rows = _objects(spark, sf_dir).select((F.col("doc_id") % 3).alias("pack"), F.col("doc_id").alias("seq"), "type", "content")
    names = Scratch(spark).keep(writers.write_packs(rows, folder))
    found = packs.pack_summary(spark.read.format("repo_index").load(folder))
    return names.select("pack", F.col("name")).join(found.withColumnRenamed("pack", "name"), "name").select(F.col("pack").cast("bigint").alias("pack"), "objects")


@_query(f"SELECT count(DISTINCT oid) AS objects FROM ({_PACKED})")
def pack_object_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.object_count(spark.read.format("repo_index").load(_packs(spark, sf_dir)))


@_query(f"SELECT DISTINCT oid, true AS found FROM ({_PACKED})")
def midx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index over the three packs; found: whether its place is one that a pack's own index has."""
    folder = _packs(spark, sf_dir)
    index = Scratch(spark).keep(spark.read.format("repo_index").load(folder))
    writers.write_multi_index(index, f"{folder}/multi-pack-index")
    rows = spark.read.format("repo_midx").load(folder)
    own = index.select("pack", "oid", F.col("offset").alias("at"))
    return rows.join(own, ["pack", "oid"], "left").select("oid", F.coalesce(F.col("offset") == F.col("at"), F.lit(False)).alias("found"))


@_query(f"""
WITH d AS (SELECT DISTINCT {_oid('text')} AS oid FROM documents), b AS (SELECT DISTINCT {_oid('text')} AS oid FROM benchmark)
SELECT oid, 0 AS layer FROM d UNION ALL SELECT oid, 1 FROM b WHERE oid NOT IN (SELECT oid FROM d)""")
def midx_chain_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second layer holds only what the first hasn't; the chain is read back and looked up from the top."""
    folder = _packs(spark, sf_dir)
    writers.write_incremental_index(spark.read.format("repo_index").load(folder).select("pack", "oid", "offset"), folder)
    more = _objects(spark, sf_dir, "benchmark").select(F.lit(9).alias("pack"), F.col("item_id").alias("seq"), "type", "content")
    writers.write_packs(more, folder).count()
    writers.write_incremental_index(spark.read.format("repo_index").load(folder).select("pack", "oid", "offset"), folder)
    return packs.newest_layer(writers.chain_index(spark, folder)).select("oid", "layer")


@_query(f"""
SELECT doc_id, 0 AS level, {_oid('text')} AS oid FROM documents UNION ALL SELECT doc_id, 1, {_oid("concat(text, '+')")} FROM documents UNION ALL SELECT doc_id, 2, {_oid("concat('-', text, '+')")} FROM documents""")
def delta_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole objects, deltas on them by place, and deltas on those by id."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("a"), F.concat("text", F.lit("+")).cast("binary").alias("b"), F.concat(F.lit("-"), "text", F.lit("+")).cast("binary").alias("c"))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda level, kind, content, place, base: d.select(F.lit(0).alias("pack"), (F.col("doc_id") * 4 + level).alias("offset"), F.lit(kind).alias("type"), place.alias("base_offset"), base.alias("base_oid"), content.alias("content"))
    whole = row(0, "blob", F.col("a"), none("bigint"), none("string"))
    near = row(1, "ofs_delta", codecs.delta_between("a", "b"), F.col("doc_id") * 4, none("string"))
    far = row(2, "ref_delta", codecs.delta_between("b", "c"), none("bigint"), oid(F.col("b")))
    found = packs.resolve_deltas(whole.unionByName(near).unionByName(far))
    return found.select(F.floor(F.col("offset") / 4).alias("doc_id"), (F.col("offset") % 4).cast("int").alias("level"), "oid")


@_query(f"SELECT DISTINCT {_oid('text')} AS oid, {_SHA} FROM documents")
def pack_parse_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs' bytes through the table function parse_pack."""
    folder = _packs(spark, sf_dir)
    codecs.register(spark)
    files = spark.createDataFrame([(p,) for p, _ in datasource.list_files(folder, ".pack")], "path string")

    def load(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([datasource.read_file(p) for p in batch.column(0).to_pylist()], pa.binary())], ["data"])

    files.repartition("path").mapInArrow(load, "data binary").createOrReplaceTempView("pack_bytes")
    return spark.sql("SELECT DISTINCT p.oid, sha2(p.content, 256) AS content_sha256 FROM pack_bytes, LATERAL parse_pack(data) p")


# Bitmaps


@_query("SELECT o_custkey AS cust, count(*) AS n, cast(sum(o_orderkey) AS BIGINT) AS total, true AS same FROM orders GROUP BY o_custkey")
def ewah_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order keys as a compressed bitmap and back."""
    rows = X.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.collect_list("o_orderkey").alias("keys"))

    def both(batches):
        for batch in batches:
            found = []
            for keys in batch.column("keys").to_pylist():
                data = packfile.encode_ewah(set(keys), max(keys) + 1)
                back, size = packfile.decode_ewah(data)
                found.append((len(back), sum(back), size == len(data) and back == set(keys)))
            columns = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("cust"), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)]], ["cust", "n", "total", "same"])

    return rows.mapInArrow(both, "cust bigint, n bigint, total bigint, same boolean")


_HEADS = f"""
WITH RECURSIVE {_DAG}, heads AS (SELECT arg_max(oid, rn) AS oid FROM o GROUP BY cust), w(root, oid) AS (SELECT oid, oid FROM heads UNION SELECT w.root, e.parent FROM w JOIN e ON e.child = w.oid)"""


def _branch_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.commit_table(spark, sf_dir).groupBy("cust").agg(F.max_by("oid", "rn").alias("oid")).select("oid")


@_query(_HEADS + " SELECT root, oid FROM w")
def branch_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's last commit reaches: all roots in one loop."""
    return graph.all_closures(X.commit_edges(spark, sf_dir), _branch_heads(spark, sf_dir))


@_query(_HEADS + ", p AS (SELECT oid, row_number() OVER (ORDER BY lpad(cast(oid AS VARCHAR), 40, '0')) - 1 AS position FROM o) SELECT r.position AS commit, count(*) AS reached, cast(sum(p.position) AS BIGINT) AS total FROM w JOIN p ON p.oid = w.oid JOIN p r ON r.oid = w.root GROUP BY r.position")
def reachability_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch heads' closures as one bitmap file, each entry stored as its difference from the one before, and read back."""
    folder = _folder(spark)
    text = lambda c: F.lpad(F.col(c).cast("string"), 40, "0")
    place = Scratch(spark).keep(packs.positions(X.commits(spark, sf_dir).select(text("oid").alias("oid"))))
    reach = graph.all_closures(X.commit_edges(spark, sf_dir), _branch_heads(spark, sf_dir)).select(text("root").alias("root"), text("oid").alias("oid"))
    rows = reach.join(place, "oid").select("root", F.col("position").alias("at")).join(place.select(F.col("oid").alias("root"), "position"), "root")
    entries = rows.groupBy("position").agg(F.collect_list("at").alias("bits"))
    total = place.count()

    def write(batches):
        # a bitmap file is one sequence: one task's work, entry by entry
        found = {p: set(bits) for batch in batches for p, bits in zip(batch.column("position").to_pylist(), batch.column("bits").to_pylist(), strict=True)}
        writers.put_file(f"{folder}/objects.bitmap", packfile.write_bitmap({"commit": set(range(total))}, dict(sorted(found.items())), total, "0" * 40, xor=True))
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/objects.bitmap"]})

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                _, back, _ = packfile.read_bitmap(datasource.read_file(path))
                yield pa.RecordBatch.from_pydict({"commit": list(back), "reached": [len(b) for b in back.values()], "total": [sum(b) for b in back.values()]})

    made = Scratch(spark).keep(entries.coalesce(1).mapInArrow(write, "path string"))
    return made.mapInArrow(read, "commit bigint, reached bigint, total bigint")


@_query(f"""
WITH RECURSIVE {_DAG}, heads AS (SELECT arg_max(oid, rn) AS oid FROM o GROUP BY cust), r(oid) AS (SELECT oid FROM heads UNION SELECT e.parent FROM r JOIN e ON e.child = r.oid)
SELECT 'commit' AS type, count(*) AS objects FROM r""")
def bitmap_assisted_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all branch heads reach, from materialised closures of half of them and a walk for the rest."""
    edges, heads = X.commit_edges(spark, sf_dir), Scratch(spark).keep(_branch_heads(spark, sf_dir))
    known = Scratch(spark).keep(graph.all_closures(edges, heads.where("oid % 2 = 0")))
    return graph.closure_with(edges, heads, known).agg(F.count("*").alias("objects")).select(F.lit("commit").alias("type"), "objects")


# References


@_query(f"WITH r AS ({_LIVE}) SELECT name, CASE WHEN name LIKE '%1' THEN oid ELSE sha1(name) END AS target FROM r WHERE name <> (SELECT min(name) FROM r WHERE name NOT LIKE '%1')")
def ref_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed references under loose ones of the same names; one packed name is deleted again."""
    folder = _folder(spark)
    live = [(r["name"], r["oid"]) for r in _live(spark, sf_dir).orderBy("name").collect()]  # a repository's references are its users' names
    packed = spark.createDataFrame(live, "name string, oid string").select("name", hash_data(F.col("name")).alias("oid")).orderBy("name").collect()
    writers.put_file(f"{folder}/packed-refs", ("# pack-refs with: peeled\n" + "".join(f"{r['oid']} {r['name']}\n" for r in packed)).encode())
    writers.write_refs(folder, [(n, o) for n, o in live if n.endswith("1")])
    writers.delete_packed_ref(folder, min(n for n, _ in live if not n.endswith("1")))
    return spark.read.format("repo_refs").load(folder).select("name", "target")


@_query("SELECT lpad(cast(o_orderkey AS VARCHAR), 40, '0') AS oid FROM orders WHERE o_orderstatus = 'F'")
def shallow_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shallow list as a file, written sorted and read back."""
    folder = _folder(spark)
    rows = X.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lpad(F.col("o_orderkey").cast("string"), 40, "0").alias("oid"))
    writers.write_shallow(folder, rows)
    return spark.read.text(f"{folder}/shallow").select(F.col("value").alias("oid"))


def _repository(spark: SparkSession, sf_dir: str) -> Repository:
    """Documents and their trees in one commit on main."""
    objects = Repository.create(spark)
    made = objects.add_table(_objects(spark, sf_dir).select(oid(F.col("content")).alias("oid"), "type", F.octet_length("content").cast("bigint").alias("size"), "content").dropDuplicates(["oid"])).settled()
    made, root = made.write_tree(X.snapshot_a(spark, sf_dir))
    made, tip = made.create_commit(root, [], {"name": "A", "email": "a@x", "timestamp": 1000, "timezone": "+0000"}, "first")
    return made.update_refs({"refs/heads/main": tip}).settled()


@_query(f"SELECT type, count(*) AS objects FROM (SELECT DISTINCT {_oid('text')} AS oid, 'blob' AS type FROM documents) GROUP BY type UNION ALL SELECT 'commit', 1 UNION ALL SELECT 'tree', (SELECT count(DISTINCT source) + count(DISTINCT source || lang) + 1 FROM documents)")
def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository written as files (objects, references, shallow list) and imported again."""
    folder = _folder(spark)
    _repository(spark, sf_dir).export_files(folder)
    back = Repository.import_files(spark, folder)
    return back.objects.groupBy("type").agg(F.count("*").alias("objects"))


@_query(_A)
def repository_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved as tables, opened again, and the snapshot of HEAD read through commit and trees."""
    folder = _folder(spark)
    _repository(spark, sf_dir).save(folder)
    back = Repository.open(spark, folder)
    return back.snapshot(back.tree_of("HEAD")).where("kind <> 'tree'").select("path", "mode", "oid")


@_query(f"WITH a AS ({_A}) SELECT path, 'blob' AS kind, mode, oid FROM a UNION ALL SELECT DISTINCT d, 'tree', '040000', NULL FROM (SELECT source AS d FROM documents UNION SELECT source || '/' || lang FROM documents)")
def tree_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit's tree flattened, directories among the rows (their ids left out)."""
    repo = _repository(spark, sf_dir)
    return repo.snapshot(repo.tree_of("HEAD")).select("path", "kind", "mode", F.when(F.col("kind") != "tree", F.col("oid")).alias("oid"))


@_query(f"SELECT count(*) AS reachable, 0 AS garbage FROM (SELECT DISTINCT {_oid('text')} AS oid FROM documents UNION ALL SELECT DISTINCT source FROM documents UNION ALL SELECT DISTINCT source || lang FROM documents UNION ALL SELECT 'root' UNION ALL SELECT 'commit')")
def repository_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that nothing reaches are added and collected again."""
    repo = _repository(spark, sf_dir)
    pages = _objects(spark, sf_dir, "pages", "html").select(oid(F.concat(F.lit("page "), F.col("html"))).alias("oid"), "type", F.octet_length("content").cast("bigint").alias("size"), "content")
    kept = repo.add_table(pages.dropDuplicates(["oid"])).gc()
    reach = kept.reachable()
    return reach.agg(F.count("*").alias("reachable")).crossJoin(kept.objects.join(reach, "oid", "left_anti").agg(F.count("*").cast("int").alias("garbage")))


@_query("SELECT 'main' AS branch, 3 AS commits, 'third' AS newest UNION ALL SELECT 'side', 2, 'second'")
def repository_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, branches and an annotated tag through the facade."""
    repo = _repository(spark, sf_dir)
    who = {"name": "A", "email": "a@x", "timestamp": 2000, "timezone": "+0000"}
    first = repo.read_ref("HEAD")
    repo, second = repo.create_commit(repo.tree_of("HEAD"), [first], who, "second")
    repo, third = repo.create_commit(repo.tree_of("HEAD"), [second], who | {"timestamp": 3000}, "third")
    repo, tag = repo.update_refs({"refs/heads/main": third}).create_branch("side", second).create_tag("v1", second, who, "a tag")
    rows = None
    for branch, name in (("main", "HEAD"), ("side", "refs/tags/v1")):
        log = repo.log([name])
        part = log.agg(F.count("*").cast("int").alias("commits"), F.min_by("message", "position").alias("newest")).select(F.lit(branch).alias("branch"), "commits", "newest")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@_query(_A)
def directory_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a directory, read as a snapshot."""
    folder = _folder(spark)
    where = X.snapshot_a(spark, sf_dir).select("path", "oid").join(X.blobs(spark, sf_dir).select("oid", "text").dropDuplicates(["oid"]), "oid")

    def write(batches):
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                writers.put_file(f"{folder}/{path}", text.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    where.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return spark.read.format("repo_tree").load(folder.removeprefix("file://")).select("path", "mode", "oid")


@_query("SELECT 1 AS version, count(*) AS rows FROM documents UNION ALL SELECT 2, count(*) FROM benchmark")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table swapped for another one; the version before can still be read."""
    folder = _folder(spark)
    old = writers.swap_table(X.blobs(spark, sf_dir).select("oid"), folder)
    writers.swap_table(X.table(spark, sf_dir, "benchmark").select(oid(F.col("text")).alias("oid")), folder)
    count = lambda k, df: df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("version"), "rows")
    return count(1, writers.read_table(spark, folder, old)).unionByName(count(2, writers.read_table(spark, folder)))


@_query(f"SELECT 'b' AS worktree, path, mode, oid FROM ({_A}) WHERE path NOT LIKE 'src1/%'")
def worktree_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worktrees by key: two are made, one is changed and renamed, the other goes."""
    store = WorktreeStore(spark, _folder(spark))
    base = X.snapshot_a(spark, sf_dir)
    for key in ("a", "x/1", "x/2"):
        store.create(key, worktree.Worktree(base))
    store.save("a", store.open("a").delete("src1"))
    store.rename("a", "b")
    store.delete_prefix("x/")
    keys = store.keys()
    return store.open("b").current.select(F.lit(",".join(keys)).alias("worktree"), "path", "mode", "oid")


@_query(f"SELECT path, 'remove' AS change, oid AS old_oid FROM ({_A}) WHERE path LIKE 'src1/%'")
def worktree_changes_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes as JSON records and back."""
    from grovespark.operators.worktree_store import changes_from_json, changes_to_json

    base = X.snapshot_a(spark, sf_dir)
    back = changes_from_json(changes_to_json(worktree.Worktree(base, base.where(~F.col("path").startswith("src1/"))).diff()))
    return back.select("path", "change", F.col("previous.oid").alias("old_oid"))


# Listings of a remote


def _listed(spark: SparkSession, sf_dir: str) -> list[dict]:
    rows = _live(spark, sf_dir).orderBy("name").collect()
    return [{"name": r["name"], "oid": r["oid"], "peeled": r["oid"][::-1] if r["name"].endswith("1") else None, "symref_target": None} for r in rows]


_LISTED = f"SELECT name, oid, CASE WHEN name LIKE '%1' THEN reverse(oid) END AS peeled, cast(NULL AS VARCHAR) AS symref_target FROM ({_LIVE})"


@_query(_LISTED)
def remote_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of version 2 as a file, read as a table."""
    folder = _folder(spark)
    writers.put_file(f"{folder}/listing", protocol.write_listing(_listed(spark, sf_dir)))
    return spark.read.format("repo_remote").load(folder)


@_query(_LISTED)
def remote_advertisement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An advertisement of version 1, with capabilities after the first name."""
    folder = _folder(spark)
    writers.put_file(f"{folder}/advertisement", protocol.write_advertisement(_listed(spark, sf_dir), ["report-status", "ofs-delta"], "git-upload-pack"))
    return spark.read.format("repo_remote").load(folder)


@_query(f"SELECT DISTINCT {_oid('text')} AS oid, octet_length(encode(text)) AS size FROM documents")
def remote_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as a server answers them."""
    folder = _folder(spark)
    rows = X.blobs(spark, sf_dir).select("oid", "size").distinct()

    def write(batches):
        for batch in batches:
            name = uuid.uuid4().hex
            writers.put_file(f"{folder}/{name}", protocol.write_sizes(dict(zip(batch.column("oid").to_pylist(), batch.column("size").to_pylist(), strict=True))))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return spark.read.format("repo_sizes").load(folder)


@_query(f"WITH l AS ({_LISTED}) SELECT name, oid, peeled, CASE WHEN name = (SELECT min(name) FROM l) THEN 'HEAD' END AS head FROM l")
def ref_advertisement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a server lists: tags peeled, and HEAD with the branch it names."""
    live = _live(spark, sf_dir)
    first = live.agg(F.min("name")).first()[0]
    table = live.select("name", F.col("oid").alias("target")).unionByName(spark.createDataFrame([("HEAD", f"ref: {first}")], "name string, target string"))
    tags = live.where(F.col("name").endswith("1")).select("oid", F.reverse("oid").alias("object"))
    rows = Scratch(spark).keep(refs.advertised(table, tags))
    head = rows.where("name = 'HEAD'").select(F.col("symref_target").alias("name"), F.col("name").alias("head"))
    return rows.where("name <> 'HEAD'").join(head, "name", "left").select("name", "oid", "peeled", "head")


@_query("SELECT o_orderkey AS oid, cast(epoch(o_orderdate) AS BIGINT) AS ts, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commits numbered by time, range by range."""
    return numbered(X.commits(spark, sf_dir), [F.col("ts"), F.col("oid")])


@_query(f"SELECT path, kind, size FROM (SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS path, 'blob' AS kind, octet_length(encode(text)) AS size FROM documents)")
def worktree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worktree.Worktree(X.snapshot_a(spark, sf_dir)).with_sizes(X.blobs(spark, sf_dir).select("oid", "size").distinct()).select("path", "kind", "size")


# Exchange of messages, with services in this process


def _served(spark: SparkSession, sf_dir: str) -> tuple[Repository, services.Transport]:
    repo = _repository(spark, sf_dir)
    return repo, services.transport_of(services.UploadPackService(repo))


@_query("SELECT 'HEAD' AS name, 'refs/heads/main' AS symref_target, true AS same UNION ALL SELECT 'refs/heads/main', NULL, true")
def service_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server's references over the wire."""
    repo, transport = _served(spark, sf_dir)
    rows = services.list_remote(Repository.create(spark), transport, ["refs/heads/"])
    return rows.select("name", "symref_target", (F.col("oid") == F.lit(repo.read_ref("HEAD"))).alias("same"))


@_query(f"SELECT DISTINCT {_oid('text')} AS oid, octet_length(encode(text)) AS size FROM documents UNION ALL SELECT repeat('f', 40), NULL")
def service_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes over the wire; null for an id that isn't there."""
    _, transport = _served(spark, sf_dir)
    wanted = [r["oid"] for r in X.blobs(spark, sf_dir).select("oid").distinct().collect()] + ["f" * 40]
    return spark.createDataFrame(list(services.remote_sizes(transport, wanted).items()), "oid string, size bigint")


@_query(_A)
def service_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty repository fetches a tip: negotiation, pack, objects; then the tip's snapshot is read from what arrived."""
    _, transport = _served(spark, sf_dir)
    mine = Repository.create(spark)
    tip = services.list_remote(mine, transport).where("name = 'HEAD'").first()["oid"]
    got = services.fetch_objects(mine, transport, [tip]).update_refs({"refs/heads/main": tip})
    return got.snapshot(got.tree_of("HEAD")).where("kind <> 'tree'").select("path", "mode", "oid")


@_query(f"SELECT path, mode, oid, 'refs/heads/main' AS ref, true AS ok FROM ({_A})")
def service_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A push to an empty server, its report, and the server's snapshot after it."""
    repo = _repository(spark, sf_dir)
    receive = services.ReceivePackService(Repository.create(spark))
    report = services.push(repo, services.transport_of(receive=receive), ["refs/heads/*:refs/heads/*"])
    there = receive.repo
    return there.snapshot(there.tree_of("refs/heads/main")).where("kind <> 'tree'").select("path", "mode", "oid").crossJoin(F.broadcast(report.select("ref", "ok")))
