"""A repository as tables: objects, refs and the shallow set, with the operations that users call.

Every operation that writes gives a new Repository; the old one is the rollback. Typed views (commits, tags, tree
entries) parse contents where they are read. save() and open() go through swapped tables, import_files() through the
on-disk formats.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.errors import InvalidObjectError, ObjectNotFoundError, RefNotFoundError, TransactionError
from grovespark.functions import codecs
from grovespark.functions.names import RefSpec, require_ref_name
from grovespark.operators import graph, trees
from grovespark.operators import refs as R
from grovespark.operators.worktree import Worktree
from grovespark.plans import importing, pushing
from grovespark.schema import HEADS, OBJECTS, REFS, SHALLOW, TAGS_PREFIX
from grovespark.sources import datasource, writers
from grovespark.storage import Scratch


@dataclass(frozen=True)
class Repository:
    objects: DataFrame  # oid, type, size, content
    refs: DataFrame  # name, target
    shallow: DataFrame  # oid

    @property
    def spark(self) -> SparkSession:
        return self.objects.sparkSession

    # Made and kept

    @staticmethod
    def create(spark: SparkSession, branch: str = f"{HEADS}main") -> Repository:
        return Repository(spark.createDataFrame([], OBJECTS), R.empty_refs(spark, branch), spark.createDataFrame([], SHALLOW))

    @staticmethod
    def import_files(spark: SparkSession, folder: str) -> Repository:
        """A repository folder: loose objects first, then packs; loose references over packed ones."""
        datasource.register(spark)
        loose = spark.read.format("repo_loose").load(folder)
        packed = spark.read.format("repo_pack").load(f"{folder}/objects/pack")
        bad = packed.where("error IS NOT NULL").first()
        if bad:
            raise InvalidObjectError(f"{bad['pack']}: {bad['error']}")
        whole = packed.select("oid", "type", F.octet_length("content").cast("bigint").alias("size"), "content")
        refs = spark.read.format("repo_refs").load(folder)
        listed = [line for line in writers.read_file(f"{folder}/shallow").decode().split() if line] if datasource.list_files(f"{folder}/shallow") else []
        return Repository(R.composite([loose, whole]), refs, spark.createDataFrame([(o,) for o in listed], SHALLOW))

    def export_files(self, folder: str) -> None:
        """Loose objects and references under folder."""
        writers.init_repository(folder)
        writers.write_loose(self.objects, f"{folder}/objects").count()
        writers.write_refs(folder, [(r["name"], r["target"]) for r in self.refs.collect()])
        writers.write_shallow(folder, self.shallow)

    def save(self, folder: str) -> None:
        for name in ("objects", "shallow", "refs"):  # refs last: what they name is there by then
            writers.swap_table(getattr(self, name), f"{folder}/{name}")

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Repository:
        return Repository(*(writers.read_table(spark, f"{folder}/{n}") for n in ("objects", "refs", "shallow")))

    def settled(self) -> Repository:
        """With its tables written once, after many small changes."""
        keep = Scratch(self.spark).keep
        return Repository(keep(self.objects), keep(self.refs), keep(self.shallow))

    # Objects

    def add(self, kind: str, contents: list[bytes]) -> tuple[Repository, list[str]]:
        """Objects of a few contents at once; their ids in order."""
        rows = [(codecs.object_id(kind, c), kind, len(c), bytearray(c)) for c in contents]
        return self.add_table(self.spark.createDataFrame(rows, OBJECTS)), [r[0] for r in rows]

    def add_table(self, new: DataFrame) -> Repository:
        return replace(self, objects=R.ingest(self.objects, new.select("oid", "type", "size", "content")))

    def write_blob(self, content: bytes) -> tuple[Repository, str]:
        repo, ids = self.add("blob", [content])
        return repo, ids[0]

    def cat(self, oid: str) -> tuple[str, bytes]:
        row = self.objects.where(F.col("oid") == oid).first()
        if row is None:
            raise ObjectNotFoundError(oid)
        return row["type"], bytes(row["content"])

    def list_objects(self) -> DataFrame:
        return self.objects.select("oid", "type", "size").orderBy("oid")

    def create_tree(self, entries: list[tuple[str, str, str]]) -> tuple[Repository, str]:
        """(mode, name, oid) in the order given."""
        repo, ids = self.add("tree", [codecs.encode_tree(entries)])
        return repo, ids[0]

    def create_commit(self, tree: str, parents: list[str], author: dict, message: str, committer: dict | None = None, **more) -> tuple[Repository, str]:
        repo, ids = self.add("commit", [codecs.encode_commit({"tree": tree, "parents": parents, "author": author, "committer": committer or author, "message": message, **more})])
        return repo, ids[0]

    # Typed views

    def tree_entries(self) -> DataFrame:
        rows = self.objects.where("type = 'tree'").select(F.col("oid").alias("tree_oid"), F.posexplode(codecs.parse_tree("content")).alias("ord", "e"))
        return rows.select("tree_oid", "ord", "e.mode", "e.name", "e.oid")

    def commits(self) -> DataFrame:
        return self.objects.where("type = 'commit'").select("oid", codecs.parse_commit("content").alias("c")).select("oid", "c.*")

    def tags(self) -> DataFrame:
        return self.objects.where("type = 'tag'").select("oid", codecs.parse_tag("content").alias("t")).select("oid", "t.*")

    def edges(self) -> DataFrame:
        return graph.object_edges(self.commits(), self.tree_entries(), self.tags())

    def commit_edges(self) -> DataFrame:
        return graph.commit_edges(self.commits())

    # History and trees

    def start(self, names: list[str] | None = None) -> DataFrame:
        """(oid) of references or ids, tags peeled; HEAD without any."""
        known = {r["name"]: r["oid"] for r in R.resolve(self.refs).collect()}
        ids = [known.get(n, n) for n in names or ["HEAD"]]
        if None in ids:
            raise RefNotFoundError(str(names))
        return R.peel(self.tags(), self.spark.createDataFrame([(i,) for i in ids], "oid string")).select(F.col("peeled").alias("oid"))

    def log(self, names: list[str] | None = None, exclude: list[str] | None = None, **options) -> DataFrame:
        commits = self.commits().withColumn("ts", F.col("committer.timestamp"))
        return graph.log(commits, self.commit_edges(), self.start(names), self.start(exclude) if exclude else None, **options)

    def tree_of(self, name: str = "HEAD") -> str:
        row = self.commits().join(self.start([name]), "oid", "left_semi").first()
        if row is None:
            raise ObjectNotFoundError(name)
        return row["tree"]

    def snapshot(self, tree: str) -> DataFrame:
        return trees.snapshot(self.tree_entries(), tree)

    def diff(self, before: str, after: str) -> DataFrame:
        entries = self.tree_entries()
        return trees.diff(trees.flatten(entries, before, directories=True), trees.flatten(entries, after, directories=True))

    def write_tree(self, leaves: DataFrame, by: str = "canonical") -> tuple[Repository, str]:
        """The trees of a snapshot as objects."""
        made = Scratch(self.spark).keep(trees.build(leaves, by))
        return self._with_trees(made), trees.root(made)

    def _with_trees(self, made: DataFrame) -> Repository:
        return self.add_table(made.select("oid", F.lit("tree").alias("type"), F.octet_length("content").cast("bigint").alias("size"), "content"))

    def patch_tree(self, tree: str, ops: DataFrame) -> tuple[Repository, str]:
        if ops.isEmpty():
            return self, tree
        root, made = trees.patch_tree(trees.flatten(self.tree_entries(), tree), ops)
        return self._with_trees(made), root

    def worktree(self, tree: str) -> Worktree:
        return Worktree(trees.flatten(self.tree_entries(), tree))

    # References

    def update_refs(self, writes: dict[str, str | None]) -> Repository:
        """All or nothing: names to targets, or null to delete."""
        rows = [(k, "delete" if t is None else "write", require_ref_name(n), t) for k, (n, t) in enumerate(writes.items())]
        return replace(self, refs=R.transaction(self.refs, self.spark.createDataFrame(rows, "seq int, op string, name string, target string")))

    def read_ref(self, name: str) -> str | None:
        return R.resolve_one(self.refs, name)

    def current_branch(self) -> str | None:
        row = self.refs.where("name = 'HEAD'").first()
        return row["target"].removeprefix("ref: ") if row and row["target"].startswith("ref: ") else None

    def create_branch(self, name: str, oid: str | None = None) -> Repository:
        row = self.spark.createDataFrame([(require_ref_name(HEADS + name), oid or R.target_oid(self.refs))], REFS)
        return replace(self, refs=R.create_refs(self.refs, row))

    def delete_branch(self, name: str) -> Repository:
        return replace(self, refs=R.delete_branch(self.refs, HEADS + name))

    def create_tag(self, name: str, oid: str | None = None, tagger: dict | None = None, message: str | None = None) -> tuple[Repository, str]:
        """A plain tag, or an annotated one with tagger and message; the id that the reference holds."""
        target, repo = oid or R.target_oid(self.refs), self
        if message is not None:
            kind, _ = self.cat(target)
            repo, ids = self.add("tag", [codecs.encode_tag({"object": target, "object_type": kind, "tag": name, "tagger": tagger, "message": message})])
            target = ids[0]
        row = self.spark.createDataFrame([(require_ref_name(TAGS_PREFIX + name), target)], REFS)
        return replace(repo, refs=R.create_refs(repo.refs, row)), target

    def delete_tag(self, name: str) -> Repository:
        if self.refs.where(F.col("name") == TAGS_PREFIX + name).isEmpty():
            raise RefNotFoundError(TAGS_PREFIX + name)
        return self.update_refs({TAGS_PREFIX + name: None})

    def branches(self) -> DataFrame:
        return R.current_refs(self.refs).where(F.col("name").startswith(HEADS)).orderBy("name")

    # Maintenance

    def reachable(self, absent: str = "raise") -> DataFrame:
        """(oid): what HEAD, branches and tags need."""
        return graph.reachable(self.edges(), self.objects, graph.gc_roots(R.resolve(self.refs)), self.shallow, absent).orderBy("oid")

    def gc(self) -> Repository:
        """Without what nothing reaches."""
        kept = self.reachable()
        return replace(self, objects=self.objects.join(kept, "oid", "left_semi"))

    def write_packs(self, folder: str, packs: int = 1) -> DataFrame:
        rows = self.objects.select(F.pmod(F.xxhash64("oid"), F.lit(packs)).cast("int").alias("pack"), F.col("oid").alias("seq"), "type", "content")
        return writers.write_packs(rows, folder)

    # Exchange: the other side is a repository; who carries the bytes is plans.protocol's matter

    def advertised(self) -> DataFrame:
        return R.advertised(self.refs, self.tags())

    def fetch(self, remote: Repository, plan: importing.Plan | None = None) -> Repository:
        """Import a remote's references. Without a plan: its branches and tags, moved forward or made, and HEAD's branch."""
        view = importing.View(remote.advertised())
        if plan is None:
            heads, tags = view.select(f"{HEADS}*"), view.select(f"{TAGS_PREFIX}*")
            plan = importing.Plan(self.spark).to_namespace(heads, f"{HEADS}*").to_namespace(tags, f"{TAGS_PREFIX}*")
        wants = self.spark.createDataFrame([], "oid string")
        for act in plan.actions:
            wants = wants.union(act.view.refs.select("oid"))
        haves = R.current_refs(self.refs).select("oid")
        sent = graph.to_send(remote.edges(), wants.distinct(), haves.join(remote.objects, "oid", "left_semi"), remote.shallow)
        here = self.add_table(remote.objects.join(sent, "oid", "left_semi"))
        found = importing.preview(plan, here.refs, here.objects, here.commit_edges(), here.tags().select("oid", "object"))
        return replace(here, refs=importing.apply(found, here.refs))

    def push(self, remote: Repository, specs: list[str] | None = None, force: bool | None = None) -> tuple[Repository, DataFrame]:
        """(the remote after it, report): refspecs, or HEAD to its branch."""
        parsed = [RefSpec.parse(s) for s in specs] if specs else [pushing.default_spec(self.refs)]
        theirs = R.current_refs(remote.refs)
        items = pushing.plan_refs(R.current_refs(self.refs), theirs, parsed, force)
        held = pushing.check_fast_forward(items, self.objects, self.commit_edges(), self.tags().select("oid", "object"))
        bad = held.where("reason IS NOT NULL").first()
        if bad:
            raise TransactionError(f"{bad['remote_ref']}: {bad['reason']}")
        sent = pushing.objects_to_send(self.edges(), items, theirs, self.shallow)
        there = remote.add_table(self.objects.join(sent, "oid", "left_semi"))
        orders = pushing.commands(items)
        forced = items.where("force").select(F.col("remote_ref").alias("ref"))
        checked = pushing.check_updates(orders, there.refs, there.objects)
        checked = checked.join(forced.withColumn("f", F.lit(True)), "ref", "left").select("ref", "old_oid", "new_oid", F.when(F.col("f") & (F.col("error") == "a tag isn't replaced"), None).otherwise(F.col("error")).alias("error"))
        return replace(there, refs=pushing.apply_commands(checked, there.refs)), checked
