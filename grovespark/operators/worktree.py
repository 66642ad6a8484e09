"""A worktree is a base snapshot and a log of operations; its state and changes are computed from both.

ops: (seq, op, path, to_path, mode, oid). op: write (a file or link: mode, oid), mkdir, delete, move, copy,
restore. Runs of operations that name single paths are settled at once (the last on a path counts); a move, copy,
restore or recursive delete is a step that rewrites a prefix. An instance is immutable: rollback is keeping the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.errors import NotDirectoryError, NotFileError, NotSymlinkError, OriginUnavailableError, PathExistsError, PathNotFoundError
from grovespark.functions import paths as P
from grovespark.operators import trees
from grovespark.schema import DIRECTORY, EMPTY_TREE, SYMLINK
from grovespark.storage import Scratch


def _at(path: str):
    return (F.col("path") == path) | F.col("path").startswith(f"{path}/")


def _shift(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.concat(F.lit(b), F.substring(F.col("path"), F.lit(len(a) + 1), F.length("path"))).alias("path"), "mode", "oid")


class Worktree:
    def __init__(self, base: DataFrame, current: DataFrame | None = None, contents: DataFrame | None = None):
        """base, current: snapshots (path, mode, oid); contents: (oid, content) of what was written here."""
        self.base = base.select("path", "mode", "oid")
        self.current = self.base if current is None else current
        self.contents = contents

    def _with(self, current: DataFrame) -> Worktree:
        return Worktree(self.base, Scratch(self.base.sparkSession).keep(current.select("path", "mode", "oid")), self.contents)

    # Reads

    def stat(self, path: str) -> dict | None:
        """kind, mode, oid of a path; null if nothing is there; the root is always a directory."""
        if path == "":
            return {"kind": "tree", "mode": DIRECTORY, "oid": None}
        row = self.current.where(F.col("path") == path).first()
        if row:
            return {"kind": {DIRECTORY: "tree", SYMLINK: "symlink"}.get(row["mode"], "blob"), "mode": row["mode"], "oid": row["oid"]}
        if not self.current.where(F.col("path").startswith(f"{path}/")).isEmpty():
            return {"kind": "tree", "mode": DIRECTORY, "oid": None}
        return None

    def exists(self, path: str) -> bool:
        return self.stat(path) is not None

    def require(self, path: str, kind: str | None = None) -> dict:
        found = self.stat(path)
        if found is None:
            raise PathNotFoundError(path)
        if kind and found["kind"] != kind:
            raise {"tree": NotDirectoryError, "blob": NotFileError, "symlink": NotSymlinkError}[kind](path)
        return found

    def children(self, path: str = "") -> DataFrame:
        """(name, kind, mode, oid) of a directory's entries, sorted by name."""
        self.require(path, "tree")
        below = self.current if path == "" else self.current.where(F.col("path").startswith(f"{path}/"))
        rest = F.col("path") if path == "" else F.substring(F.col("path"), F.lit(len(path) + 2), F.length("path"))
        name, deeper = F.substring_index(rest, "/", 1), rest.contains("/")
        rows = below.where(rest != "").select(name.alias("name"), F.when(deeper, DIRECTORY).otherwise(F.col("mode")).alias("mode"), F.when(~deeper, F.col("oid")).alias("oid"))
        one = rows.groupBy("name").agg(F.max("mode").alias("mode"), F.max("oid").alias("oid"), F.max(F.col("mode") == DIRECTORY).alias("d"))
        one = one.select("name", F.when(F.col("d"), DIRECTORY).otherwise(F.col("mode")).alias("mode"), F.when(~F.col("d"), F.col("oid")).alias("oid"))
        return one.select("name", P.lenient_kind(F.col("mode")).alias("kind"), "mode", "oid").orderBy("name")

    def read(self, path: str, objects: DataFrame, kind: str = "blob") -> bytes:
        """A file's content (kind 'symlink': a link's target), from what was written here or from objects (oid, content)."""
        found = self.require(path, kind)
        known = objects.select("oid", "content")
        known = known if self.contents is None else self.contents.select("oid", "content").unionByName(known)
        row = known.where(F.col("oid") == found["oid"]).first()
        if row is None:
            raise OriginUnavailableError(path)
        return bytes(row["content"])

    def with_sizes(self, objects: DataFrame) -> DataFrame:
        """The snapshot with sizes from objects (oid, size)."""
        return self.current.join(objects.select("oid", "size"), "oid", "left").select("path", P.lenient_kind(F.col("mode")).alias("kind"), "mode", "oid", F.when(F.col("mode") == DIRECTORY, F.lit(0)).otherwise(F.col("size")).alias("size"))

    # Writes

    def apply(self, ops: DataFrame) -> Worktree:
        """All operations in the order of seq. Steps that move prefixes are taken one by one, the runs between them at once."""
        steps = [r.asDict() for r in ops.where("op IN ('move', 'copy', 'restore')").orderBy("seq").collect()]
        tree, low = self, None
        for step in [*steps, None]:
            part = ops.where("op NOT IN ('move', 'copy', 'restore')")
            part = part if low is None else part.where(F.col("seq") > low)
            part = part if step is None else part.where(F.col("seq") < step["seq"])
            tree = tree._run(part)
            if step is None:
                return tree
            low = step["seq"]
            one = {"move": tree.move, "copy": tree.copy}.get(step["op"])
            tree = one(step["path"], step["to_path"]) if one else tree.restore(step["path"])
        return tree

    def _run(self, ops: DataFrame) -> Worktree:
        if ops.isEmpty():
            return self
        patch = ops.select(
            "seq", F.when(F.col("op") == "delete", "delete").otherwise("upsert").alias("op"), "path",
            F.when(F.col("op") == "mkdir", DIRECTORY).otherwise(F.col("mode")).alias("mode"), F.when(F.col("op") == "mkdir", EMPTY_TREE).otherwise(F.col("oid")).alias("oid"),
            F.lit(None).cast("string").alias("from_path"), F.lit(None).cast("string").alias("to_path"),
        )
        return self._with(trees.patch(self.current, patch).leaves)

    def write(self, path: str, oid: str, mode: str = "100644") -> Worktree:
        found = self.stat(path)
        if found and found["kind"] == "tree":
            raise NotFileError(path)
        parent = path.rpartition("/")[0]
        self.require(parent, "tree")
        row = self.base.sparkSession.createDataFrame([(path, mode, oid)], "path string, mode string, oid string")
        return self._with(self._without_marker(parent).where(F.col("path") != path).unionByName(row))

    def _without_marker(self, directory: str) -> DataFrame:
        """An empty directory's row goes when it gets an entry."""
        return self.current.where((F.col("path") != directory) | (F.col("mode") != DIRECTORY))

    def mkdir(self, path: str, recursive: bool = False) -> Worktree:
        if self.exists(path):
            if recursive and self.stat(path)["kind"] == "tree":
                return self
            raise PathExistsError(path)
        if not recursive:
            self.require(path.rpartition("/")[0], "tree")
        kept = self.current
        for up in _above(path):
            found = self.stat(up)
            if found and found["kind"] != "tree":
                raise NotDirectoryError(up)
            kept = kept.where((F.col("path") != up) | (F.col("mode") != DIRECTORY))
        row = self.base.sparkSession.createDataFrame([(path, DIRECTORY, EMPTY_TREE)], "path string, mode string, oid string")
        return self._with(kept.unionByName(row))

    def delete(self, path: str, force: bool = False) -> Worktree:
        """A file, link or whole directory. An entry of the base stays deleted, however often it came back before."""
        if not self.exists(path):
            if force:
                return self
            raise PathNotFoundError(path)
        return self._with(_keep_parent(self.current.where(~_at(path)), self.current, path))

    def move(self, path: str, to: str) -> Worktree:
        """Directories above the target are made; the target must be free, and not inside what moves."""
        self.require(path)
        if to == path or to.startswith(f"{path}/"):
            raise PathExistsError(f"{to} is inside {path}")
        if self.exists(to):
            raise PathExistsError(to)
        moved = _shift(self.current.where(_at(path)), path, to)
        rest = _keep_parent(self.current.where(~_at(path)), self.current, path)
        for up in _above(to):
            rest = rest.where((F.col("path") != up) | (F.col("mode") != DIRECTORY))
        return self._with(rest.unionByName(moved))

    def copy(self, path: str, to: str) -> Worktree:
        self.require(path)
        if self.exists(to):
            raise PathExistsError(to)
        parent = to.rpartition("/")[0]
        self.require(parent, "tree")
        return self._with(self._without_marker(parent).unionByName(_shift(self.current.where(_at(path)), path, to)))

    def restore(self, path: str) -> Worktree:
        """A path and all below it as in the base; gone if the base hasn't got it."""
        old = self.base if path == "" else self.base.where(_at(path))
        rest = self.current.where(F.lit(False)) if path == "" else self.current.where(~_at(path))
        if old.isEmpty() and not self.exists(path):
            raise PathNotFoundError(path)
        return self._with(rest.unionByName(old))

    def reset(self, base: DataFrame) -> Worktree:
        return Worktree(base)

    # Changes

    def diff(self) -> DataFrame:
        return trees.diff(self.base, self.current)

    def diff_path(self, path: str) -> DataFrame:
        """One path's change: the filter reaches both scans."""
        return trees.diff(self.base.where(F.col("path") == path), self.current.where(F.col("path") == path))

    def write_tree(self, by: str = "canonical") -> tuple[str, DataFrame]:
        """(root id, trees) of the current state."""
        made = trees.build(self.current, by)
        return trees.root(made), made


class ChangeIndex:
    """The changes of a worktree, kept from one state to the next: what touches one file is looked at alone, anything else is
    compared anew. `changes` is always Worktree.diff()."""

    def __init__(self, tree: Worktree, changes: DataFrame | None = None):
        self.tree = tree
        self.changes = Scratch(tree.base.sparkSession).keep(tree.diff()) if changes is None else changes

    def plan(self, op: str, path: str, missing_is_file: bool = True) -> str:
        """'path' or 'all': what has to be compared after an operation. A path that isn't there is taken for a file's."""
        if op in ("move", "copy", "restore"):
            return "all"
        found = self.tree.stat(path)
        if found is None:
            return "path" if missing_is_file else "all"
        return "all" if found["kind"] == "tree" else "path"

    def after(self, op: str, path: str, tree: Worktree) -> ChangeIndex:
        """The index of `tree`, which an operation on a path made of this one's."""
        if self.plan(op, path) == "all":
            return ChangeIndex(tree)
        # a directory's own row can come or go with its only file
        near = [path, *_above(path)]
        some = lambda df: df.where(F.col("path").isin(near))
        new = trees.diff(some(tree.base), some(tree.current))
        return ChangeIndex(tree, Scratch(tree.base.sparkSession).keep(self.changes.where(~F.col("path").isin(near)).unionByName(new)))


def _above(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts))]


def _keep_parent(rest: DataFrame, before: DataFrame, path: str) -> DataFrame:
    """A directory that lost its last entry stays, empty."""
    parent = path.rpartition("/")[0]
    if not parent or not rest.where(_at(parent)).isEmpty():
        return rest
    row = before.sparkSession.createDataFrame([(parent, DIRECTORY, EMPTY_TREE)], "path string, mode string, oid string")
    return rest.unionByName(row)


def overlay(base: DataFrame, ops: DataFrame) -> DataFrame:
    """base (path, mode, oid) under a bulk of writes and deletes of single paths (seq, op, path, mode, oid): one full join, no
    step by step. The last operation on a path counts."""
    last = trees.last_ops(ops)
    both = base.join(last.select("path", F.struct("op", F.col("mode").alias("m"), F.col("oid").alias("o")).alias("__op")), "path", "full")
    kept = both.where("__op IS NULL OR __op.op <> 'delete'")
    return kept.select("path", F.coalesce("__op.m", "mode").alias("mode"), F.coalesce("__op.o", "oid").alias("oid"))


def rewrite(base: DataFrame, moves: DataFrame) -> DataFrame:
    """base under many prefix moves and copies at once (op, from_path, to_path), none inside another: an equi-join of each
    path's ancestors with the prefixes, whatever their number."""
    up = base.withColumn("from_path", F.explode(F.concat(P.ancestors(F.col("path")), F.array("path"))))
    hit = up.join(moves.select("op", "from_path", "to_path"), "from_path")
    rest = F.substring(F.col("path"), F.length("from_path") + F.when(F.col("from_path") == "", 1).otherwise(2), F.length("path"))
    new = hit.select("op", F.col("path").alias("was"), P.join_path(F.col("to_path"), rest).alias("path"), "mode", "oid").withColumn("path", F.regexp_replace("path", "/$", ""))
    gone = new.where("op = 'move'").select(F.col("was").alias("path")).distinct()
    return base.join(gone, "path", "left_anti").unionByName(new.select("path", "mode", "oid"))
