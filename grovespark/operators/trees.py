"""Snapshots and trees: flattening, comparing, building and patching.

A snapshot is a table (path, mode, oid) of leaves: files, links, and directories that are taken as a
whole (empty ones, or subtrees that are known by id). Everything but the level loops is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.errors import PathNotFoundError
from grovespark.functions import paths as P
from grovespark.functions.oid import frame
from grovespark.schema import DIRECTORY, EMPTY_TREE
from grovespark.storage import Scratch

#: Levels that are built within one plan; deeper trees are written out in between.
PLAN_LEVELS = 6


def flatten(entries: DataFrame, root: str | DataFrame, directories: bool = False) -> DataFrame:
    """(path, mode, oid) of everything below a tree. entries: tree_oid, name, mode, oid. root: an id, or a table (oid, and
    path to start at). A level is one equi-join on the tree's id; the loop ends when no directory is left.
    directories: with rows for directories too; an empty one is always a row."""
    spark = entries.sparkSession
    if isinstance(root, str):
        root = spark.createDataFrame([("", root)], "path string, oid string")
    scratch, out = Scratch(spark), None
    frontier = root.select("path", F.col("oid").alias("tree_oid"))
    own = entries.select("tree_oid", "name", P.canonical_mode(F.col("mode")).alias("mode"), "oid")
    while True:
        level = scratch.keep(frontier.join(own, "tree_oid").select(P.join_path(F.col("path"), F.col("name")).alias("path"), "mode", "oid"))
        down = level.where(F.col("mode") == DIRECTORY)
        empty = down.where(F.col("oid") == EMPTY_TREE)
        rows = level if directories else level.where(F.col("mode") != DIRECTORY).unionByName(empty)
        out = rows if out is None else out.unionByName(rows)
        frontier = down.where(F.col("oid") != EMPTY_TREE).select("path", F.col("oid").alias("tree_oid"))
        if frontier.isEmpty():
            return out


def snapshot(entries: DataFrame, root: str | DataFrame) -> DataFrame:
    """(path, kind, mode, oid), directories included; an entry that no snapshot holds raises."""
    return flatten(entries, root, directories=True).select("path", P.kind(F.col("mode")).alias("kind"), "mode", "oid")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two snapshots (path, mode, oid): a row for each path that isn't the same.
    change is create, remove or update; old_* and new_*; and what of an update changed. One full join on path."""
    a = before.select("path", F.struct(P.lenient_kind(F.col("mode")).alias("kind"), "mode", "oid").alias("old"))
    b = after.select("path", F.struct(P.lenient_kind(F.col("mode")).alias("kind"), "mode", "oid").alias("new"))
    both = a.join(b, "path", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "remove").otherwise("update")
    update = F.col("old").isNotNull() & F.col("new").isNotNull()
    differs = lambda f: F.coalesce(update & (F.col(f"old.{f}") != F.col(f"new.{f}")), F.lit(False))
    return both.select(
        "path", change.alias("change"), F.col("old.kind").alias("old_kind"), F.col("old.mode").alias("old_mode"), F.col("old.oid").alias("old_oid"),
        F.col("new.kind").alias("new_kind"), F.col("new.mode").alias("new_mode"), F.col("new.oid").alias("new_oid"),
        differs("kind").alias("kind_changed"), differs("mode").alias("mode_changed"), differs("oid").alias("content_changed"),
    )


def ordered(rows: DataFrame, by: str = "bytes") -> DataFrame:
    """Sorted by path: bytewise, or 'locale' by the Unicode collation."""
    return rows.orderBy("path" if by == "bytes" else F.collate("path", "UNICODE"))


def entry_order(name: Column, mode: Column, by: str = "canonical") -> Column:
    """What entries of a tree are sorted by. canonical: bytes, a directory as if its name ended in a slash.
    locale: the Unicode collation on bare names."""
    if by == "locale":
        return F.collate(name, "UNICODE")
    return F.when(mode == DIRECTORY, F.concat(name, F.lit("/"))).otherwise(name).cast("binary")


def tree_bodies(entries: DataFrame, by: str = "canonical", keys: tuple[str, ...] = ("parent",)) -> DataFrame:
    """(keys, content, oid): the tree that the entries (keys, name, mode, oid) of each group make.
    An ordered binary aggregate: one shuffle on the keys."""
    item = F.concat(F.concat(P.disk_mode(F.col("mode")), F.lit(" "), F.col("name")).cast("binary"), F.lit(b"\0"), F.unhex("oid"))
    rows = entries.select(*keys, item.alias("__item"), entry_order(F.col("name"), F.col("mode"), by).alias("__order"))
    body = rows.groupBy(*keys).agg(F.expr("listagg(__item) WITHIN GROUP (ORDER BY __order)").alias("content"))
    return body.withColumn("oid", F.sha1(frame(F.col("content"), "tree")))


def build(leaves: DataFrame, by: str = "canonical", deepest: int | None = None) -> DataFrame:
    """Every tree that a snapshot's directories make, bottom-up: (path, oid, content), the root's path is ''.
    A leaf of mode 040000 stands for its whole subtree, so clean subtrees are reused by id. An empty snapshot makes the
    empty tree."""
    spark = leaves.sparkSession
    leaves = leaves.select("path", "mode", "oid").withColumn("depth", P.depth(F.col("path")))
    if deepest is None:
        found = leaves.agg(F.max("depth").alias("d")).first()["d"]
        deepest = -1 if found is None else found
    if deepest < 0:
        return spark.createDataFrame([("", EMPTY_TREE, b"")], "path string, oid string, content binary")
    scratch, made, out = Scratch(spark), None, None
    for d in range(deepest, -1, -1):
        level = leaves.where(F.col("depth") == d).select("path", "mode", "oid")
        if made is not None:
            level = level.unionByName(made.select("path", F.lit(DIRECTORY).alias("mode"), "oid"))
        rows = level.select(P.parent_path(F.col("path")).alias("parent"), P.base_name(F.col("path")).alias("name"), "mode", "oid")
        made = tree_bodies(rows, by).select(F.col("parent").alias("path"), "oid", "content")
        if deepest > PLAN_LEVELS:
            made = scratch.keep(made)
        out = made if out is None else out.unionByName(made)
    return out


def root(trees: DataFrame) -> str:
    return trees.where("path = ''").select("oid").first()["oid"]


def dirty_directories(changed: DataFrame) -> DataFrame:
    """(path): every directory above a changed path, the root among them."""
    return changed.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()


def changed_children(changed: DataFrame) -> DataFrame:
    """(directory, dirty_descendants, names): for each dirty directory how many changed paths lie below it, and which
    of its children are touched."""
    up = changed.select("path", F.explode(P.ancestors(F.col("path"))).alias("directory"))
    rest = F.when(F.col("directory") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("directory") + 2, F.length("path")))
    return up.groupBy("directory").agg(F.count("*").alias("dirty_descendants"), F.sort_array(F.collect_set(F.substring_index(rest, "/", 1))).alias("names"))


def last_ops(ops: DataFrame) -> DataFrame:
    """The last operation on each path."""
    return ops.groupBy("path").agg(F.max_by(F.struct("seq", "op", "mode", "oid"), "seq").alias("o")).select("path", "o.*")


@dataclass
class Patched:
    leaves: DataFrame  # path, mode, oid
    errors: DataFrame  # seq, path, error


def _apply(leaves: DataFrame, ops: DataFrame) -> Patched:
    """Upserts and deletes without renames, the last on each path. What several later parts read is written once."""
    scratch = Scratch(leaves.sparkSession)
    last = scratch.keep(last_ops(ops))
    gone = last.select(F.col("path").alias("cover"))
    # what is at or below an operated path
    up = leaves.withColumn("cover", F.explode(F.concat(P.ancestors(F.col("path")), F.array("path"))))
    covered = scratch.keep(up.join(gone, "cover", "left_semi").select("path", "cover").distinct())
    kept = leaves.join(covered.select("path").distinct(), "path", "left_anti")
    upserts = last.where("op = 'upsert'")
    # of an upserted path and one below it, the shorter one wins
    below = upserts.select("path", F.explode(P.ancestors(F.col("path"))).alias("cover")).join(last.select(F.col("path").alias("cover")), "cover", "left_semi").select("path").distinct()
    new = scratch.keep(upserts.join(below, "path", "left_anti").select("path", "mode", "oid"))
    above = new.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    kept = scratch.keep(kept)
    blocked = kept.where(F.col("mode") != DIRECTORY).join(above, "path", "left_semi").select("path")
    stale = kept.where(F.col("mode") == DIRECTORY).join(above, "path", "left_semi").select("path")
    placed = scratch.keep(kept.join(stale, "path", "left_anti").unionByName(new))
    # directories outlive their last entry
    were = leaves.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct().where("path <> ''")
    dead = were.withColumn("cover", F.explode(F.concat(P.ancestors(F.col("path")), F.array("path")))).join(gone, "cover", "left_semi").select("path").distinct()
    full = placed.select(F.explode(F.concat(P.ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    empty = scratch.keep(were.join(dead, "path", "left_anti").join(full, "path", "left_anti"))
    # the deepest of nested empty ones stands for those above it
    inner = empty.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    hollow = empty.join(inner, "path", "left_anti").select("path", F.lit(DIRECTORY).alias("mode"), F.lit(EMPTY_TREE).alias("oid"))
    upserted = ops.where("op = 'upsert'").select(F.col("path").alias("cover")).distinct()
    missing = last.where("op = 'delete'").join(covered.withColumnRenamed("path", "p"), F.col("path") == F.col("cover"), "left_anti").join(upserted, F.col("path") == F.col("cover"), "left_anti").select("seq", "path", F.lit("nothing there to delete").alias("error"))
    through = new.select("path", F.explode(P.ancestors(F.col("path"))).alias("up")).join(blocked.withColumnRenamed("path", "up"), "up").join(last.select("path", "seq"), "path").select("seq", "path", F.concat(F.lit("no directory: "), F.col("up")).alias("error"))
    bad = ops.where(P.path_error(F.col("path")).isNotNull()).select("seq", "path", P.path_error(F.col("path")).alias("error"))
    return Patched(scratch.keep(placed.unionByName(hollow)), scratch.keep(missing.unionByName(through).unionByName(bad).distinct()))


def _inside(path: Column, folder: Column) -> Column:
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def _rename_all(now: DataFrame, run: list[dict]) -> DataFrame | None:
    """now after renames that follow each other, as a fold over them in each row; null if one of them finds nothing."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r["from_path"]).alias("a"), F.lit(r["to_path"]).alias("b")) for k, r in enumerate(run)])
    start = F.struct(F.col("path").alias("path"), F.lit(False).alias("gone"), F.array().cast("array<int>").alias("moved"))

    def step(x: Column, r: Column) -> Column:
        hit = _inside(x["path"], r["a"])
        return F.struct(
            F.when(hit, F.concat(r["b"], F.substring(x["path"], F.length(r["a"]) + 1, F.length(x["path"])))).otherwise(x["path"]).alias("path"),
            (x["gone"] | (_inside(x["path"], r["b"]) & ~hit)).alias("gone"), F.when(hit & ~x["gone"], F.concat(x["moved"], F.array(r["k"]))).otherwise(x["moved"]).alias("moved"),
        )

    done = Scratch(now.sparkSession).keep(now.select(F.aggregate(steps, start, step).alias("x"), "mode", "oid").select("x.*", "mode", "oid"))
    if done.select(F.explode("moved")).distinct().count() < len(run):
        return None
    return done.where("NOT gone").select("path", "mode", "oid")


def patch(leaves: DataFrame, ops: DataFrame) -> Patched:
    """Apply patch_ops (seq, op, path, mode, oid, from_path, to_path) in the order of seq to a snapshot.
    Between renames the last operation on a path counts; a rename moves a leaf or a whole directory, and one onto
    itself does nothing. errors lists what can't be done; leaves holds the rest. Renames that follow each other are one step."""
    spark, scratch = leaves.sparkSession, Scratch(leaves.sparkSession)
    now, errors = leaves.select("path", "mode", "oid"), None
    renames = [r.asDict() for r in ops.where("op = 'rename'").orderBy("seq").collect()]
    plain = ops.where("op <> 'rename'").withColumn("__slot", F.lit(0))
    if renames:
        # how many renames come before each operation
        before = F.array(*[F.lit(r["seq"]) for r in renames])
        plain = scratch.keep(plain.withColumn("__slot", F.size(F.filter(before, lambda s: s < F.col("seq")))))
    slots = {r["__slot"] for r in plain.select("__slot").distinct().collect()}
    bad = lambda low, path: spark.createDataFrame([(low, path, "nothing there to rename")], f"seq {ops.schema['seq'].dataType.simpleString()}, path string, error string")
    run: list[dict] = []
    for k in range(len(renames) + 1):
        if run and (k in slots or k == len(renames)):
            now = scratch.keep(now)
            after = _rename_all(now, run)
            for r in run if after is None else ():
                if now.where(_inside(F.col("path"), F.lit(r["from_path"]))).isEmpty():
                    errors = bad(r["seq"], r["from_path"]) if errors is None else errors.unionByName(bad(r["seq"], r["from_path"]))
                else:
                    now = _rename_all(now, [r])
            now, run = now if after is None else after, []
        if k in slots:
            done = _apply(now, plain.where(F.col("__slot") == k).drop("__slot"))
            now = done.leaves
            errors = done.errors if errors is None else errors.unionByName(done.errors)
        if k < len(renames) and renames[k]["from_path"] != renames[k]["to_path"]:
            run.append(renames[k])
    if errors is None:
        errors = bad(None, "").limit(0)
    return Patched(now, errors)


def patch_tree(leaves: DataFrame, ops: DataFrame, by: str = "canonical") -> tuple[str, DataFrame]:
    """(root id, trees written) after a patch; PathNotFoundError if any of it can't be done. Without operations the root is
    as it was."""
    done = patch(leaves, ops)
    bad = done.errors.orderBy("seq", "path").first()
    if bad:
        raise PathNotFoundError(f"{bad['path']}: {bad['error']}")
    trees = build(Scratch(leaves.sparkSession).keep(done.leaves), by)
    return root(trees), trees
