"""Many worktrees in one table, by key, and changes as JSON.

A store is a folder of swapped tables: base and current snapshots with a `worktree` column. Every change is a new version, so
readers see all of it or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.errors import PathExistsError, PathNotFoundError
from grovespark.operators.worktree import Worktree
from grovespark.sources.datasource import list_files
from grovespark.sources.writers import read_table, swap_table

_ROWS = "worktree string, side string, path string, mode string, oid string"
_SIDE = "struct<kind: string, mode: string, oid: string>"


class WorktreeStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        if not list_files(f"{folder}/CURRENT"):
            swap_table(spark.createDataFrame([], _ROWS), folder)

    def rows(self) -> DataFrame:
        return read_table(self.spark, self.folder)

    def keys(self, prefix: str = "") -> list[str]:
        """An empty worktree is kept by a row without a path."""
        found = self.rows().where(F.col("worktree").startswith(prefix)).select("worktree").distinct().orderBy("worktree")
        return [r["worktree"] for r in found.collect()]

    def has(self, key: str) -> bool:
        return not self.rows().where(F.col("worktree") == key).isEmpty()

    def _swap(self, kept: DataFrame, key: str | None = None, tree: Worktree | None = None) -> None:
        if tree is not None:
            side = lambda df, s: df.select(F.lit(key).alias("worktree"), F.lit(s).alias("side"), "path", "mode", "oid")
            mark = self.spark.createDataFrame([(key, "key", None, None, None)], _ROWS)
            kept = kept.unionByName(side(tree.base, "base")).unionByName(side(tree.current, "current")).unionByName(mark)
        swap_table(kept, self.folder)

    def create(self, key: str, tree: Worktree) -> None:
        if self.has(key):
            raise PathExistsError(key)
        self._swap(self.rows(), key, tree)

    def save(self, key: str, tree: Worktree) -> None:
        self._swap(self.rows().where(F.col("worktree") != key), key, tree)

    def open(self, key: str) -> Worktree:
        own = self.rows().where(F.col("worktree") == key)
        if own.isEmpty():
            raise PathNotFoundError(key)
        return Worktree(own.where("side = 'base'").select("path", "mode", "oid"), own.where("side = 'current'").select("path", "mode", "oid"))

    def rename(self, key: str, to: str) -> None:
        if not self.has(key):
            raise PathNotFoundError(key)
        if self.has(to):
            raise PathExistsError(to)
        self._swap(self.rows().withColumn("worktree", F.when(F.col("worktree") == key, to).otherwise(F.col("worktree"))))

    def delete(self, key: str) -> bool:
        there = self.has(key)
        if there:
            self._swap(self.rows().where(F.col("worktree") != key))
        return there

    def delete_prefix(self, prefix: str) -> int:
        gone = len(self.keys(prefix))
        if gone:
            self._swap(self.rows().where(~F.col("worktree").startswith(prefix)))
        return gone

    def faults(self) -> DataFrame:
        """(worktree, path, fault): paths that are in a worktree twice, or below something that is no directory."""
        own = self.rows().where("side <> 'key'")
        twice = own.groupBy("worktree", "side", "path").count().where("count > 1").select("worktree", "path", F.lit("twice").alias("fault"))
        up = own.select("worktree", "side", "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split("path", "/")) - 1)), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("up")).where("path LIKE '%/%'")
        below = up.join(own.where("mode <> '040000'").select("worktree", "side", F.col("path").alias("up")), ["worktree", "side", "up"], "left_semi").select("worktree", "path", F.lit("below no directory").alias("fault"))
        return twice.unionByName(below).distinct()


def changes_to_json(diff: DataFrame) -> DataFrame:
    """(path, record): each change with what was and what is."""
    side = lambda s: F.when(F.col(f"{s}_oid").isNotNull(), F.struct(F.col(f"{s}_kind").alias("kind"), F.col(f"{s}_mode").alias("mode"), F.col(f"{s}_oid").alias("oid")))
    return diff.select("path", F.to_json(F.struct("path", side("old").alias("previous"), side("new").alias("current"))).alias("record"))


def changes_from_json(records: DataFrame) -> DataFrame:
    """changes_to_json() undone: (path, change, previous, current)."""
    r = F.from_json("record", f"path string, previous {_SIDE}, current {_SIDE}")
    rows = records.select(r.alias("r")).select("r.path", "r.previous", "r.current")
    change = F.when(F.col("previous").isNull(), "create").when(F.col("current").isNull(), "remove").otherwise("update")
    return rows.select("path", change.alias("change"), "previous", "current")
