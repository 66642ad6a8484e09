"""Records of a worktree's nodes as column expressions: ids, origins, directory overlays, and whether a node was changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record forms.
ORIGIN_KINDS = "none", "repo-tree", "repo-blob"
ORIGIN_MODES = "100644", "100755", "120000"
OVERLAY = "STRUCT<addedEntries: ARRAY<ARRAY<STRING>>, deletedNames: ARRAY<STRING>>"
_ID_PREFIX = "origin-path:"


def path_node_id(path: Column) -> Column:
    """The id of the node that a base path has; two paths of one object are two nodes. The root's path is empty or null."""
    named = F.coalesce(path, F.lit(""))
    return F.concat(F.lit(_ID_PREFIX), F.when(named == "", "/").otherwise(named))


def new_node_id(path: Column, seq: Column) -> Column:
    """The id of a node that an operation made: by its place and the operation's number, so that a task run again gives the same."""
    return F.concat(F.lit("node:"), F.substring(F.sha2(F.concat_ws("\n", path, seq.cast("string")), 256), 1, 32))


def origin_error(kind: Column, oid: Column, mode: Column) -> Column:
    """Why three columns are no origin, or null."""
    return (
        F.when(kind.isNull() | ~kind.isin(*ORIGIN_KINDS), "an unknown kind")
        .when((kind != "none") & (F.coalesce(oid, F.lit("")) == ""), "no id")
        .when((kind == "repo-blob") & ~F.coalesce(mode.isin(*ORIGIN_MODES), F.lit(False)), "an unknown mode")
    )


def origin(kind: Column, oid: Column, mode: Column) -> Column:
    """struct(kind, oid, mode) of three columns, without what its kind doesn't have; null for what is no origin."""
    made = F.struct(kind.alias("kind"), F.when(kind != "none", oid).alias("oid"), F.when(kind == "repo-blob", mode).alias("mode"))
    return F.when(origin_error(kind, oid, mode).isNull(), made)


def origin_of_json(record: Column) -> Column:
    """origin() of a JSON record {kind, hash, mode}."""
    r = F.from_json(record, "kind STRING, hash STRING, mode STRING")
    return origin(r["kind"], r["hash"], r["mode"])


def origin_to_json(o: Column) -> Column:
    return F.to_json(F.struct(o["kind"].alias("kind"), o["mode"].alias("mode"), o["oid"].alias("hash")))


def overlay_to_json(added: Column, deleted: Column) -> Column:
    """A directory's overlay: added (a map of names to node ids) and deleted names, in the order of names."""
    pairs = F.transform(F.array_sort(F.map_entries(added)), lambda e: F.array(e["key"], e["value"]))
    return F.to_json(F.struct(pairs.alias("addedEntries"), F.array_sort(deleted).alias("deletedNames")))


def overlay_of_json(text: Column) -> Column:
    """struct(added, deleted) of overlay_to_json(); empty for null, and null for what is no overlay."""
    raw = F.from_json(F.coalesce(text, F.lit('{"addedEntries":[],"deletedNames":[]}')), OVERLAY)
    added, deleted = raw["addedEntries"], raw["deletedNames"]
    good = added.isNotNull() & deleted.isNotNull() & F.forall(added, lambda e: F.size(e) == 2) & F.forall(deleted, lambda n: n.isNotNull())
    return F.when(good, F.struct(F.map_from_entries(F.transform(added, lambda e: F.struct(e[0], e[1]))).alias("added"), deleted.alias("deleted")))


def overlay_is_dirty(added: Column, deleted: Column) -> Column:
    return (F.size(added) > 0) | (F.size(deleted) > 0)


def is_materialised(content: Column) -> Column:
    """Whether a file or link has content of its own, an empty one too."""
    return content.isNotNull()


def is_dirty(kind: Column, added: Column, deleted: Column, content: Column) -> Column:
    """Whether a node was changed: a directory's entries, a file's or link's content."""
    return F.when(kind == "tree", F.coalesce(overlay_is_dirty(added, deleted), F.lit(False))).otherwise(is_materialised(content))


def change_side(kind: Column, mode: Column, oid: Column) -> Column:
    """One side of a change record kept in columns: nothing there if any of the three is null."""
    return F.when(kind.isNotNull() & mode.isNotNull() & oid.isNotNull(), F.struct(kind.alias("kind"), mode.alias("mode"), oid.alias("oid")))
