"""Paths, modes and kinds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_path(path: Column) -> Column:
    """Empty for what lies at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_path(parent: Column, name: Column) -> Column:
    return F.when(F.coalesce(parent, F.lit("")) == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def depth(path: Column) -> Column:
    """Slashes in it: 0 at the top."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def ancestors(path: Column) -> Column:
    """Every directory above, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def path_error(path: Column) -> Column:
    """Why a path isn't one, or null: empty, a slash at an end or two in a row, a dot segment, a NUL."""
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.startswith("/") | path.endswith("/"), "a slash at an end")
        .when(path.contains("//"), "an empty segment")
        .when(path.rlike(r"(^|/)\.\.?(/|$)"), "a dot segment")
        .when(path.contains("\0"), "a NUL")
    )


def is_path(path: Column) -> Column:
    return path_error(path).isNull()


def directory_path(path: Column) -> Column:
    """Null is the root."""
    return F.coalesce(path, F.lit(""))


def canonical_mode(mode: Column) -> Column:
    """As tables hold it."""
    return F.when(mode == "40000", "040000").otherwise(mode)


def disk_mode(mode: Column) -> Column:
    """As tree bodies hold it."""
    return F.when(mode == "040000", "40000").otherwise(mode)


def kind(mode: Column) -> Column:
    """tree, blob or link; an error for what a snapshot can't hold (submodules among it)."""
    return lenient_kind(mode, F.raise_error(F.concat(F.lit("no snapshot kind for mode "), F.coalesce(mode, F.lit("null")))))


def lenient_kind(mode: Column, otherwise: Column | None = None) -> Column:
    """As kind(), with plain files for unknown modes."""
    return F.when(mode.isin("040000", "40000"), "tree").when(mode == "120000", "symlink").when(mode.isin("100644", "100755"), "blob").otherwise(F.lit("blob") if otherwise is None else otherwise)


def origin_mode(mode: Column) -> Column:
    """The mode that a worktree takes for a tree entry: unknown ones are plain files."""
    return F.when(mode.isin("040000", "100644", "100755", "120000"), mode).when(mode == "40000", "040000").otherwise("100644")


def is_blob_mode(mode: Column) -> Column:
    return mode.isin("100644", "100755")


def is_delta_type(number: Column) -> Column:
    return number.isin(6, 7)


def type_number(kind: Column) -> Column:
    return F.when(kind == "commit", 1).when(kind == "tree", 2).when(kind == "blob", 3).when(kind == "tag", 4)


def number_type(number: Column) -> Column:
    return F.when(number == 1, "commit").when(number == 2, "tree").when(number == 3, "blob").when(number == 4, "tag")
