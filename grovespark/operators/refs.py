"""References: resolution, transactions as tables, shallow sets, views and composite sources.

Stores are tables; a store's write is a new table, so rollback is keeping the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovespark.errors import CircularReferenceError, RefNotFoundError, TransactionError
from grovespark.functions.names import is_ref_name, matches_glob
from grovespark.functions.oid import is_oid
from grovespark.storage import Scratch

_SYMBOLIC = "ref: "


def chain_ends(links: DataFrame) -> DataFrame:
    """(name, end): where links (name, at), one for each name, lead at last; null where they never end.
    Each round doubles the steps that a name has taken, so a chain of any length takes its logarithm of joins; who is still on the way
    after as many steps as there are links goes round in a circle."""
    scratch = Scratch(links.sparkSession)
    jump = scratch.keep(links.select("name", "at"))
    for _ in range(jump.count().bit_length() + 1):
        far = jump.select(F.col("name").alias("at"), F.col("at").alias("far"))
        jump = scratch.keep(jump.select("name", "at").join(far, "at", "left").select("name", F.coalesce("far", "at").alias("at"), F.col("far").isNotNull().alias("open")))
        if jump.where("open").isEmpty():
            return jump.select("name", F.col("at").alias("end"))
    return jump.select("name", F.when(~F.col("open"), F.col("at")).alias("end"))


def resolve(refs: DataFrame) -> DataFrame:
    """(name, symref, oid, error): refs (name, target) followed to an id. symref: the last name of a symbolic chain (null for a
    direct one); oid is null for a broken chain; error is 'circle' for one without an end."""
    value = F.trim(F.col("target"))
    table = refs.select("name", F.when(value.startswith(_SYMBOLIC), F.trim(F.substring(value, len(_SYMBOLIC) + 1, 4096))).alias("next"), F.when(is_oid(value), value).alias("value"))
    table = Scratch(refs.sparkSession).keep(table)
    none = F.lit(None).cast("string")
    direct = table.where("next IS NULL").select("name", none.alias("symref"), F.col("value").alias("oid"), none.alias("error"))
    ends = chain_ends(table.where("next IS NOT NULL").select("name", F.col("next").alias("at")))
    found = ends.join(table.select(F.col("name").alias("end"), "value"), "end", "left")
    return direct.unionByName(found.select("name", F.col("end").alias("symref"), F.col("value").alias("oid"), F.when(F.col("end").isNull(), "circle").alias("error")))


def resolve_one(refs: DataFrame, name: str) -> str | None:
    """The id that a name comes to; null for a broken chain or no such name; CircularReferenceError for a circle."""
    row = resolve(refs).where(F.col("name") == name).first()
    if row is not None and row["error"]:
        raise CircularReferenceError(name)
    return row["oid"] if row else None


def target_oid(refs: DataFrame, given: str | None = None) -> str:
    """What is given, or HEAD."""
    found = given or resolve_one(refs, "HEAD")
    if not found:
        raise RefNotFoundError("HEAD")
    return found


def current_refs(refs: DataFrame) -> DataFrame:
    """(name, oid) of every reference that comes to an id; broken ones are left out."""
    return resolve(refs).where("oid IS NOT NULL").select("name", "oid")


def peel(tags: DataFrame, start: DataFrame) -> DataFrame:
    """(oid, peeled): start (oid) followed through tags (oid, object) to what isn't a tag here. CircularReferenceError for tags
    that lead round to themselves."""
    ends = Scratch(tags.sparkSession).keep(chain_ends(tags.select(F.col("oid").alias("name"), F.col("object").alias("at")).distinct()).select(F.col("name").alias("oid"), "end"))
    rows = start.select("oid").distinct().join(ends, "oid", "left")
    if not ends.where("end IS NULL").join(start.select("oid"), "oid", "left_semi").isEmpty():
        raise CircularReferenceError("a chain of tags")
    return rows.select("oid", F.coalesce("end", "oid").alias("peeled"))


def with_peeled(refs: DataFrame, tags: DataFrame) -> DataFrame:
    """(name, oid, peeled): peeled is null where the reference doesn't point to a tag."""
    ends = peel(tags, refs.select("oid").where("oid IS NOT NULL"))
    return refs.join(ends, "oid", "left").select("name", "oid", F.when(F.col("peeled") != F.col("oid"), F.col("peeled")).alias("peeled"))


def state(log: DataFrame, as_of=None) -> DataFrame:
    """(name, oid): the last write of each name in a log (seq, ts, name, op, oid), unless a delete came later.
    as_of: a moment; later entries don't count. A partial maximum goes before the shuffle, so a busy name is no hot key."""
    rows = log if as_of is None else log.where(F.col("ts") <= F.lit(as_of))
    last = rows.groupBy("name").agg(F.max_by(F.struct("op", "oid"), "seq").alias("e"))
    return last.where("e.op = 'write'").select("name", F.col("e.oid").alias("oid"))


def state_at(log: DataFrame, moments: DataFrame) -> DataFrame:
    """moments (name, at) with the oid that the name had then: an as-of join as one window over both tables; null
    before the first write and after a delete."""
    both = log.select("name", F.col("ts").alias("at"), F.lit(0).alias("side"), "seq", F.struct("op", "oid").alias("e"))
    both = both.unionByName(moments.select("name", "at", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast(both.schema["e"].dataType).alias("e")))
    order = Window.partitionBy("name").orderBy("at", "side", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("e", F.last("e", ignorenulls=True).over(order)).where("side = 1")
    return seen.select("name", "at", F.when(F.col("e.op") == "write", F.col("e.oid")).alias("oid"))


def transaction(refs: DataFrame, ops: DataFrame) -> DataFrame:
    """refs (name, target) after ops (seq, op, name, target): the last of each name counts. TransactionError for a bad name
    or operation, before anything is computed."""
    bad = ops.where(~is_ref_name(F.col("name")) | ~F.col("op").isin("write", "delete")).first()
    if bad:
        raise TransactionError(f"{bad['op']} {bad['name']}")
    last = ops.groupBy("name").agg(F.max_by(F.struct("op", "target"), "seq").alias("o")).select("name", "o.*")
    kept = refs.join(last.select("name"), "name", "left_anti")
    return kept.select("name", "target").unionByName(last.where("op = 'write'").select("name", "target"))


def frozen(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(writes, deletes) of a transaction, for hooks."""
    last = ops.groupBy("name").agg(F.max_by(F.struct("op", "target"), "seq").alias("o")).select("name", "o.*")
    return last.where("op = 'write'").select("name", "target"), last.where("op = 'delete'").select("name")


def create_refs(refs: DataFrame, new: DataFrame) -> DataFrame:
    """Add new (name, target); TransactionError if one is there already."""
    there = new.join(refs, "name", "left_semi").first()
    if there:
        raise TransactionError(f"{there['name']} is there already")
    return refs.select("name", "target").unionByName(new.select("name", "target"))


def delete_branch(refs: DataFrame, name: str) -> DataFrame:
    """Without a branch; not the one that HEAD names."""
    head = refs.where("name = 'HEAD'").first()
    if head and head["target"] == f"{_SYMBOLIC}{name}":
        raise TransactionError(f"{name} is the current branch")
    if refs.where(F.col("name") == name).isEmpty():
        raise RefNotFoundError(name)
    return refs.where(F.col("name") != name)


def list_refs(refs: DataFrame, prefixes: list[str] | None = None, head: bool = True) -> DataFrame:
    """Refs under any of some prefixes, and HEAD; sorted by name. Prefixes are pushed down to the scan."""
    if prefixes:
        wanted = F.col("name") == "HEAD" if head else F.lit(False)
        for p in prefixes:
            wanted = wanted | F.col("name").startswith(p)
        refs = refs.where(wanted)
    return refs.orderBy("name")


def select_refs(refs: DataFrame, patterns: list[str]) -> DataFrame:
    """Refs that match any glob, each once, with the `ord` of the first pattern it matches."""
    first = F.coalesce(*[F.when(matches_glob(F.col("name"), p), F.lit(k)) for k, p in enumerate(patterns)])
    return refs.withColumn("ord", first).where("ord IS NOT NULL")


def exclude_refs(refs: DataFrame, pattern: str) -> DataFrame:
    return refs.where(~matches_glob(F.col("name"), pattern))


def union_refs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both, left's row where both have a name."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c not in ("name", "side")]
    return both.groupBy("name").agg(F.min_by(F.struct(*names), "side").alias("r")).select("name", "r.*")


def last_by_name(refs: DataFrame, position: str = "ord") -> DataFrame:
    """Of several rows of a name the last one."""
    names = [c for c in refs.columns if c != "name"]
    return refs.groupBy("name").agg(F.max_by(F.struct(*names), position).alias("r")).select("name", "r.*")


def loose_over_packed(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """A loose reference hides the packed one."""
    return union_refs(loose.select("name", "target"), packed.select("name", "target"))


def composite(sources: list[DataFrame], key: str = "oid") -> DataFrame:
    """Objects of several stores, each from the first that has it."""
    both = None
    for k, df in enumerate(sources):
        part = df.withColumn("__source", F.lit(k))
        both = part if both is None else both.unionByName(part)
    names = [c for c in sources[0].columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*names), "__source").alias("o")).select(key, "o.*") if names else both.select(key).distinct()


def ingest(objects: DataFrame, new: DataFrame) -> DataFrame:
    """objects with those of new (the same columns) that aren't there; a store never holds an id twice."""
    fresh = new.dropDuplicates(["oid"]).join(objects.select("oid"), "oid", "left_anti")
    return objects.unionByName(fresh.select(objects.columns))


def delete_objects(objects: DataFrame, gone: DataFrame) -> DataFrame:
    return objects.join(gone.select("oid"), "oid", "left_anti")


def shallow_update(shallow: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """(S - remove) + add."""
    return shallow.select("oid").join(remove.select("oid"), "oid", "left_anti").union(add.select("oid")).distinct()


def push_boundaries(shallow: DataFrame, tips: DataFrame) -> DataFrame:
    """Shallow ids and remote tips together."""
    return shallow.select("oid").union(tips.select("oid")).distinct()


def common_prefix(names: DataFrame) -> str:
    """What all names begin with, up to the last slash: the smallest and the largest tell."""
    row = names.agg(F.min("name").alias("a"), F.max("name").alias("z")).first()
    if row["a"] is None:
        return ""
    n = 0
    while n < min(len(row["a"]), len(row["z"])) and row["a"][n] == row["z"][n]:
        n += 1
    return row["a"][:n][: row["a"][:n].rfind("/") + 1]


def advertised(refs: DataFrame, tags: DataFrame, head: str | None = None) -> DataFrame:
    """(name, oid, peeled, symref_target): what a server lists; HEAD with the branch it names."""
    rows = with_peeled(resolve(refs).where("oid IS NOT NULL").select("name", "oid"), tags)
    links = resolve(refs).select("name", F.col("symref").alias("symref_target"))
    return rows.join(links, "name", "left").orderBy("name")


def default_branch(remote: DataFrame) -> str | None:
    """The branch that HEAD names; else the one (main first, then by name) with HEAD's id."""
    head = remote.where("name = 'HEAD'").first()
    if head is None:
        return None
    if head["symref_target"]:
        return head["symref_target"]
    same = remote.where(F.col("name").startswith("refs/heads/") & (F.col("oid") == head["oid"]))
    row = same.orderBy(F.col("name") != "refs/heads/main", "name").first()
    return row["name"] if row else None


def empty_refs(spark: SparkSession, branch: str = "refs/heads/main") -> DataFrame:
    """A new repository's refs: HEAD alone."""
    return spark.createDataFrame([("HEAD", f"{_SYMBOLIC}{branch}")], "name string, target string")
