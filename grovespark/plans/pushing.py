"""Push planning and its server side: what to send where, which updates hold, what the report says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.errors import ProtocolError, PushError
from grovespark.functions.names import RefSpec
from grovespark.operators import graph, refs as R
from grovespark.schema import HEADS, TAGS_PREFIX, ZERO_OID


def default_spec(refs: DataFrame) -> RefSpec:
    """HEAD to the branch it names; PushError for a detached HEAD."""
    head = R.resolve(refs).where("name = 'HEAD'").first()
    if head is None or head["symref"] is None:
        raise PushError("HEAD names no branch")
    if not head["symref"].startswith(HEADS):
        raise PushError(f"{head['symref']} is no branch")
    return RefSpec.parse(f"HEAD:{head['symref']}")


def spec_table(spark: SparkSession, specs: list[RefSpec], force: bool | None = None) -> DataFrame:
    rows = [(k, s.force if force is None else force, s.source, s.target, s.wildcard) for k, s in enumerate(specs)]
    return spark.createDataFrame(rows, "spec int, force boolean, source string, spec_target string, wildcard boolean")


def plan_refs(local: DataFrame, remote: DataFrame, specs: list[RefSpec], force: bool | None = None, strict: bool = True) -> DataFrame:
    """(spec, local_ref, remote_ref, local_oid, remote_oid, force, conflict) for local and remote refs (name, oid).
    The specs are a handful of rows, so the theta join broadcasts them. A spec without a source deletes. strict: PushError
    for two mappings to one remote ref, a named local ref that isn't there, or wildcards that match nothing at all."""
    spark = local.sparkSession
    table = spec_table(spark, specs, force)
    match = F.when(F.col("wildcard"), F.expr("startswith(name, source)")).otherwise(F.col("name") == F.col("source"))
    kept = local.join(F.broadcast(table.where("source <> '' OR wildcard")), match)
    target = F.when(F.col("wildcard"), F.concat("spec_target", F.substring(F.col("name"), F.length("source") + 1, F.length("name")))).otherwise(F.col("spec_target"))
    rows = kept.select("spec", F.col("name").alias("local_ref"), target.alias("remote_ref"), F.col("oid").alias("local_oid"), "force")
    gone = table.where("source = '' AND NOT wildcard").select("spec", F.lit("").alias("local_ref"), F.col("spec_target").alias("remote_ref"), F.lit(None).cast("string").alias("local_oid"), "force")
    rows = rows.unionByName(gone)
    many = rows.groupBy("remote_ref").agg((F.count("*") > 1).alias("conflict"))
    out = rows.join(many, "remote_ref").join(remote.select(F.col("name").alias("remote_ref"), F.col("oid").alias("remote_oid")), "remote_ref", "left")
    out = out.select("spec", "local_ref", "remote_ref", "local_oid", "remote_oid", "force", "conflict")
    if strict:
        bad = out.where("conflict").first()
        if bad:
            raise PushError(f"{bad['remote_ref']} is mapped twice")
        absent = table.where("source <> '' AND NOT wildcard").join(local.select(F.col("name").alias("source")), "source", "left_anti").first()
        if absent:
            raise PushError(f"{absent['source']} isn't there")
        if any(s.wildcard for s in specs) and out.isEmpty():
            raise PushError("no local ref matches")
    return out


def check_fast_forward(items: DataFrame, objects: DataFrame, edges: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """items with `reason`: why the remote may not be moved, or null. Creating, deleting, forcing and what is the same are safe;
    a tag is never replaced; both ends have to be commits; the remote has to be an ancestor."""
    rows = items
    for side in ("remote", "local"):
        if tags is not None:
            ends = R.peel(tags, rows.select(F.col(f"{side}_oid").alias("oid")).where("oid IS NOT NULL").distinct())
            rows = rows.join(ends.select(F.col("oid").alias(f"{side}_oid"), F.col("peeled").alias(f"{side}_end")), f"{side}_oid", "left")
        else:
            rows = rows.withColumn(f"{side}_end", F.col(f"{side}_oid"))
        rows = rows.join(objects.select(F.col("oid").alias(f"{side}_end"), F.col("type").alias(f"{side}_type")), f"{side}_end", "left")
    pairs = rows.where("local_end IS NOT NULL AND remote_end IS NOT NULL").select(F.col("remote_end").alias("old"), F.col("local_end").alias("new")).distinct()
    forward = graph.is_ancestor(edges, pairs).select(F.col("old").alias("remote_end"), F.col("new").alias("local_end"), "ancestor")
    rows = rows.join(forward, ["remote_end", "local_end"], "left")
    other = lambda side: F.coalesce(F.col(f"{side}_type") != "commit", F.lit(False))
    reason = (
        F.when(F.col("local_oid").isNull() | F.col("remote_oid").isNull() | F.col("force") | F.col("local_oid").eqNullSafe(F.col("remote_oid")), None)
        .when(F.col("remote_ref").startswith(TAGS_PREFIX), "a tag isn't replaced")
        .when(other("remote"), "the remote is no commit")
        .when(other("local"), "the local one is no commit")
        .when(~F.coalesce("ancestor", F.lit(False)), "no fast-forward")
    )
    return rows.select(*items.columns, reason.alias("reason"))


def commands(items: DataFrame) -> DataFrame:
    """(old_oid, new_oid, ref); the zero id stands for nothing."""
    return items.select(F.coalesce("remote_oid", F.lit(ZERO_OID)).alias("old_oid"), F.coalesce("local_oid", F.lit(ZERO_OID)).alias("new_oid"), F.col("remote_ref").alias("ref"))


def objects_to_send(edges: DataFrame, items: DataFrame, remote: DataFrame, shallow: DataFrame | None = None) -> DataFrame:
    """(oid): what the pushed tips reach and the remote's don't."""
    wants = items.where("local_oid IS NOT NULL").select(F.col("local_oid").alias("oid"))
    return graph.to_send(edges, wants, remote.select("oid"), shallow)


def validate_capabilities(items: DataFrame, capabilities: list[str]) -> None:
    """The server has to report, and to know how to delete where something is deleted."""
    if "report-status" not in capabilities:
        raise PushError("the server reports no status")
    if "delete-refs" not in capabilities and not items.where("local_oid IS NULL").isEmpty():
        raise PushError("the server deletes no refs")


def shared_capabilities(wanted: list[str], offered: list[str]) -> list[str]:
    """Those of both, in the server's order."""
    return [c for c in offered if c in set(wanted)]


def check_updates(sent: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """The server's compare-and-set: commands (old_oid, new_oid, ref) with `error`, null where they hold. It doesn't look at
    fast-forwards; tags are made and deleted but not replaced."""
    now = R.resolve(refs).select(F.col("name").alias("ref"), F.col("oid").alias("current"))
    there = objects.select(F.col("oid").alias("new_oid"), F.lit(True).alias("there"))
    rows = sent.join(now, "ref", "left").join(there.distinct(), "new_oid", "left")
    create, delete, has = F.col("old_oid") == ZERO_OID, F.col("new_oid") == ZERO_OID, F.coalesce("there", F.lit(False))
    error = (
        F.when(create & F.col("current").isNotNull(), "it is there already")
        .when(create & ~has, "the object isn't there")
        .when(create, None)
        .when(F.col("current").isNull(), "it isn't there")
        .when(F.col("current") != F.col("old_oid"), "it has another value")
        .when(delete, None)
        .when(~has, "the object isn't there")
        .when(F.col("ref").startswith(TAGS_PREFIX), "a tag isn't replaced")
    )
    return rows.select("ref", "old_oid", "new_oid", error.alias("error"))


def apply_commands(checked: DataFrame, refs: DataFrame, atomic: bool = False) -> DataFrame:
    """refs after the commands that hold; atomic: after all of them or none."""
    if atomic and not checked.where("error IS NOT NULL").isEmpty():
        return refs
    good = checked.where("error IS NULL")
    writes = good.where(F.col("new_oid") != ZERO_OID).select(F.col("ref").alias("name"), F.col("new_oid").alias("target"))
    return refs.select("name", "target").join(good.select(F.col("ref").alias("name")), "name", "left_anti").unionByName(writes)


def report(sent: DataFrame, statuses: DataFrame) -> DataFrame:
    """Commands with the server's status (ref, ok, message). ProtocolError where the two sets of refs differ."""
    both = sent.join(statuses, "ref", "full")
    bad = both.where("old_oid IS NULL OR ok IS NULL").first()
    if bad or statuses.count() != sent.count():
        raise ProtocolError(f"a status for {bad['ref'] if bad else 'some ref'} is missing or too many")
    return both
