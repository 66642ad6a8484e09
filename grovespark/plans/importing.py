"""Import planning: which local references a set of actions on remote views would write, as tables.

A view is a table of remote refs (name, oid, peeled, symref_target). Actions are stated on the driver (they are few); what
they do to refs is joins. preview() gives tables: mappings, conflicts, ref_operations, prune_operations,
diagnostics, preconditions; apply() rechecks the preconditions and makes the new refs table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.errors import PreconditionError
from grovespark.functions.names import glob_regex, matches_glob
from grovespark.operators import graph, refs as R
from grovespark.operators.refs import common_prefix
from grovespark.schema import HEADS, TAGS_PREFIX

FAST_FORWARD, CREATE_ONLY, MIRROR = "fast-forward", "create-only", "mirror"
_REMOTE = ("name", "oid", "peeled", "symref_target")


def same_remote(a: str, b: str):
    """All four fields of two remote refs equal, null to null."""
    out = F.lit(True)
    for c in _REMOTE:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


class View:
    """A remote view; every method gives a new one."""

    def __init__(self, refs: DataFrame, label: str | None = None):
        for c in _REMOTE:
            if c not in refs.columns:
                refs = refs.withColumn(c, F.lit(None).cast("string"))
        self.refs, self.label = refs.select(*_REMOTE), label

    def named(self, label: str) -> View:
        return View(self.refs, label)

    def where(self, predicate) -> View:
        return View(self.refs.where(predicate), self.label)

    def select(self, *patterns: str) -> View:
        return View(R.select_refs(self.refs, list(patterns)).drop("ord"), self.label)

    def exclude(self, pattern: str) -> View:
        return View(R.exclude_refs(self.refs, pattern), self.label)

    def union(self, other: View) -> View:
        return View(R.union_refs(self.refs, other.refs).select(*_REMOTE), self.label)

    def default_branch(self) -> View:
        name = R.default_branch(self.refs)
        return View(self.refs.where(F.col("name") == name if name else F.lit(False)), self.label)

    def head_target(self) -> View:
        return View(self.refs.where("name = 'HEAD'"), self.label)


def namespace_targets(view: View, target: str) -> DataFrame:
    """The view's refs with local_ref: what follows the names' common prefix stands for the target's *."""
    if "*" not in target:
        return view.refs.withColumn("local_ref", F.lit(target))
    before, after = target.split("*", 1)[0], target.split("*")[1]
    n = len(common_prefix(view.refs))
    return view.refs.withColumn("local_ref", F.concat(F.lit(before), F.substring(F.col("name"), F.lit(n + 1), F.length("name")), F.lit(after)))


@dataclass(frozen=True)
class Action:
    kind: str  # namespace, branch, tag, head
    view: View
    target: str = ""
    policy: str | None = None
    prune: bool = False
    detach: bool = False


@dataclass(frozen=True)
class Plan:
    """Actions in order; every addition gives a new plan."""

    spark: SparkSession
    actions: tuple[Action, ...] = ()

    def _add(self, action: Action) -> Plan:
        return replace(self, actions=(*self.actions, action))

    def to_namespace(self, view: View, target: str, policy: str | None = None, prune: bool = False) -> Plan:
        return self._add(Action("namespace", view, target, policy, prune))

    def to_branch(self, view: View, name: str, policy: str = FAST_FORWARD) -> Plan:
        return self._add(Action("branch", view, name if name.startswith(HEADS) else HEADS + name, policy))

    def to_tag(self, view: View, name: str, policy: str = CREATE_ONLY) -> Plan:
        return self._add(Action("tag", view, name if name.startswith(TAGS_PREFIX) else TAGS_PREFIX + name, policy))

    def set_head(self, view: View, detach: bool = False) -> Plan:
        return self._add(Action("head", view, detach=detach))


def default_policy(target: str) -> str | None:
    """For a namespace: branches move forward, tags are made once, anything else has to be told."""
    return FAST_FORWARD if target.startswith(HEADS) else CREATE_ONLY if target.startswith(TAGS_PREFIX) else None


@dataclass
class Preview:
    mappings: DataFrame  # seq, name, oid, local_ref, policy, label, conflict
    missing_roots: DataFrame  # oid
    ref_operations: DataFrame  # local_ref, new_oid, policy, label
    prune_operations: DataFrame  # name, pattern
    head: tuple[str, bool] | None  # local_ref, detached
    preconditions: DataFrame  # name, target, pattern
    diagnostics: DataFrame  # level, message, ref_name
    can_apply: bool = False
    notes: list = field(default_factory=list)


_MAPPED = "seq int, name string, oid string, peeled string, symref_target string, local_ref string, policy string, label string"


def preview(plan: Plan, refs: DataFrame, objects: DataFrame, edges: DataFrame, tags: DataFrame | None = None) -> Preview:
    """What plan would do to refs (name, target). objects: oid, type; edges: of commits; tags: oid, object."""
    spark, notes, pruned = plan.spark, [], {}
    say = lambda level, text, ref=None: notes.append((level, text, ref))
    mapped = spark.createDataFrame([], _MAPPED)
    head_wish: tuple[str, bool] | None = None
    for seq, act in enumerate(plan.actions):
        label, policy = act.view.label, act.policy
        one = act.view.refs
        if act.kind == "namespace":
            if policy is None:
                policy = default_policy(act.target)
                if policy is None:
                    say("error", f"{act.target}: a policy has to be told")
                    continue
                say("info", f"{act.target}: {policy}")
            if act.prune and "*" not in act.target:
                say("error", f"{act.target}: only a pattern with * can be pruned")
                continue
            rows = namespace_targets(act.view, act.target)
            if "*" in act.target:
                pruned[act.target] = pruned.get(act.target, False) or act.prune
        else:
            few = [r.asDict() for r in one.limit(2).collect()]
            if len(few) != 1:
                say("error" if few else "warn", f"{act.kind} {act.target}: the view has {'more than one ref' if few else 'no ref'}")
                continue
            if act.kind == "head":
                wish = spark.createDataFrame([few[0]], "name string, oid string, peeled string, symref_target string")
                last = mapped.alias("m").join(F.broadcast(wish.alias("w")), same_remote("m", "w")).agg(F.max_by("m.local_ref", "m.seq").alias("r")).first()["r"]
                if last is None:
                    say("warn", f"HEAD: {few[0]['name']} is mapped by no action before")
                elif not last.startswith(HEADS):
                    say("error", "HEAD can name a branch only", last)
                else:
                    head_wish = (last, act.detach)
                continue
            rows = one.withColumn("local_ref", F.lit(act.target))
        mapped = mapped.unionByName(rows.select(F.lit(seq).alias("seq"), *_REMOTE, "local_ref", F.lit(policy).alias("policy"), F.lit(label).cast("string").alias("label")))
    counts = mapped.groupBy("local_ref").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names"))
    conflicts = counts.where("n > 1")
    mappings = mapped.join(conflicts.select("local_ref", F.lit(True).alias("c")), "local_ref", "left").withColumn("conflict", F.coalesce("c", F.lit(False))).drop("c")
    found = finalize(mappings.where("NOT conflict"), refs, objects, edges, tags)
    judged = found["judged"]
    messages = conflicts.select(F.lit("error").alias("level"), F.concat(F.lit("written by several actions: "), F.array_join("names", ", ")).alias("message"), F.col("local_ref").alias("ref_name"))
    messages = messages.unionByName(judged.select(F.when(F.col("verdict").isin("update", "create", "same", "overwrite"), "info").otherwise("error").alias("level"), F.col("verdict").alias("message"), F.col("local_ref").alias("ref_name")))
    prune = None
    for pattern, wanted in pruned.items():
        if wanted:
            stale = refs.where(matches_glob(F.col("name"), pattern)).select("name").join(mapped.select(F.col("local_ref").alias("name")), "name", "left_anti").withColumn("pattern", F.lit(pattern))
            prune = stale if prune is None else prune.unionByName(stale.join(prune.select("name"), "name", "left_anti"))
    prune = prune if prune is not None else spark.createDataFrame([], "name string, pattern string")
    head = None
    if head_wish:
        ok = judged.where((F.col("local_ref") == head_wish[0]) & F.col("verdict").isin("update", "create", "same", "overwrite"))
        if ok.isEmpty():
            say("error", "HEAD: its branch isn't written", head_wish[0])
        else:
            head = head_wish
    touched = mapped.select(F.col("local_ref").alias("name")).distinct()
    if head_wish:
        touched = touched.union(spark.createDataFrame([("HEAD",)], "name string")).distinct()
    state = touched.join(refs.select("name", "target"), "name", "left").select("name", "target", F.lit(None).cast("string").alias("pattern"))
    for pattern, wanted in pruned.items():
        if wanted:
            state = state.unionByName(refs.where(matches_glob(F.col("name"), pattern)).select("name", "target", F.lit(pattern).alias("pattern")))
    every = messages.unionByName(spark.createDataFrame(notes, "level string, message string, ref_name string"))
    return Preview(mappings, found["missing"], found["operations"], prune, head, state, every, every.where("level = 'error'").isEmpty(), notes)


def finalize(mappings: DataFrame, refs: DataFrame, objects: DataFrame, edges: DataFrame, tags: DataFrame | None = None) -> dict[str, DataFrame]:
    """Policies as one expression. judged: mappings with new_oid, old_oid and a verdict (create, update, overwrite, same,
    or why not); operations: what is written; missing: roots that objects hasn't got."""
    types = objects.select(F.col("oid").alias("o"), F.col("type").alias("t"))
    rows = mappings.join(types.withColumnRenamed("t", "own_type"), F.col("oid") == F.col("o"), "left").drop("o")
    branch = F.col("local_ref").startswith(HEADS)
    if tags is not None:
        ends = R.peel(tags, mappings.select("oid").distinct()).select(F.col("oid").alias("o"), F.col("peeled").alias("end"))
        rows = rows.join(ends, F.col("oid") == F.col("o"), "left").drop("o")
    else:
        rows = rows.withColumn("end", F.col("oid"))
    rows = rows.withColumn("new_oid", F.when(branch, F.col("end")).otherwise(F.col("oid")))
    rows = rows.join(types.withColumnRenamed("t", "new_type"), F.col("new_oid") == F.col("o"), "left").drop("o")
    current = R.resolve(refs).select(F.col("name").alias("local_ref"), F.col("oid").alias("old_oid"), F.lit(True).alias("exists"))
    rows = rows.join(current, "local_ref", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    pairs = rows.where("exists AND old_oid IS NOT NULL AND new_oid IS NOT NULL AND old_oid <> new_oid").select(F.col("old_oid").alias("old"), F.col("new_oid").alias("new")).distinct()
    forward = graph.is_ancestor(edges, pairs).select(F.col("old").alias("old_oid"), F.col("new").alias("new_oid"), "ancestor")
    rows = rows.join(forward, ["old_oid", "new_oid"], "left")
    verdict = (
        F.when(F.col("own_type").isNull(), "the object isn't there")
        .when(branch & ~F.col("new_type").eqNullSafe(F.lit("commit")), "a branch has to be a commit")
        .when(F.col("old_oid").eqNullSafe(F.col("new_oid")), "same")
        .when(~F.col("exists"), "create")
        .when(F.col("policy") == CREATE_ONLY, "it is there already")
        .when(F.col("policy") == MIRROR, "overwrite")
        .when(F.col("old_oid").isNull(), "it can't be compared")
        .when(F.coalesce("ancestor", F.lit(False)), "update")
        .otherwise("no fast-forward")
    )
    judged = rows.withColumn("verdict", verdict)
    operations = judged.where(F.col("verdict").isin("create", "update", "overwrite")).select("local_ref", "new_oid", "policy", "label")
    missing = mappings.select("oid").distinct().join(objects.select("oid"), "oid", "left_anti")
    return {"judged": judged.select("seq", "name", "local_ref", "policy", "old_oid", "new_oid", "verdict"), "operations": operations, "missing": missing}


def changed_preconditions(expected: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows of a preview's preconditions that no longer hold: (name, expected, actual). New refs under a pruned pattern count."""
    now = refs.select("name", F.col("target").alias("actual"))
    rows = expected.select("name", F.col("target").alias("expected")).distinct().join(now, "name", "left").where(~F.col("expected").eqNullSafe(F.col("actual")))
    for (pattern,) in [tuple(r) for r in expected.where("pattern IS NOT NULL").select("pattern").distinct().collect()]:
        new = now.where(F.col("name").rlike(glob_regex(pattern))).join(expected.select("name"), "name", "left_anti")
        rows = rows.unionByName(new.select("name", F.lit(None).cast("string").alias("expected"), "actual"))
    return rows


def apply(found: Preview, refs: DataFrame) -> DataFrame:
    """The new refs (name, target). PreconditionError if the preview has an error or refs has changed since."""
    if not found.can_apply:
        raise PreconditionError("; ".join(r["message"] for r in found.diagnostics.where("level = 'error'").limit(5).collect()))
    bad = changed_preconditions(found.preconditions, refs).first()
    if bad:
        raise PreconditionError(f"{bad['name']} has changed")
    writes = found.ref_operations.select(F.col("local_ref").alias("name"), F.col("new_oid").alias("target"))
    if found.head:
        ref, detached = found.head
        at = writes.unionByName(refs.select("name", "target")).where(F.col("name") == ref).limit(1)
        value = F.col("target") if detached else F.lit(f"ref: {ref}")
        writes = writes.unionByName(at.select(F.lit("HEAD").alias("name"), value.alias("target")))
    gone = found.prune_operations.select("name").union(writes.select("name"))
    return refs.select("name", "target").join(gone, "name", "left_anti").unionByName(writes)


def apply_updates(updates: DataFrame, refs: DataFrame, objects: DataFrame, edges: DataFrame, tags: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fetched updates (local_ref, remote_oid, current_oid, force): (new refs, rejected with a reason). Forced ones skip the checks
    of tags and fast-forwards; a branch is peeled to a commit."""
    branch, tag = F.col("local_ref").startswith(HEADS), F.col("local_ref").startswith(TAGS_PREFIX)
    rows = updates.withColumn("oid", F.col("remote_oid"))
    if tags is not None:
        ends = R.peel(tags, rows.select("oid").distinct())
        rows = rows.join(ends, "oid", "left")
    else:
        rows = rows.withColumn("peeled", F.col("oid"))
    rows = rows.withColumn("new_oid", F.when(branch, F.col("peeled")).otherwise(F.col("oid")))
    there = objects.select(F.col("oid").alias("o"), F.col("type").alias("t"))
    rows = rows.join(there, F.col("new_oid") == F.col("o"), "left")
    pairs = rows.where("NOT force AND current_oid IS NOT NULL").select(F.col("current_oid").alias("old"), F.col("new_oid").alias("new")).distinct()
    forward = graph.is_ancestor(edges, pairs).select(F.col("old").alias("current_oid"), F.col("new").alias("new_oid"), "ancestor")
    rows = rows.join(forward, ["current_oid", "new_oid"], "left")
    held = ~F.col("force") & F.col("current_oid").isNotNull()
    reason = (
        F.when(F.col("o").isNull(), "the object isn't there")
        .when(branch & (F.col("t") != "commit"), "a branch has to be a commit")
        .when(held & tag, "the tag is there already")
        .when(held & branch & ~F.coalesce("ancestor", F.lit(False)), "no fast-forward")
    )
    rows = rows.withColumn("reason", reason)
    writes = rows.where("reason IS NULL").select(F.col("local_ref").alias("name"), F.col("new_oid").alias("target"))
    new = refs.select("name", "target").join(writes.select("name"), "name", "left_anti").unionByName(writes)
    return new, rows.where("reason IS NOT NULL").select("local_ref", "reason")
