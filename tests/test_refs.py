import pytest
from pyspark.sql import functions as F

from grovespark.errors import CircularReferenceError, PreconditionError, ProtocolError, PushError, RefNotFoundError, TransactionError
from grovespark.functions.names import RefSpec
from grovespark.operators import refs as R
from grovespark.plans import importing as I
from grovespark.plans import pushing as P
from grovespark.schema import ZERO_OID
from tests.conftest import rows

A, B, C, D = "a" * 40, "b" * 40, "c" * 40, "d" * 40


def refs(spark, **items):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in items.items()], "name string, target string")


def named(spark, *items):
    return spark.createDataFrame(list(items), "name string, oid string")


def test_resolve(spark):
    r = refs(spark, HEAD="ref: refs/heads/main", refs__heads__main=A, refs__heads__b="ref: refs/heads/gone", x="ref: y", y="ref: x", z="ref: HEAD")
    got = {n: (s, o, e) for n, s, o, e in rows(R.resolve(r))}
    assert got["HEAD"] == ("refs/heads/main", A, None) and got["refs/heads/main"] == (None, A, None) and got["z"] == ("refs/heads/main", A, None)
    assert got["refs/heads/b"] == ("refs/heads/gone", None, None) and got["x"][2] == got["y"][2] == "circle"
    assert R.resolve_one(r, "HEAD") == A and R.resolve_one(r, "no") is None and R.target_oid(r) == A
    with pytest.raises(CircularReferenceError):
        R.resolve_one(r, "x")
    with pytest.raises(RefNotFoundError):
        R.target_oid(r.where("name = 'x'"))


def test_peel(spark):
    tags = spark.createDataFrame([(A, B), (B, C)], "oid string, object string")
    start = spark.createDataFrame([(A,), (C,), (D,)], "oid string")
    assert rows(R.peel(tags, start)) == [(A, C), (C, C), (D, D)]
    assert rows(R.with_peeled(named(spark, ("t", A), ("h", C)), tags)) == [("h", C, None), ("t", A, C)]


def test_transactions(spark):
    r = refs(spark, refs__heads__a=A, refs__heads__b=B)
    ops = spark.createDataFrame([(0, "write", "refs/heads/a", C), (1, "delete", "refs/heads/a", None), (2, "write", "refs/heads/n", D), (3, "delete", "refs/heads/zz", None)], "seq int, op string, name string, target string")
    assert rows(R.transaction(r, ops)) == [("refs/heads/b", B), ("refs/heads/n", D)]
    assert rows(r) == [("refs/heads/a", A), ("refs/heads/b", B)], "the old table is the rollback"
    writes, deletes = R.frozen(ops)
    assert rows(writes) == [("refs/heads/n", D)] and rows(deletes) == [("refs/heads/a",), ("refs/heads/zz",)]
    with pytest.raises(TransactionError):
        R.transaction(r, ops.withColumn("name", F.lit("bad name")))
    with pytest.raises(TransactionError):
        R.create_refs(r, r.limit(1))
    with pytest.raises(TransactionError):
        R.delete_branch(refs(spark, HEAD="ref: refs/heads/a", refs__heads__a=A), "refs/heads/a")
    assert rows(R.delete_branch(r, "refs/heads/a")) == [("refs/heads/b", B)]


def test_views_and_stores(spark):
    r = named(spark, ("refs/heads/a", A), ("refs/heads/b", B), ("refs/tags/v", C))
    assert rows(R.select_refs(r, ["*/b", "refs/heads/*"])) == [("refs/heads/a", A, 1), ("refs/heads/b", B, 0)]
    assert rows(R.union_refs(r, named(spark, ("refs/heads/a", D), ("n", D)))) == [("n", D), ("refs/heads/a", A), ("refs/heads/b", B), ("refs/tags/v", C)]
    assert R.common_prefix(r) == "refs/" and R.common_prefix(r.where("name LIKE '%heads%'")) == "refs/heads/" and R.common_prefix(r.limit(0)) == ""
    one = spark.createDataFrame([("1", "x"), ("2", "y")], "oid string, v string")
    two = spark.createDataFrame([("2", "z"), ("3", "w"), ("3", "w")], "oid string, v string")
    assert rows(R.composite([one, two])) == [("1", "x"), ("2", "y"), ("3", "w")]
    assert rows(R.ingest(one, two)) == [("1", "x"), ("2", "y"), ("3", "w")]
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "oid string")
    assert rows(R.shallow_update(ids("1", "2"), ids("3"), ids("2", "9"))) == [("1",), ("3",)]
    remote = spark.createDataFrame([("HEAD", A, None, None), ("refs/heads/x", A, None, None), ("refs/heads/main", A, None, None)], I_SCHEMA)
    assert R.default_branch(remote) == "refs/heads/main"


I_SCHEMA = "name string, oid string, peeled string, symref_target string"


@pytest.fixture(scope="module")
def world(spark):
    """1 <- 2 <- 3, and 4 apart."""
    objects = spark.createDataFrame([(A, "commit"), (B, "commit"), (C, "commit"), (D, "commit"), ("e" * 40, "blob")], "oid string, type string")
    edges = spark.createDataFrame([(B, A, 0), (C, B, 0)], "child string, parent string, ord int")
    return objects, edges


def view(spark, *items):
    return I.View(spark.createDataFrame([(n, o, None, None) for n, o in items], I_SCHEMA))


def test_import(spark, world):
    objects, edges = world
    local = refs(spark, HEAD="ref: refs/heads/main", refs__heads__main=A, refs__heads__old=D, refs__heads__stale=A, refs__tags__v=A)
    remote = view(spark, ("refs/heads/main", C), ("refs/heads/old", C), ("refs/heads/new", B))
    plan = I.Plan(spark).to_namespace(remote, "refs/heads/*", prune=True)
    got = I.preview(plan, local, objects, edges)
    assert rows(got.ref_operations, "local_ref", "new_oid") == [("refs/heads/main", C), ("refs/heads/new", B)]
    assert rows(got.prune_operations, "name") == [("refs/heads/stale",)]
    assert not got.can_apply and rows(got.diagnostics.where("level = 'error'"), "ref_name", "message") == [("refs/heads/old", "no fast-forward")]
    with pytest.raises(PreconditionError):
        I.apply(got, local)
    plan = I.Plan(spark).to_namespace(remote, "refs/heads/*", I.MIRROR, prune=True).set_head(remote.select("refs/heads/new"))
    got = I.preview(plan, local, objects, edges)
    assert got.can_apply and got.head == ("refs/heads/new", False)
    assert rows(I.apply(got, local)) == [("HEAD", "ref: refs/heads/new"), ("refs/heads/main", C), ("refs/heads/new", B), ("refs/heads/old", C), ("refs/tags/v", A)]
    with pytest.raises(PreconditionError):
        I.apply(got, refs(spark, HEAD="ref: refs/heads/main", refs__heads__main=B, refs__heads__old=D, refs__heads__stale=A))
    with pytest.raises(PreconditionError):
        I.apply(got, local.union(refs(spark, refs__heads__fresh=A)))


def test_import_faults(spark, world):
    objects, edges = world
    local = refs(spark, refs__tags__v=A)
    one, two = view(spark, ("refs/heads/a", A)), view(spark, ("refs/heads/a", A), ("refs/heads/b", B))
    faults = lambda plan: rows(I.preview(plan, local, objects, edges).diagnostics.where("level <> 'info'"), "level", "message")
    assert [f[0] for f in faults(I.Plan(spark).to_namespace(one, "refs/other/*"))] == ["error"]
    assert [f[0] for f in faults(I.Plan(spark).to_namespace(one, "refs/heads/x", prune=True))] == ["error"]
    assert [f[0] for f in faults(I.Plan(spark).to_branch(two, "x"))] == ["error"]
    assert [f[0] for f in faults(I.Plan(spark).to_branch(one.exclude("*"), "x"))] == ["warn"]
    assert faults(I.Plan(spark).to_tag(view(spark, ("t", B)), "v")) == [("error", "it is there already")]
    assert faults(I.Plan(spark).to_branch(view(spark, ("t", "e" * 40)), "x")) == [("error", "a branch has to be a commit")]
    assert faults(I.Plan(spark).to_branch(view(spark, ("t", "f" * 40)), "x")) == [("error", "the object isn't there")]
    assert faults(I.Plan(spark).set_head(one))[0][0] == "warn"
    assert faults(I.Plan(spark).to_tag(one, "q").set_head(one))[0] == ("error", "HEAD can name a branch only")
    clash = I.Plan(spark).to_branch(one, "x").to_branch(view(spark, ("refs/heads/b", B)), "x")
    assert faults(clash)[0][1].startswith("written by several actions: refs/heads/a, refs/heads/b")
    spaces = I.namespace_targets(two, "refs/mirror/*/end")
    assert rows(spaces, "local_ref") == [("refs/mirror/a/end",), ("refs/mirror/b/end",)]


def test_updates(spark, world):
    objects, edges = world
    u = spark.createDataFrame([("refs/heads/n", A, None, False), ("refs/heads/f", C, A, False), ("refs/heads/r", A, C, False), ("refs/heads/o", A, C, True), ("refs/tags/t", C, A, False), ("refs/heads/m", "f" * 40, None, False)], "local_ref string, remote_oid string, current_oid string, force boolean")
    new, bad = I.apply_updates(u, refs(spark, refs__heads__f=A), objects, edges)
    assert rows(new) == [("refs/heads/f", C), ("refs/heads/n", A), ("refs/heads/o", A)]
    assert rows(bad) == [("refs/heads/m", "the object isn't there"), ("refs/heads/r", "no fast-forward"), ("refs/tags/t", "the tag is there already")]


def test_push(spark, world):
    objects, edges = world
    local = named(spark, ("refs/heads/main", C), ("refs/heads/x", A), ("HEAD", C))
    remote = named(spark, ("refs/heads/main", A), ("refs/heads/x", D), ("refs/heads/z", A))
    spec = lambda *s: [RefSpec.parse(x) for x in s]
    items = P.plan_refs(local, remote, spec("refs/heads/*:refs/heads/*", ":refs/heads/z"))
    assert rows(items, "remote_ref", "local_oid", "remote_oid") == [("refs/heads/main", C, A), ("refs/heads/x", A, D), ("refs/heads/z", None, A)]
    assert rows(P.check_fast_forward(items, objects, edges).where("reason IS NOT NULL"), "remote_ref", "reason") == [("refs/heads/x", "no fast-forward")]
    assert rows(P.commands(items)) == [(A, ZERO_OID, "refs/heads/z"), (A, C, "refs/heads/main"), (D, A, "refs/heads/x")]
    assert rows(P.objects_to_send(edges, items, remote)) == [(B,), (C,)]
    for bad in (["refs/heads/no:refs/heads/no"], ["refs/no/*:refs/x/*"], ["refs/heads/main:refs/q/z", "refs/heads/x:refs/q/z"]):
        with pytest.raises(PushError):
            P.plan_refs(local, remote, spec(*bad))
    assert P.default_spec(refs(spark, HEAD="ref: refs/heads/main", refs__heads__main=A)) == RefSpec.parse("HEAD:refs/heads/main")
    with pytest.raises(PushError):
        P.default_spec(refs(spark, HEAD=A))
    with pytest.raises(PushError):
        P.validate_capabilities(items, ["report-status"])
    assert P.shared_capabilities(["a", "b"], ["b", "c", "a"]) == ["b", "a"]


def test_server(spark, world):
    objects, _ = world
    local = refs(spark, refs__heads__main=A, refs__tags__t=A)
    sent = spark.createDataFrame([(ZERO_OID, B, "refs/heads/n"), (ZERO_OID, B, "refs/heads/main"), (B, C, "refs/heads/main2"), (A, D, "refs/tags/t")], "old_oid string, new_oid string, ref string")
    got = P.check_updates(sent, local, objects)
    assert rows(got, "ref", "error") == [("refs/heads/main", "it is there already"), ("refs/heads/main2", "it isn't there"), ("refs/heads/n", None), ("refs/tags/t", "a tag isn't replaced")]
    assert rows(P.apply_commands(got, local)) == [("refs/heads/main", A), ("refs/heads/n", B), ("refs/tags/t", A)]
    assert rows(P.apply_commands(got, local, atomic=True)) == rows(local)
    states = sent.select("ref", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("message"))
    assert P.report(sent, states).count() == 4
    with pytest.raises(ProtocolError):
        P.report(sent, states.limit(3))


def test_chains_of_any_length(spark):
    """A chain of 200 symbolic references comes to its id, tags alike; a circle, and what leads into one, is named."""
    rows_ = [("refs/x/0", "a" * 40)] + [(f"refs/x/{k}", f"ref: refs/x/{k - 1}") for k in range(1, 200)]
    rows_ += [("refs/c/1", "ref: refs/c/2"), ("refs/c/2", "ref: refs/c/3"), ("refs/c/3", "ref: refs/c/1"), ("refs/c/in", "ref: refs/c/1"), ("refs/c/self", "ref: refs/c/self"), ("refs/b/1", "ref: refs/b/none")]
    got = {r["name"]: r for r in R.resolve(spark.createDataFrame(rows_, "name string, target string")).collect()}
    assert len(got) == len(rows_) and all(got[f"refs/x/{k}"]["oid"] == "a" * 40 for k in range(200)) and got["refs/x/199"]["symref"] == "refs/x/0" and got["refs/x/0"]["symref"] is None
    assert {n for n, r in got.items() if r["error"] == "circle"} == {"refs/c/1", "refs/c/2", "refs/c/3", "refs/c/in", "refs/c/self"}
    assert got["refs/b/1"]["oid"] is None and got["refs/b/1"]["symref"] == "refs/b/none" and got["refs/b/1"]["error"] is None
    tags = spark.createDataFrame([(f"t{k}", f"t{k - 1}") for k in range(1, 200)], "oid string, object string")
    assert rows(R.peel(tags, spark.createDataFrame([("t199",), ("other",)], "oid string"))) == [("other", "other"), ("t199", "t0")]
    with pytest.raises(CircularReferenceError):
        R.peel(spark.createDataFrame([("a", "b"), ("b", "a")], "oid string, object string"), spark.createDataFrame([("a",)], "oid string"))
