import random

import pytest

from grovespark.errors import HistoryTooLargeError, ObjectNotFoundError
from grovespark.operators import graph
from tests.conftest import rows

EDGE = "child long, parent long, ord int"


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "oid long")


def table(spark, edges):
    return spark.createDataFrame([(c, p, k) for c, ps in edges.items() for k, p in enumerate(ps)], EDGE)


def commits(spark, times):
    return spark.createDataFrame(list(times.items()), "oid long, ts long")


def order(df):
    return [r["oid"] for r in df.orderBy("position").collect()]


LINE = {3: [2], 2: [1]}
#: B and C come from A, D merges them; A and C have the same time.
MERGE, TIMES = {4: [2, 3], 2: [1], 3: [1]}, {1: 1000, 2: 2000, 3: 1000, 4: 3000}


def test_log(spark):
    c, e = commits(spark, {1: 1000, 2: 2000, 3: 3000}), table(spark, LINE)
    log = lambda **o: order(graph.log(c, e, ids(spark, 3), **o))
    assert log() == [3, 2, 1]
    assert log(max_count=2) == [3, 2] and log(skip=1) == [2, 1] and log(skip=1, max_count=1) == [2]
    assert log(exclude=ids(spark, 2)) == [3] and log(since=2000) == [3, 2] and log(until=2000) == [2, 1]
    assert order(graph.log(c, e, ids(spark).where("false"))) == []
    assert order(graph.log(c.where("oid <> 2"), e, ids(spark, 3))) == [3], "what isn't there is passed over"


def test_log_of_a_merge(spark):
    c, e = commits(spark, TIMES), table(spark, MERGE)
    assert order(graph.log(c, e, ids(spark, 4))) == [4, 2, 3, 1], "a child before its parent of the same time"
    assert order(graph.log(c, e, ids(spark, 4), first_parent=True)) == [4, 2, 1]
    assert order(graph.log(c, e, ids(spark, 4), order="topo")) == [4, 2, 3, 1]


def test_since_prunes_by_date_only(spark):
    """2 is older than its parent 1: the walk by date ends there, the topological one goes on."""
    c, e = commits(spark, {1: 2500, 2: 1000, 3: 3000}), table(spark, LINE)
    assert order(graph.log(c, e, ids(spark, 3), since=2000)) == [3]
    assert order(graph.log(c, e, ids(spark, 3), since=2000, order="topo")) == [3, 1]
    assert order(graph.log(c, e, ids(spark, 3), order="topo")) == [3, 2, 1], "clock skew doesn't put a parent first"


def model_closure(edges, roots, stop=()):
    seen, todo = set(roots), list(roots)
    while todo:
        now = todo.pop()
        for p in edges.get(now, []) if now not in stop else []:
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


@pytest.mark.parametrize("small", [0, graph.SMALL])
def test_random_graphs(spark, small):
    r = random.Random(small + 3)
    edges = {n: r.sample(range(n), min(n, r.choice([0, 1, 1, 2]))) for n in range(40)}
    e = table(spark, edges)
    roots, stop = r.sample(range(40), 3), set(r.sample(range(40), 5))
    assert {x[0] for x in rows(graph.closure(e, ids(spark, *roots), small=small))} == model_closure(edges, roots)
    assert {x[0] for x in rows(graph.closure(e, ids(spark, *roots), ids(spark, *stop), small=small))} == model_closure(edges, roots, stop)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(12)]
    got = graph.is_ancestor(e, spark.createDataFrame(pairs, "old long, new long"), small=small)
    assert {(x["old"], x["new"]): x["ancestor"] for x in got.collect()} == {(a, b): a in model_closure(edges, [b]) for a, b in pairs}
    level = {}
    for n in range(40):
        level[n] = max([level[p] + 1 for p in edges[n]], default=0)
    assert dict(rows(graph.generations(e, ids(spark, *range(40)), small=small))) == level
    up = {n: [c for c in edges if n in edges[c]] for n in range(40)}
    for n in reversed(range(40)):
        level[n] = max([level[c] + 1 for c in up[n]], default=0)
    assert dict(rows(graph.topo_levels(e, ids(spark, *range(40)), small=small))) == level


def test_topo_order_is_topological(spark):
    r = random.Random(9)
    edges = {n: r.sample(range(n), min(n, 2)) for n in range(30)}
    times = {n: r.randrange(5) for n in range(30)}
    got = order(graph.log(commits(spark, times), table(spark, edges), ids(spark, 29, 28), order="topo"))
    assert len(got) == len(set(got)) and set(got) == model_closure(edges, [29, 28])
    assert all(got.index(c) < got.index(p) for c in got for p in edges[c])


def test_reachable_and_missing(spark):
    e, there = table(spark, LINE), ids(spark, 3, 2)
    with pytest.raises(ObjectNotFoundError):
        graph.reachable(e, there, ids(spark, 3))
    assert rows(graph.reachable(e, there, ids(spark, 3), absent="skip")) == [(2,), (3,)]
    assert rows(graph.reachable(e, there, ids(spark, 3), boundary=ids(spark, 2))) == [(2,), (3,)], "a boundary commit's parents are forgiven"
    assert rows(graph.gc(table(spark, LINE), ids(spark, 1, 2, 3, 7), ids(spark, 2))) == [(3,), (7,)]


def test_transfer(spark):
    e = table(spark, MERGE)
    assert rows(graph.to_send(e, ids(spark, 4), ids(spark, 2))) == [(3,), (4,)]
    assert rows(graph.common(ids(spark, 2, 9, 2), ids(spark, 1, 2))) == [(2,)]
    assert rows(graph.child_counts(e)) == [(1, 2), (2, 1), (3, 1)]
    assert rows(graph.all_closures(e, ids(spark, 2, 3))) == [(2, 1), (2, 2), (3, 1), (3, 3)]


def test_ancestors_with_missing_objects(spark):
    e, pair = table(spark, LINE), spark.createDataFrame([(1, 3), (9, 3), (3, 3)], "old long, new long")
    flag = lambda **o: {x["old"]: x["ancestor"] for x in graph.is_ancestor(e, pair, **o).collect()}
    assert flag() == {1: True, 9: False, 3: True}
    assert flag(objects=ids(spark, 3)) == {1: False, 9: False, 3: True}
    assert flag(objects=ids(spark, 3), boundary=ids(spark, 2)) == {1: True, 9: True, 3: True}


def test_object_edges(spark):
    c = spark.createDataFrame([("c1", "t1", ["c0"])], "oid string, tree string, parents array<string>")
    t = spark.createDataFrame([("t1", 0, "100644", "f", "b1"), ("t1", 1, "160000", "sub", "x")], "tree_oid string, ord int, mode string, name string, oid string")
    tag = spark.createDataFrame([("g1", "c1")], "oid string, object string")
    e = graph.object_edges(c, t, tag)
    assert rows(e) == [("c1", "c0", "parent"), ("c1", "t1", "tree"), ("g1", "c1", "tag"), ("t1", "b1", "entry")]
    there = spark.createDataFrame([("c1",), ("t1",), ("b1",), ("g1",)], "oid string")
    root = spark.createDataFrame([("g1",)], "oid string")
    assert rows(graph.reachable(e, there, root, absent="skip_parents")) == [("b1",), ("c1",), ("g1",), ("t1",)]


def test_positions(spark):
    import hashlib

    from grovespark.operators.packs import positions
    from grovespark.storage import numbered

    ids_ = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(300)]
    df = spark.createDataFrame([(i, "blob" if k % 3 else "tree") for k, i in enumerate(ids_)], "oid string, type string")
    assert rows(positions(df), "oid", "position") == [(i, k) for k, i in enumerate(sorted(ids_))]
    assert rows(numbered(df, [df["oid"].desc()]), "oid", "position") == sorted((i, k) for k, i in enumerate(sorted(ids_, reverse=True)))
    bits = graph.type_bitmaps(df).selectExpr("type", "bitmap_count(bits) AS n")
    assert rows(bits) == [("blob", 200), ("tree", 100)]
    assert numbered(df.where("false"), [df["oid"]]).count() == 0


def test_known_closures_help_a_walk(spark):
    edges = spark.createDataFrame([(k, k - 1) for k in range(1, 30)] + [(k, k - 7) for k in range(8, 30, 5)], "child long, parent long")
    roots = spark.createDataFrame([(29,), (12,), (5,)], "oid long")
    known = graph.all_closures(edges, spark.createDataFrame([(20,), (5,)], "oid long"))
    assert rows(graph.closure_with(edges, roots, known)) == rows(graph.closure(edges, roots))
    assert rows(graph.closure_with(edges, roots, known, small=0)) == rows(graph.closure(edges, roots))


def test_topological_order_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", 5)
    commits = spark.createDataFrame([(k, k * 10) for k in range(10)], "oid long, ts long")
    edges = spark.createDataFrame([(k, k - 1, 0) for k in range(1, 10)], "child long, parent long, ord int")
    start = spark.createDataFrame([(9,)], "oid long")
    assert [r["oid"] for r in graph.log(commits, edges, spark.createDataFrame([(4,)], "oid long"), order="topo").orderBy("position").collect()] == [4, 3, 2, 1, 0]
    with pytest.raises(HistoryTooLargeError):
        graph.log(commits, edges, start, order="topo", small=1)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_topological_order_of_a_large_history(spark, monkeypatch, kind):
    """More commits than the driver takes are put in order by tasks, in the same order, whatever their clocks."""
    monkeypatch.setattr(graph, "TOGETHER", 4)
    r = random.Random(21)
    name = (lambda n: n) if kind == "long" else (lambda n: f"{n * 79 % 100:02d}")
    edges = [(name(n), name(p), k) for n in range(24) for k, p in enumerate(r.sample(range(max(0, n - 9), n), min(n, r.choice([0, 1, 1, 2]))))]
    e = spark.createDataFrame([*edges, edges[0], (name(25), name(3), 0)], f"child {kind}, parent {kind}, ord int")
    for times in (list(range(24)), [r.randrange(3) for _ in range(24)], [n if n % 9 else 12 - n for n in range(24)]):
        c = spark.createDataFrame([(name(n), t) for n, t in enumerate(times)], f"oid {kind}, ts long")
        by = lambda most: [x["oid"] for x in graph._topo_order(c, e, most, False).orderBy("__rank").collect()]  # noqa: B023, E731
        assert by(5) == by(graph.SMALL) and len(by(5)) == 24


def test_log_of_a_large_history_in_topological_order(spark, monkeypatch):
    times = [0, 3, 3, 2, 5, 5]
    c, e = commits(spark, dict(enumerate(times))), table(spark, {5: [4, 3], 4: [2], 3: [1], 2: [0], 1: [0]})
    want = order(graph.log(c, e, ids(spark, 5), order="topo"))
    monkeypatch.setattr(graph, "SMALL", 4)
    assert order(graph.log(c, e, ids(spark, 5), order="topo")) == want == [5, 4, 2, 3, 1, 0]
