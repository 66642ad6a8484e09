import random
import subprocess

import pytest
from pyspark.sql import functions as F

from grovespark.errors import PathExistsError, PathNotFoundError
from grovespark.functions import codecs
from grovespark.operators import trees
from grovespark.operators.worktree import Worktree, overlay, rewrite
from grovespark.schema import EMPTY_TREE
from tests.conftest import rows

A, B, C = "a" * 40, "b" * 40, "c" * 40
LEAF = "path string, mode string, oid string"
OPS = "seq int, op string, path string, mode string, oid string, from_path string, to_path string"


def leaves(spark, *items):
    return spark.createDataFrame([(p, "100644", o) if isinstance(o, str) else (p, *o) for p, o in items], LEAF)


def tree_of(items: dict) -> str:
    """The root id by plain recursion, entries in canonical order."""
    here, below = [], {}
    for path, (mode, o) in items.items():
        name, slash, rest = path.partition("/")
        if slash:
            below.setdefault(name, {})[rest] = (mode, o)
        else:
            here.append((mode, name, o))
    here += [("040000", name, tree_of(sub)) for name, sub in below.items()]
    here.sort(key=lambda e: (e[1] + "/" * (e[0] == "040000")).encode())
    return codecs.object_id("tree", codecs.encode_tree(here))


def test_build_agrees_with_recursion(spark):
    r = random.Random(5)
    items = {}
    for _ in range(60):
        parts = [r.choice(["foo", "Foo", "a", "b.c", "ä", "z"]) for _ in range(r.randint(0, 3))]
        items["/".join([*parts, f"f{r.randint(0, 40)}.txt"])] = (r.choice(["100644", "100755", "120000"]), f"{r.getrandbits(160):040x}")
    made = trees.build(leaves(spark, *items.items()))
    assert trees.root(made) == tree_of(items)


def test_canonical_order_and_locale(spark):
    items = {"foo/x": ("100644", A), "foo.txt": ("100644", B), "foo": ("100644", C)} and {"foo.txt": ("100644", B), "foo/x": ("100644", A), "Foo": ("100644", C), "bar": ("100644", C)}
    df = leaves(spark, *items.items())
    canonical = trees.build(df).where("path = ''").first()
    assert [e[1] for e in codecs.decode_tree(bytes(canonical["content"]))] == ["Foo", "bar", "foo.txt", "foo"]
    locale = trees.build(df, "locale").where("path = ''").first()
    assert [e[1] for e in codecs.decode_tree(bytes(locale["content"]))] == ["bar", "foo", "Foo", "foo.txt"]


def test_build_agrees_with_git(spark, tmp_path):
    git = lambda *a, text=None: subprocess.run(["git", *a], cwd=tmp_path, input=text, capture_output=True, text=True, check=True).stdout.strip()
    try:
        git("init", "-q")
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git")
    blob = git("hash-object", "-w", "--stdin", text="x")
    names = ["foo", "foo.txt", "a/b/c", "foo-bar/x", "A", "a0"]
    for n in names:
        git("update-index", "--add", "--cacheinfo", f"100644,{blob},{n}")
    assert trees.root(trees.build(leaves(spark, *[(n, blob) for n in names]))) == git("write-tree")


def test_empty(spark):
    none = leaves(spark).where("false")
    assert trees.root(trees.build(none)) == EMPTY_TREE
    assert trees.diff(none, none).count() == 0
    assert rows(trees.diff(none, leaves(spark, ("a", A))), "path", "change") == [("a", "create")]


def test_flatten_is_build_undone(spark):
    items = [("x", A), ("d/e/f", B), ("d/g", ("120000", C)), ("empty", ("040000", EMPTY_TREE)), ("same/e/f", B)]
    made = trees.build(leaves(spark, *items))
    entries = made.select(F.col("oid").alias("tree_oid"), F.posexplode(codecs.parse_tree("content")).alias("ord", "e")).select("tree_oid", "ord", "e.*").dropDuplicates(["tree_oid", "ord"])
    assert rows(trees.flatten(entries, trees.root(made))) == rows(leaves(spark, *items))
    kinds = dict(rows(trees.snapshot(entries, trees.root(made)), "path", "kind"))
    assert kinds == {"x": "blob", "d": "tree", "d/e": "tree", "d/e/f": "blob", "d/g": "symlink", "empty": "tree", "same": "tree", "same/e": "tree", "same/e/f": "blob"}


def test_diff(spark):
    a = leaves(spark, ("README.md", A), ("obsolete.txt", B), ("docs/x", C), ("same", A), ("mode", A), ("kind", A))
    b = leaves(spark, ("README.md", B), ("guides/x", C), ("added.txt", A), ("same", A), ("mode", ("100755", A)), ("kind", ("120000", A)))
    got = {r["path"]: (r["change"], r["kind_changed"], r["mode_changed"], r["content_changed"]) for r in trees.diff(a, b).collect()}
    assert got == {
        "README.md": ("update", False, False, True), "obsolete.txt": ("remove", False, False, False), "docs/x": ("remove", False, False, False), "guides/x": ("create", False, False, False),
        "added.txt": ("create", False, False, False), "mode": ("update", False, True, False), "kind": ("update", True, True, False),
    }


def patched(spark, base, *ops):
    table = spark.createDataFrame([(k, op.get("op"), op.get("path"), op.get("mode", "100644"), op.get("oid"), op.get("a"), op.get("b")) for k, op in enumerate(ops)], OPS)
    done = trees.patch(base, table)
    return {r["path"]: (r["oid"] if r["mode"] != "040000" else "dir") for r in done.leaves.collect()}, [r["path"] for r in done.errors.orderBy("seq", "path").collect()]


def up(path, oid):
    return {"op": "upsert", "path": path, "oid": oid}


def rm(path):
    return {"op": "delete", "path": path}


def mv(a, b):
    return {"op": "rename", "a": a, "b": b}


def test_patch(spark):
    base = leaves(spark, ("a", A), ("d/x", A), ("d/y", B), ("e/only", C))
    assert patched(spark, base) == ({"a": A, "d/x": A, "d/y": B, "e/only": C}, [])
    assert patched(spark, base, up("a", B), up("n/e/w", C)) == ({"a": B, "d/x": A, "d/y": B, "e/only": C, "n/e/w": C}, [])
    assert patched(spark, base, rm("d"))[0] == {"a": A, "e/only": C}
    assert patched(spark, base, rm("e/only"))[0] == {"a": A, "d/x": A, "d/y": B, "e": "dir"}, "an emptied directory stays"
    assert patched(spark, base, up("a", B), rm("a"), up("a", C))[0]["a"] == C
    assert patched(spark, base, up("new", B), rm("new")) == ({"a": A, "d/x": A, "d/y": B, "e/only": C}, [])
    assert patched(spark, base, rm("zz"))[1] == ["zz"]
    assert patched(spark, base, up("a/b", B))[1] == ["a/b"], "a file is no directory"
    assert patched(spark, base, up("d/../x", B))[1] == ["d/../x"]
    assert patched(spark, base, up("d", B))[0] == {"a": A, "d": B, "e/only": C}, "a file in place of a directory"
    assert patched(spark, base, up("d", B), up("d/z", C))[0] == {"a": A, "d": B, "e/only": C}, "the direct one wins"


def test_renames(spark):
    base = leaves(spark, ("a", A), ("d/x", B))
    assert patched(spark, base, mv("a", "b"))[0] == {"b": A, "d/x": B}
    assert patched(spark, base, mv("a", "b"), mv("b", "c"), up("c", C))[0] == {"c": C, "d/x": B}
    assert patched(spark, base, mv("d", "e/f"))[0] == {"a": A, "e/f/x": B}
    assert patched(spark, base, up("a", C), mv("a", "b"), up("a", B))[0] == {"a": B, "b": C, "d/x": B}
    assert patched(spark, base, mv("a", "a"), mv("zz", "zz")) == ({"a": A, "d/x": B}, [])
    assert patched(spark, base, mv("zz", "y"))[1] == ["zz"]


def test_patch_tree_raises(spark):
    base = leaves(spark, ("a", A))
    ops = spark.createDataFrame([(0, "delete", "zz", None, None, None, None)], OPS)
    with pytest.raises(PathNotFoundError):
        trees.patch_tree(base, ops)
    root, _ = trees.patch_tree(base, ops.where("false"))
    assert root == tree_of({"a": ("100644", A)})


def test_worktree(spark):
    base = leaves(spark, ("a", A), ("d/x", A), ("d/y", B))
    w = Worktree(base)
    assert w.exists("") and w.exists("d") and w.stat("d/x")["kind"] == "blob" and not w.exists("q")
    one = w.write("a", B).write("d/z", C)
    assert rows(one.diff(), "path", "change") == [("a", "update"), ("d/z", "create")]
    assert rows(w.diff()) == [], "the one before is as it was"
    assert [r["name"] for r in one.children("d").collect()] == ["x", "y", "z"]
    assert rows(one.delete("d").diff(), "path", "change") == [("a", "update"), ("d/x", "remove"), ("d/y", "remove")]
    moved = w.move("d", "n/e")
    assert rows(moved.current, "path") == [("a",), ("n/e/x",), ("n/e/y",)]
    assert rows(w.copy("d", "k").current, "path") == [("a",), ("d/x",), ("d/y",), ("k/x",), ("k/y",)]
    assert rows(one.restore("a").diff(), "path") == [("d/z",)]
    assert rows(one.restore("").diff()) == []
    for bad in (lambda: w.move("d", "d/q"), lambda: w.move("a", "d"), lambda: w.copy("a", "d/x"), lambda: w.mkdir("d")):
        with pytest.raises(PathExistsError):
            bad()
    for bad in (lambda: w.write("q/r", A), lambda: w.delete("q"), lambda: w.move("q", "r"), lambda: w.copy("a", "q/r")):
        with pytest.raises(PathNotFoundError):
            bad()
    assert w.delete("q", force=True) is w
    assert rows(w.mkdir("p/q", recursive=True).current.where("mode = '040000'"), "path") == [("p/q",)]


def test_a_base_entry_stays_deleted(spark):
    """Delete, make again, delete: the base's entry must not come back."""
    w = Worktree(leaves(spark, ("a", A), ("b", B))).delete("a").write("a", C).delete("a")
    assert rows(w.current, "path") == [("b",)] and rows(w.diff(), "path", "change") == [("a", "remove")]


def test_bulk_forms_agree_with_steps(spark):
    base = leaves(spark, ("a", A), ("d/x", A), ("d/y", B), ("s/t/u", C))
    ops = spark.createDataFrame([(0, "write", "a", None, "100644", B), (1, "delete", "d/x", None, None, None), (2, "move", "s", "m", None, None), (3, "write", "m/t/v", None, "100644", A), (4, "copy", "m", "k", None, None), (5, "restore", "a", None, None, None)], "seq int, op string, path string, to_path string, mode string, oid string")
    got = Worktree(base).apply(ops).current
    assert rows(got, "path", "oid") == [("a", A), ("d/y", B), ("k/t/u", C), ("k/t/v", A), ("m/t/u", C), ("m/t/v", A)]
    few = spark.createDataFrame([(0, "upsert", "a", "100644", B), (1, "delete", "d/x", None, None), (2, "upsert", "n", "100644", C)], "seq int, op string, path string, mode string, oid string")
    assert rows(overlay(base, few), "path", "oid") == [("a", B), ("d/y", B), ("n", C), ("s/t/u", C)]
    moves = spark.createDataFrame([("move", "d", "q/r"), ("copy", "s/t", "c"), ("move", "a", "b")], "op string, from_path string, to_path string")
    assert rows(rewrite(base, moves), "path") == [("b",), ("c/u",), ("q/r/x",), ("q/r/y",), ("s/t/u",)]


def test_runs_of_renames_agree_with_steps(spark):
    """Renames that follow each other, among them chains, onto what is there, and ones that find nothing."""
    r = random.Random(3)
    for trial in range(6):
        files = {f"{a}/{b}/{c}" for a in "xyz" for b in "pq" for c in "12" if r.random() < 0.8}
        ops, want, gone = [], {f: f for f in files}, []
        for seq in range(1, 7):
            a, b = (r.choice(["x", "y", "z", "x/p", "y/q", "w", "v", "x/p/1"]) for _ in range(2))
            if b.startswith(f"{a}/"):
                continue
            ops.append((seq, "rename", None, None, None, a, b))
            inside = lambda path, top: path == top or path.startswith(f"{top}/")
            if a == b:
                continue
            if not any(inside(p, a) for p in want):
                gone.append((seq, a))
                continue
            want = {(b + p[len(a) :] if inside(p, a) else p): f for p, f in want.items() if inside(p, a) or not inside(p, b)}
        leaves = spark.createDataFrame([(f, "100644", f) for f in sorted(files)], "path string, mode string, oid string")
        done = trees.patch(leaves, spark.createDataFrame(ops, "seq int, op string, path string, mode string, oid string, from_path string, to_path string"))
        assert rows(done.leaves, "path", "oid") == sorted(want.items()), (trial, ops)
        assert rows(done.errors, "seq", "path") == gone
