import pytest

from grovespark.errors import PathExistsError, PathNotFoundError
from grovespark.operators.packs import newest_layer
from grovespark.operators.worktree import Worktree
from grovespark.operators.worktree_store import WorktreeStore, changes_from_json, changes_to_json
from grovespark.sources import writers
from tests.conftest import rows

LEAF = "path string, mode string, oid string"
A, B = "a" * 40, "b" * 40


def test_worktree_store(spark, tmp_path):
    store = WorktreeStore(spark, str(tmp_path / "s"))
    tree = Worktree(spark.createDataFrame([("x", "100644", A), ("d/y", "100644", A)], LEAF))
    store.create("one", tree)
    store.create("other/two", Worktree(spark.createDataFrame([], LEAF)))
    assert store.keys() == ["one", "other/two"] and store.keys("other/") == ["other/two"] and store.has("one")
    store.save("one", store.open("one").write("x", B))
    assert rows(store.open("one").diff(), "path", "change") == [("x", "update")] and store.open("other/two").current.count() == 0
    store.rename("one", "uno")
    with pytest.raises(PathNotFoundError):
        store.open("one")
    with pytest.raises(PathExistsError):
        store.create("uno", tree)
    assert store.faults().count() == 0
    store.save("bad", Worktree(tree.base, spark.createDataFrame([("x", "100644", A), ("x/y", "100644", A), ("z", "100644", A), ("z", "100644", B)], LEAF)))
    assert rows(store.faults()) == [("bad", "x/y", "below no directory"), ("bad", "z", "twice")]
    assert store.delete("bad") and not store.delete("bad") and store.delete_prefix("o") == 1 and store.keys() == ["uno"]


def test_changes_as_json(spark):
    base = spark.createDataFrame([("x", "100644", A), ("y", "100644", A)], LEAF)
    diff = Worktree(base).write("x", B).delete("y").write("z", A).diff()
    back = changes_from_json(changes_to_json(diff))
    assert rows(back, "path", "change", "previous.oid", "current.oid") == [("x", "update", A, B), ("y", "remove", A, None), ("z", "create", None, A)]


def test_incremental_index(spark, tmp_path):
    folder = str(tmp_path / "p")
    index = lambda *r: spark.createDataFrame(list(r), "pack string, oid string, offset long")
    assert writers.chain_layers(folder) == [] and writers.chain_index(spark, folder).count() == 0
    assert writers.write_incremental_index(index(("p0.pack", A, 12), ("p1.pack", A, 40)), folder) == 1
    assert writers.write_incremental_index(index(("p2.pack", A, 99), ("p2.pack", B, 12)), folder) == 1
    assert writers.write_incremental_index(index(("p3.pack", A, 1)), folder) == 0
    assert rows(newest_layer(writers.chain_index(spark, folder))) == [(A, 0, "p1.pack", 40), (B, 1, "p2.pack", 12)]
    (tmp_path / "p/multi-pack-index.d/multi-pack-index-chain").write_text("0" * 40 + "\n")
    assert writers.chain_layers(folder) == []
