import subprocess

import pytest

from grovespark.catalog import Repository
from grovespark.errors import TransactionError
from grovespark.schema import EMPTY_TREE
from tests.conftest import rows

ME = {"name": "Test", "email": "test@test", "timestamp": 1000, "timezone": "+0000"}
LEAF = "path string, mode string, oid string"


def at(ts):
    return ME | {"timestamp": ts}


@pytest.fixture(scope="module")
def repo(spark):
    """main: 1 <- 2, with files; v1 an annotated tag of 1."""
    r = Repository.create(spark)
    r, (x, y) = r.add("blob", [b"x", b"y"])
    r, t1 = r.write_tree(spark.createDataFrame([("a", "100644", x), ("d/b", "100644", y)], LEAF))
    r, c1 = r.create_commit(t1, [], at(1000), "First")
    r, t2 = r.write_tree(spark.createDataFrame([("a", "100755", x), ("d/c", "100644", y)], LEAF))
    r, c2 = r.create_commit(t2, [c1], at(2000), "Second")
    r = r.update_refs({"refs/heads/main": c2}).settled()
    r, tag = r.create_tag("v1", c1, ME, "one")
    return r.settled(), c1, c2, tag


def test_objects_and_history(repo):
    r, c1, c2, tag = repo
    assert r.cat(tag)[0] == "tag" and r.current_branch() == "refs/heads/main" and r.read_ref("HEAD") == c2
    assert [x["oid"] for x in r.log().orderBy("position").collect()] == [c2, c1]
    assert [x["oid"] for x in r.log(["refs/tags/v1"]).collect()] == [c1]
    assert [x["oid"] for x in r.log(exclude=["refs/tags/v1"]).collect()] == [c2]
    got = r.diff(r.tree_of(c1), r.tree_of("HEAD"))
    assert rows(got.where("old_kind = 'blob' OR new_kind = 'blob'"), "path", "change") == [("a", "update"), ("d/b", "remove"), ("d/c", "create")]
    assert r.snapshot(r.tree_of()).count() == 3


def test_references(repo):
    r, c1, c2, _ = repo
    other = r.create_branch("dev", c1)
    assert rows(other.branches()) == [("refs/heads/dev", c1), ("refs/heads/main", c2)] and r.branches().count() == 1
    assert other.delete_branch("dev").branches().count() == 1 and r.delete_tag("v1").refs.count() == 2
    for bad in (lambda: other.create_branch("dev"), lambda: r.delete_branch("main"), lambda: r.create_tag("v1")):
        with pytest.raises(TransactionError):
            bad()


def test_gc(repo):
    r, *_ = repo
    more, loose = r.write_blob(b"nobody's")
    more, _ = more.create_commit(EMPTY_TREE, [], at(5), "lost")
    kept = more.gc()
    assert kept.objects.count() == r.objects.count() == more.objects.count() - 2 and kept.objects.where(f"oid = '{loose}'").isEmpty()


def test_exchange(spark, repo):
    r, c1, c2, tag = repo
    clone = Repository.create(spark).fetch(r).settled()
    assert rows(clone.objects, "oid") == rows(r.objects, "oid")
    assert rows(clone.refs) == [("HEAD", "ref: refs/heads/main"), ("refs/heads/main", c2), ("refs/tags/v1", tag)]
    mine, c3 = clone.create_commit(clone.tree_of(), [c2], at(3000), "Third")
    mine = mine.update_refs({"refs/heads/main": c3}).settled()
    there, report = mine.push(r)
    assert there.read_ref("refs/heads/main") == c3 and rows(report, "error") == [(None,)] and there.objects.count() == r.objects.count() + 1
    with pytest.raises(TransactionError):
        r.push(there)
    back, _ = r.push(there, ["+refs/heads/main:refs/heads/main"])
    assert back.read_ref("HEAD") == c2


def test_tables_and_files(spark, repo, tmp_path):
    r, c1, c2, _ = repo
    r.save(str(tmp_path / "t"))
    assert rows(Repository.open(spark, str(tmp_path / "t")).refs) == rows(r.refs)
    folder = str(tmp_path / "f")
    r.export_files(folder)
    again = Repository.import_files(spark, folder)
    assert rows(again.objects, "oid", "type", "size") == rows(r.objects, "oid", "type", "size") and rows(again.refs) == rows(r.refs)
    r.write_packs(f"{folder}/objects/pack", 2).count()
    assert Repository.import_files(spark, folder).objects.count() == r.objects.count()
    try:
        run = lambda *a: subprocess.run(["git", *a], cwd=folder, capture_output=True, text=True)
        (tmp_path / "f/config").write_text("[core]\n\trepositoryformatversion = 0\n\tbare = true\n")
        assert run("fsck", "--full", "--strict").returncode == 0
        assert run("log", "--format=%H %s").stdout.splitlines() == [f"{c2} Second", f"{c1} First"]
        assert run("verify-pack", *[str(p) for p in (tmp_path / "f/objects/pack").glob("*.pack")]).returncode == 0
    except OSError:
        pytest.skip("no git")


def test_worktree_to_commit(spark, repo):
    r, *_ = repo
    w = r.worktree(r.tree_of()).move("d", "e").delete("a")
    tree, made = w.write_tree()
    saved, again = r.write_tree(w.current)
    assert tree == again and saved.diff(r.tree_of(), tree).count() > 0
    ops = spark.createDataFrame([(0, "rename", None, None, None, "d", "e"), (1, "delete", "a", None, None, None, None)], "seq int, op string, path string, mode string, oid string, from_path string, to_path string")
    assert r.patch_tree(r.tree_of(), ops)[1] == tree
