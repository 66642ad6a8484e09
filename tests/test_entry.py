"""The registered queries against DuckDB, and the library without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from grovespark import queries

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted(repr(tuple(str(v) if isinstance(v, bool) or v is None else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(queries.oracle_sql()[name]).fetchall()
    order = [d[0] for d in duck.description]
    assert sorted(order) == names
    assert plain(df.select(*names).collect()) == plain(tuple(r[order.index(n)] for n in names) for r in want)


def test_golden_root(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).first()["oid"] == "e4df399d8098abe4da414297014d8203b88b0ec3"


def test_without_llm(tmp_path):
    """The package without its llm folders and the pipeline: queries are listed, and the other tests are found and run."""
    for item in ("grovespark", "tests", "__spark_entry__.py", "bench.py"):
        source = ROOT / item
        shutil.copytree(source, tmp_path / item, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'merkle_root' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); import bench"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    pytest_ = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider"]
    found = subprocess.run([*pytest_, "--collect-only", "tests"], cwd=tmp_path, check=True, capture_output=True, text=True).stdout
    assert "test_graph" in found and "error" not in found.splitlines()[-1]
    subprocess.run([*pytest_, "-x", "tests/test_functions.py"], cwd=tmp_path, check=True, capture_output=True)
