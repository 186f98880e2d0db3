"""Registered queries against their SQL on the smallest tables, and the contract of the entry file."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from stratagraph import queries as graphs
from stratagraph import storage

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(graphs.SQL))
def test_query_is_its_sql(spark, duck, name):
    mine = graphs.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.execute(graphs.SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    mine, theirs = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, theirs))
    assert len(mine) == len(theirs) > 0
    for c in columns:
        assert (mine[c] == theirs[c]).all(), c


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["node_id", "vec"] and out.count() == 200


def test_library_without_text_operators(tmp_path):
    """Nothing outside imports the subpackage, and the entry file works without it."""
    root = Path(entry.__file__).parent
    for path in (root / "stratagraph").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", "llm", "corpus_pipeline.py"))
    code = """
import __spark_entry__ as e
assert "node_degree" in e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
assert e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
    (copy / "stratagraph" / "llm" / "__pycache__").mkdir(parents=True)  # what deleting may leave
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_a_broken_module_is_an_error(tmp_path):
    """Only what is left out is passed over: an operator that does not import must not make its query vanish."""
    root = Path(entry.__file__).parent
    if not (root / "stratagraph" / "llm").exists():
        pytest.skip("left out")
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    (copy / "stratagraph" / "llm" / "queries.py").write_text("from . import no_such_module\n")
    code = "import __spark_entry__ as e\ntry:\n    e.queries()\nexcept ImportError:\n    pass\nelse:\n    raise SystemExit(1)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, found):
            self.found = found

        def get(self, name, default=None):
            return self.found if self.found is not None else default

    class Session:
        def __init__(self, found, master):
            self.conf, self.sparkContext = Conf(found), type("Context", (), {"master": master})

    assert storage.shared_dir(Session("/shared/", "spark://host:7077")) == "/shared"
    assert storage.shared_dir(Session(None, "local[2]"))
    with pytest.raises(RuntimeError):
        storage.shared_dir(Session(None, "spark://host:7077"))
