"""Every query that SQL can express, against DuckDB on the whole tables."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as contract
import pytest
from compare import duck, duck_rows, spark_rows

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    with duck(folder) as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, folder, name):
    got = spark_rows(contract.queries()[name](spark, folder))
    want = duck_rows(con, SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert "avg_duration" in df.columns


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without viewtide/llm and tests/llm, with and without corpus_pipeline.py."""
    root = os.path.dirname(contract.__file__)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sum(n.startswith('op') or n == 'pipeline' for n in q), len(q))"
    core = len(contract.catalog.QUERIES)
    for gone in (["viewtide/llm"], ["viewtide/llm", "corpus_pipeline.py"]):
        copy = tmp_path / str(len(gone))
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *[os.path.basename(g) for g in gone]))
        ran = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert ran.stdout.split() == ["0", str(core)], ran.stderr[-500:]
