"""Every query of the library that SQL can express beside its DuckDB SQL, and the driver's contract."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from oracle import compare
from tidemark import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, name):
    assert compare(spark, SF, QUERIES[name], SQL[name]) is None


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_can_be_listed_without_a_session():
    """In a process of its own: importing the library and its entry makes no Spark object."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": f"{root}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"})
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 200
