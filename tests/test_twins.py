"""Every query with a SQL twin gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(small, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, small, duck, name):
    _, rows, problems = compare(entry.queries()[name](spark, small), duck, entry.oracle_sql()[name])
    assert not problems, problems


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 75
