"""Every registered query against its SQL on DuckDB, over whole tables."""

import re
from pathlib import Path

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from rowloom import suite

SF = "/root/testdata/sf0.001"
QUERIES, SQL = suite.QUERIES, suite.SQL


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    assert difference(spark, connection, QUERIES[name], SQL.get(name), SF) is None


def test_entry_point(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_no_machine_local_checkpoints_in_the_library():
    for path in (Path(__file__).resolve().parents[1] / "rowloom").rglob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin|\.toPandas\(", path.read_text()), path
