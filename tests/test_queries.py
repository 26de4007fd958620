"""Every registered query over reference capabilities against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom import registry

SF = "/root/testdata/sf0.001"


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted([str([plain(r[k]) for k in order]) for r in table])


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, oracle, name):
    found = registry.QUERIES[name](spark, SF)
    want = oracle.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "seq", "x", "y"] and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
