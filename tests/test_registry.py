"""Every registered query against its DuckDB text on the smallest tables."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, duck.execute(ORACLE[name]).df()).startswith("ok")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_oracle_names_are_registered():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.schema == entry.entry(spark).schema
