"""Queries of jobs that store what they do, against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from transeval.plans.job_queries import JOB_ORACLE, JOB_QUERIES
from transeval.plans.verify import TABLES, compare

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_all_are_registered_with_sql():
    assert set(JOB_QUERIES) == set(JOB_ORACLE)
    assert set(JOB_QUERIES) <= set(entry_mod.queries()) and set(JOB_ORACLE) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(JOB_QUERIES))
def test_query_matches_duckdb(spark, duck, name):
    problems, rows, _secs = compare(spark, duck, name, JOB_QUERIES[name], JOB_ORACLE[name], SF_SMALL)
    assert not problems and rows > 0, problems
