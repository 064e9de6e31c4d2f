"""Every query with SQL against DuckDB on whole tables."""

import math

import duckdb
import pytest

from transeval.llm.oracle import LLM_ORACLE
from transeval.llm.queries import LLM_QUERIES


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(LLM_ORACLE[name])
    cols = [c[0] for c in cur.description]
    expected = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=repr)
    df = LLM_QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    assert got == expected


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
