import duckdb
import pytest

import __spark_entry__ as entry_mod
from transeval.plans.oracle import ORACLE
from transeval.plans.queries import QUERIES
from transeval.plans.verify import TABLES, compare

SF_SMALL = "/root/testdata/sf0.001"
# inputs are Python literals, which only Python parses
PYTHON_QUERIES = {"seed_selection", "reply_lines", "new_inputs", "pool_union", "test_prompt"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["model", "k", "n_tasks", "min_n", "pass_at_k"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLE) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_building_a_query_runs_nothing(spark, name):
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    QUERIES[name](spark, SF_SMALL)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert store.executionsCount() == before


@pytest.mark.parametrize("name", ["seed_selection"])
def test_bounded_picks_are_limited_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_attempted_tests_read_the_log_once(spark):
    plan = QUERIES["attempted_tests"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # once for the log itself and once for the number of its tests
    assert plan.count("lineitem.parquet") <= 2


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    problems, _rows, _secs = compare(spark, duck, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_QUERIES:
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_task_scan_pushes_the_language_filter(spark):
    plan = QUERIES["task_scan"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan


def test_small_task_side_is_broadcast(spark):
    df = QUERIES["sample_task_join"](spark, SF_SMALL)
    df.collect()                       # AQE settles the join strategy at run time
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["first_failure", "sample_verdict", "budget_verdict", "new_inputs", "sample_task_join", "integrity_checks"])
def test_minima_stay_hash_aggregates(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_generated_methods_are_compiled(spark, capsys):
    """The JVM compiles no method of more than 8000 bytes: making and comparing outputs stays below."""
    import re

    from transeval.functions.compare import with_outputs_match
    from transeval.sources import bindings as B

    pairs = spark.range(9).selectExpr("id || '.25' as a", "id || '.3' as b")
    for df in (with_outputs_match(pairs, "a", "b", "m"), B.exec_log(spark, "/root/testdata/sf0.001")):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            df.explain("codegen")
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) <= 8000
