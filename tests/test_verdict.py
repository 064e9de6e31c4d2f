from pyspark.sql import functions as F

from transeval.operators import verdict as vd

judge, tests_from_tasks, attach_expected = vd.judge, vd.tests_from_tasks, vd.attach_expected
attempted_tests, sample_verdicts, verdict_label = vd.attempted_tests, vd.sample_verdicts, vd.verdict_label

SCHEMA = ("task_id string, completion_id string, test_idx int, compile_ok boolean, timed_out boolean, "
          "elapsed_s double, stdout string, stderr string")


def _tasks(spark):
    return spark.createDataFrame([("t", [("i0", "1"), ("i1", "2"), ("i2", "3")])],
                                 "task_id string, test_io array<struct<input:string, output:string>>")


def _run(spark, logs, **kw):
    rows = []
    for cid, tests in logs.items():
        for r in tests:
            rows.append(("t", cid, *r))
    log = spark.createDataFrame(rows, SCHEMA)
    return {r.completion_id: r.verdict for r in judge(log, tests_from_tasks(_tasks(spark)), **kw).collect()}


def test_golden_verdicts(spark):
    ok, bad = "1", "x"
    logs = {
        "pass": [(0, True, False, 1.0, "1", ""), (1, True, False, 1.0, "2", "")],
        "fail": [(0, True, False, 1.0, "1", ""), (1, True, False, 1.0, bad, ""), (2, True, False, 1.0, "3", "")],
        "rt": [(0, True, False, 1.0, bad, "err"), (1, True, False, 1.0, "2", "")],
        "warn": [(0, True, False, 1.0, "1", "warning")],
        "loop": [(0, True, False, 1.0, "1", ""), (1, True, True, 100.0, "", "")],
        "cfail": [(0, False, False, 1.0, "", "")],
        "notests": [(None, True, False, 0.0, None, None)],
    }
    v = _run(spark, logs)
    assert v == {"pass": "success", "fail": "test_failed", "rt": "runtime_failed", "warn": "success",
                 "loop": "infinite_loop", "cfail": "compile_failed", "notests": None}
    del ok


def test_undecodable_bytes(spark):
    rows = [("t", "a", 0, True, False, 1.0, b"9", b"\xff\xfe"),   # mismatch, stderr not UTF-8
            ("t", "b", 0, True, False, 1.0, b"\xff", b""),        # stdout not UTF-8 never matches
            ("t", "c", 0, True, False, 1.0, b"1", b"\xff")]       # match: stderr ignored
    log = spark.createDataFrame(rows, SCHEMA.replace("stdout string, stderr string", "stdout binary, stderr binary"))
    v = {r.completion_id: r.verdict for r in judge(log, tests_from_tasks(_tasks(spark))).collect()}
    assert v == {"a": "compile_failed", "b": "test_failed", "c": "success"}


def test_budget_modes(spark):
    logs = {
        # 60 s + 60 s: the watchdog fires during the second test after one pass
        "late": [(0, True, False, 60.0, "1", ""), (1, True, False, 60.0, "x", "")],
        # the first test alone is over the budget
        "first": [(0, True, False, 150.0, "1", "")],
        "fast": [(0, True, False, 1.0, "1", ""), (1, True, False, 1.0, "2", "")],
    }
    assert _run(spark, logs) == {"late": "test_failed", "first": "success", "fast": "success"}
    assert _run(spark, logs, budget="watchdog") == {"late": "success", "first": None, "fast": "success"}
    assert _run(spark, logs, budget="strict") == {"late": "infinite_loop", "first": "infinite_loop", "fast": "success"}


def test_attempted_tests_stop_at_first_failure(spark):
    rows = [("t", "s", i, True, False, 1.0, out, "") for i, out in enumerate(["1", "x", "3"])]
    log = spark.createDataFrame(rows, SCHEMA)
    o = vd.test_outcomes(attach_expected(log, tests_from_tasks(_tasks(spark))))
    got = sorted(r.test_idx for r in attempted_tests(o).collect())
    assert got == [0, 1]
    sv = sample_verdicts(o).first()
    assert sv.first_fail_idx == 1 and sv.n_tests == 3


def test_a_sample_that_does_not_compile_ran_no_test(spark):
    log = spark.createDataFrame([("t", "s", 0, False, False, 0.0, None, None)], SCHEMA)
    o = vd.test_outcomes(attach_expected(log, tests_from_tasks(_tasks(spark))))
    assert attempted_tests(o).count() == 0
    sv = sample_verdicts(o).first()
    assert sv.first_fail_idx is None and sv.verdict == "compile_failed"


def test_every_sample_has_a_verdict_row(spark):
    rows = [("t", "whole", i, True, False, 1.0, str(i + 1), None) for i in range(3)]
    rows += [("t", "cut", 0, True, False, 1.0, "1", ""), ("t", "killed", 0, True, False, 99.0, "1", ""), ("t", "killed", 1, True, False, 9.0, "2", ""),
             ("t", "failed", 0, True, False, 1.0, "x", None)]
    log = spark.createDataFrame(rows, SCHEMA)
    samples = spark.createDataFrame([("t", c) for c in ("whole", "cut", "killed", "failed", "unlogged")], "task_id string, completion_id string")
    v = {r.completion_id: r.verdict for r in judge(log, tests_from_tasks(_tasks(spark)), samples=samples).collect()}
    # a missing stderr is an empty one; a log that ends early without a reason says nothing
    assert v == {"whole": "success", "cut": None, "killed": "success", "failed": "test_failed", "unlogged": None}


def test_verdict_label(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "c int")
    got = [r.l for r in df.select(verdict_label(F.col("c")).alias("l")).orderBy("c").collect()]
    assert got == ["success", "runtime_failed", "compile_failed", "infinite_loop", "test_failed", None, None]


def test_ties_round_by_the_binary_value(spark):
    rows = [("t", "a", 0, True, False, 1.0, "2.675", ""), ("t", "b", 0, True, False, 1.0, "1.45", "")]
    log = spark.createDataFrame(rows, SCHEMA)
    tests = spark.createDataFrame([("t", 0, "", "2.67")], "task_id string, test_idx int, input string, expected string")
    assert {r.completion_id: r.verdict for r in judge(log, tests).collect()} == {"a": "success", "b": "test_failed"}
