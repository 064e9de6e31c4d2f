"""Verdicts while tests arrive, against the batch operator."""

import random
import time

import pytest
from pyspark.sql import functions as F

from transeval.operators.verdict import judge
from transeval.streaming import arrivals as ar

LOG = ("model string, task_id string, completion_id string, test_idx int, compile_ok boolean, timed_out boolean, elapsed_s double, "
       "stdout string, stderr string")
TESTS = [("t", i, str(i)) for i in range(5)] + [("u", 0, "x")]


def log_rows(seed):
    """Samples of every kind, their rows in any order."""
    rng, rows, samples = random.Random(seed), [], []
    for k in range(40):
        key = (rng.choice(["m1", "m2"]), "t", f"{k}")
        kind = k % 5
        samples.append(key)
        if kind == 0:
            rows.append((*key, None, False, False, 0.0, None, "error"))
            continue
        fails = {1: set(), 2: {rng.randrange(5)}, 3: {1, 3}, 4: set()}[kind]
        n = 5 if kind != 4 else rng.randint(1, 4)  # the last kind is cut short
        for i in range(n):
            rows.append((*key, i, True, i in fails and i % 2 == 0, 1.0, "wrong" if i in fails else f" {i}.0 ", "" if i != 3 else "trace"))
    samples.append(("m1", "u", "0"))
    rows += [("m1", "u", "0", 0, True, False, 1.0, "x", "")] * 2  # a row that comes twice
    rng.shuffle(rows)
    return samples, rows


@pytest.fixture
def tests_table(spark):
    return spark.createDataFrame(TESTS, "task_id string, test_idx int, expected string")


def stream(spark, folder, tests, out, files=1, give_up="1 hour", groups=3):
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).parquet(f"{folder}/log")
    ar.write_arriving(ar.arriving_verdicts(log, tests, ["model"], give_up_after=give_up, groups=groups), f"{folder}/{out}", f"{folder}/state").awaitTermination()


def put(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def found(df):
    return sorted((r.model, r.task_id, r.completion_id, r.verdict) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_over_files_and_a_restart(spark, tests_table, tmp_path, seed):
    folder = str(tmp_path)
    samples, rows = log_rows(seed)
    cuts = [0, 30, 60, 90, len(rows)]
    for a, z in zip(cuts[:2], cuts[1:3], strict=True):
        put(spark, folder, rows[a:z])
    stream(spark, folder, tests_table, "verdicts")
    some = spark.read.parquet(f"{folder}/verdicts").count()
    for a, z in zip(cuts[2:4], cuts[3:], strict=True):
        put(spark, folder, rows[a:z])
    stream(spark, folder, tests_table, "verdicts")  # goes on from the checkpoint
    got = spark.read.parquet(f"{folder}/verdicts")
    want = judge(spark.createDataFrame(rows, LOG), tests_table, ["model"],
                 samples=spark.createDataFrame(samples, "model string, task_id string, completion_id string"))
    # those cut short without a failure have none yet; all others have one, once
    assert found(got) == [x for x in found(want) if x[3] is not None]
    assert 0 < some < got.count() and got.filter("not complete").count() == 0
    stream(spark, folder, tests_table, "verdicts")
    assert spark.read.parquet(f"{folder}/verdicts").count() == got.count()


def test_given_up_after_a_while_and_late_rows(spark, tests_table, tmp_path):
    folder = str(tmp_path)
    row = lambda c, i, out: ("m", "t", c, i, True, False, 1.0, out, "")
    put(spark, folder, [row("short", 0, "0"), row("gap", 2, "wrong"), *[row("all", i, str(i)) for i in range(5)]])
    stream(spark, folder, tests_table, "verdicts", give_up="1 second")
    assert found(spark.read.parquet(f"{folder}/verdicts")) == [("m", "t", "all", "success")]
    time.sleep(1.2)
    put(spark, folder, [row("new", 0, "wrong")])
    stream(spark, folder, tests_table, "verdicts", give_up="1 second")
    want = [("m", "t", "all", "success"), ("m", "t", "gap", "test_failed"), ("m", "t", "new", "test_failed"), ("m", "t", "short", None)]
    got = spark.read.parquet(f"{folder}/verdicts")
    assert sorted(found(got), key=repr) == sorted(want, key=repr)
    assert {r.completion_id for r in got.filter("not complete").collect()} == {"short", "gap"}
    # rows that come later make no second verdict
    put(spark, folder, [row("short", 1, "wrong"), row("gap", 0, "wrong")])
    stream(spark, folder, tests_table, "verdicts", give_up="1 second")
    assert spark.read.parquet(f"{folder}/verdicts").count() == 4


def test_what_is_held_of_a_sample():
    def events(*rows, planned=72):
        return [(planned << ar.PLANNED_AT) + (ar.NO_COMPILE if i is None else (i << 3) + c) for i, c in rows]

    def add(seen, *rows):
        [seen.add(e) for e in events(*rows)]
        return seen

    ok, failed = ar.CODES["success"], ar.CODES["test_failed"]
    seen = add(ar.Seen(), (70, ok), (3, failed))
    assert not seen.certain() and seen.verdict() == "test_failed" and seen.planned == 72
    again = add(ar.Seen.of(seen.row()), (0, ok), (1, ok), (2, ok))
    assert again.certain() and again.failed_at == 3 and again.passed >> 70 == 1
    add(seen, (1, failed))
    assert seen.failed_at == 1 and not seen.certain()
    broken = add(ar.Seen(), (0, ok), (None, 0))
    assert broken.certain() and broken.verdict() == "compile_failed"
    assert not ar.Seen().certain() and ar.Seen().verdict() is None


def test_equal_to_the_sql_of_certain_verdicts(spark):
    # a whole execution log, dealt to files so that no file holds all tests of a sample
    from transeval.plans.job_queries import JOB_QUERIES

    got = JOB_QUERIES["arriving_verdicts"](spark, "/root/testdata/sf0.001")
    assert got.count() == got.select("completion_id").distinct().count() > 0
    assert got.filter(F.col("verdict").isNull()).count() == 0
