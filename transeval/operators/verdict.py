"""Verdicts from an execution log.

The evaluator runs each sample's program on the task's tests in order and keeps the
first failure. Running programs is outside Spark; what arrives here is one row per
attempted ``(sample, test)``:

``exec_log``: cfg..., task_id, completion_id, test_idx (NULL for a compile-only row),
compile_ok, timed_out, elapsed_s, stdout, stderr (string or binary)

``tests``: task_id, test_idx, expected  (the task's ``test_IO`` exploded by position)

Steps: tests joined by position -> one outcome per test -> the first non-success outcome
per sample (a hash aggregate with map-side partial aggregation, so a hot sample is fine).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from transeval import constants as K
from transeval.functions.compare import with_expected_parts, with_outputs_match

SAMPLE_KEYS = ["task_id", "completion_id"]


def _text_and_valid(df: DataFrame, name: str) -> tuple[Column, Column]:
    """Decoded text and a "decodes as UTF-8" flag for a string or binary column."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, BinaryType):
        s = c.cast("string")
        return s, F.coalesce(F.is_valid_utf8(s), F.lit(True))
    return c, F.lit(True)


def tests_from_tasks(tasks: DataFrame, task_keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """``tasks.test_io`` (array<struct<input, output>>) -> one row per test position."""
    return tasks.select(*task_keys, F.posexplode("test_io").alias("test_idx", "t")).select(
        *task_keys, F.col("test_idx").cast("int").alias("test_idx"),
        F.col("t.input").alias("input"), F.col("t.output").alias("expected"))


def attach_expected(exec_log: DataFrame, tests: DataFrame, task_keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Each executed test gets the expected output of its position (left join: a log row
    never disappears; a missing expected output simply cannot match). The expected text
    is parsed here, once per test, before the join multiplies it by the samples."""
    t = with_expected_parts(tests.select(*task_keys, "test_idx", "expected"))
    return exec_log.join(t, on=[*task_keys, "test_idx"], how="left")


def test_outcomes(compared: DataFrame) -> DataFrame:
    """Add ``matched`` and ``outcome`` for every executed test.

    compile error -> compile_failed; per-test timeout -> infinite_loop; output match ->
    success; undecodable stderr -> compile_failed (the evaluator's decode raises);
    empty or missing stderr -> test_failed; else runtime_failed.
    """
    out, out_ok = _text_and_valid(compared, "stdout")
    return _outcome(with_outputs_match(compared.withColumn("_out", out), "_out", "expected", "_match", out_ok).drop("_out"))


def test_outcomes_once(exec_log: DataFrame, tests: DataFrame, task_keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """``test_outcomes`` of the log with its expected outputs, where each output of a test is
    compared once, however many samples have printed it: the distinct (task, test, output) are
    judged, and rows find their judgement by 128 bits of the output's hash, so outputs travel
    once. What a test's outputs share is left to the join: a judgement is a few bytes, so it is
    broadcast, or a part of the log that is skewed is split, as AQE measures it."""
    by = [*task_keys, "test_idx"]
    marks = {"_o1": F.xxhash64("stdout"), "_o2": F.xxhash64(F.lit(1), F.col("stdout"))}
    marked = exec_log.withColumns(marks)
    different = marked.filter(F.col("test_idx").isNotNull()).select(*by, "stdout", *marks).distinct()
    compared = attach_expected(different, tests, task_keys)
    out, out_ok = _text_and_valid(compared, "stdout")
    judged = with_outputs_match(compared.withColumn("_out", out), "_out", "expected", "_match", out_ok).select(*by, *marks, "_match")
    expected = tests.select(*by, "expected")
    back = marked.join(judged, [*by, *marks], "left").join(expected, by, "left").drop(*marks)
    return _outcome(back.withColumn("_match", F.coalesce("_match", F.lit(False))))


def _outcome(judged: DataFrame) -> DataFrame:
    """``matched`` and ``outcome`` from the column ``_match``."""
    err, err_ok = _text_and_valid(judged, "stderr")
    err = F.coalesce(err, F.lit(""))
    outcome = (F.when(~F.col("compile_ok"), F.lit(K.COMPILE_FAILED))
               .when(F.col("timed_out"), F.lit(K.INFINITE_LOOP))
               .when(F.col("matched"), F.lit(K.SUCCESS))
               .when(~err_ok, F.lit(K.COMPILE_FAILED))
               .when(err == "", F.lit(K.TEST_FAILED))
               .otherwise(F.lit(K.RUNTIME_FAILED)))
    return (judged.withColumn("matched", F.when(F.col("test_idx").isNotNull(), F.col("_match"))).drop("_match")
                  .withColumn("outcome", F.when(F.col("test_idx").isNotNull() | ~F.col("compile_ok"), outcome)))


_CODE = {label: code for code, label in K.VERDICT_CODES.items() if label is not None}


def _first(cond: Column, outcome: Column) -> Column:
    """(lowest test_idx satisfying ``cond``, its outcome) packed as ``test_idx * 8 + code``:
    a fixed-width ``min``, so the aggregate stays a partial hash aggregate."""
    code = F.when(F.lit(False), F.lit(None))
    for label, c in _CODE.items():
        code = code.when(outcome == label, F.lit(c))
    return F.min(F.when(cond, F.col("test_idx").cast("long") * 8 + code))


def _first_idx(packed: Column) -> Column:
    return F.shiftright(packed, 3).cast("int")


def _first_outcome(packed: Column) -> Column:
    m = F.create_map(*[x for label, c in _CODE.items() for x in (F.lit(c), F.lit(label))])
    return F.try_element_at(m, (packed % 8).cast("int"))


def _elapsed() -> Column:
    """Running times are summed as decimals: the same in any order of addition."""
    return F.coalesce(F.col("elapsed_s"), F.lit(0.0)).cast("decimal(28,9)")


def sample_verdicts(outcomes: DataFrame, cfg: Sequence[str] = (), keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """First failure decides; all passed -> success; compile error -> compile_failed, and no
    test ran, so there is no first failing one; no tests at all -> NULL (the evaluator's
    "unknown")."""
    keys = [*cfg, *keys]
    ok = F.col("outcome") == K.SUCCESS
    agg = outcomes.groupBy(*keys).agg(
        F.max((~F.col("compile_ok")).cast("int")).alias("_cfail"),
        F.count("test_idx").alias("n_tests"),
        F.sum(_elapsed()).alias("elapsed_s"),
        _first(~ok & F.col("test_idx").isNotNull(), F.col("outcome")).alias("_ff"),
    )
    cfail = F.col("_cfail") == 1
    verdict = (F.when(cfail, F.lit(K.COMPILE_FAILED))
               .when(F.col("n_tests") == 0, F.lit(None).cast("string"))
               .otherwise(F.coalesce(_first_outcome(F.col("_ff")), F.lit(K.SUCCESS))))
    return agg.select(*keys, "n_tests", "elapsed_s", F.when(~cfail, _first_idx(F.col("_ff"))).alias("first_fail_idx"), verdict.alias("verdict"))


def attempted_tests(outcomes: DataFrame, cfg: Sequence[str] = (), keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """Tests the evaluator actually ran: up to and including the first failure, and none of a
    sample that does not compile. A sample's tests are few, so its first failure is found
    beside them, in the partitioning the sample has."""
    w = Window.partitionBy(*cfg, *keys)
    seen = (outcomes.withColumn("first_fail_idx", F.min(F.when(F.col("outcome") != K.SUCCESS, F.col("test_idx"))).over(w))
            .withColumn("_cfail", F.max((~F.col("compile_ok")).cast("int")).over(w)))
    ran = F.col("test_idx").isNotNull() & (F.col("_cfail") == 0)
    return seen.filter(ran & (F.col("first_fail_idx").isNull() | (F.col("test_idx") <= F.col("first_fail_idx")))).drop("_cfail")


def budget_verdicts(outcomes: DataFrame, cfg: Sequence[str] = (), keys: Sequence[str] = SAMPLE_KEYS,
                    budget_s: float = K.SAMPLE_BUDGET_S) -> DataFrame:
    """Verdicts under the whole-sample time budget, three ways.

    * ``verdict``            -- per-test rules only (budget ignored);
    * ``verdict_watchdog``  -- what the evaluator records: a watchdog kills the sample when
      the running time passes the budget and the last stored value stands, so tests
      finishing after the budget are ignored; no test finished in time -> NULL;
    * ``verdict_strict``     -- the first test that ends past the budget is an infinite loop.
    """
    keys = [*cfg, *keys]
    tests = outcomes.filter(F.col("test_idx").isNotNull())
    w = Window.partitionBy(*keys).orderBy("test_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = tests.withColumn("elapsed_cum", F.sum(_elapsed()).over(w))
    within = F.col("elapsed_cum") <= F.lit(budget_s).cast("decimal(28,9)")
    ok = F.col("outcome") == K.SUCCESS
    strict_outcome = F.when(~within, F.lit(K.INFINITE_LOOP)).otherwise(F.col("outcome"))
    agg = timed.groupBy(*keys).agg(
        F.max((~F.col("compile_ok")).cast("int")).alias("_cfail"),
        F.count(F.lit(1)).alias("n_tests"),
        F.sum(_elapsed()).alias("elapsed_s"),
        _first(~ok, F.col("outcome")).alias("_ff"),
        F.count(F.when(within, 1)).alias("_n_within"),
        _first(~ok & within, F.col("outcome")).alias("_ffw"),
        _first(~ok | ~within, strict_outcome).alias("_ffs"),
    )
    cfail = F.col("_cfail") == 1
    return agg.select(
        *keys, "n_tests", "elapsed_s",
        F.when(cfail, F.lit(K.COMPILE_FAILED)).otherwise(F.coalesce(_first_outcome(F.col("_ff")), F.lit(K.SUCCESS))).alias("verdict"),
        F.when(cfail, F.lit(K.COMPILE_FAILED)).when(F.col("_n_within") == 0, F.lit(None).cast("string"))
         .otherwise(F.coalesce(_first_outcome(F.col("_ffw")), F.lit(K.SUCCESS))).alias("verdict_watchdog"),
        F.when(cfail, F.lit(K.COMPILE_FAILED)).otherwise(F.coalesce(_first_outcome(F.col("_ffs")), F.lit(K.SUCCESS))).alias("verdict_strict"),
    )


def judge(exec_log: DataFrame, tests: DataFrame, cfg: Sequence[str] = (), *, samples: DataFrame | None = None,
          task_keys: Sequence[str] = ("task_id",), budget: str | None = None,
          budget_s: float = K.SAMPLE_BUDGET_S, once: bool = False) -> DataFrame:
    """exec_log + tests -> verdict rows ``(cfg..., task_id, completion_id, verdict)``.

    ``budget``: None (per-test rules), ``"watchdog"`` or ``"strict"`` (see ``budget_verdicts``).
    With ``samples`` there is one row for each of them: a sample without any log row has a
    NULL verdict, and so has one whose log ends before its last test although neither a
    failure nor the time budget ended the run. ``once`` compares equal outputs of a test once,
    which pays where samples repeat each other and outputs are long.
    """
    keys = [*cfg, *SAMPLE_KEYS]
    outcomes = test_outcomes_once(exec_log, tests, task_keys) if once else test_outcomes(attach_expected(exec_log, tests, task_keys))
    if budget is None:
        v = sample_verdicts(outcomes, cfg).select(*keys, "n_tests", "elapsed_s", "verdict")
    else:
        col = {"watchdog": "verdict_watchdog", "strict": "verdict_strict"}[budget]
        timed = budget_verdicts(outcomes, cfg, budget_s=budget_s).select(*keys, "n_tests", "elapsed_s", F.col(col).alias("verdict"))
        # samples whose log holds no test rows: compile-only rows
        rest = sample_verdicts(outcomes.filter(F.col("test_idx").isNull()), cfg).select(*keys, "n_tests", "elapsed_s", "verdict")
        v = timed.unionByName(rest.join(timed.select(*keys), on=keys, how="left_anti"))
    if samples is None:
        return v.select(*keys, "verdict")
    planned = tests.groupBy(*task_keys).agg(F.count(F.lit(1)).alias("_planned"))
    cut = ((F.col("verdict") == K.SUCCESS) & (F.col("n_tests") < F.col("_planned"))
           & (F.col("elapsed_s") <= F.lit(budget_s).cast("decimal(28,9)")))
    out = samples.select(*dict.fromkeys([*keys, *task_keys])).join(v, on=keys, how="left").join(planned, on=list(task_keys), how="left")
    return out.select(*keys, F.when(~F.coalesce(cut, F.lit(False)), F.col("verdict")).alias("verdict"))


def verdict_label(code) -> Column:
    """Integer verdict code -> label; unknown codes -> NULL."""
    m = F.create_map(*[x for k, v in K.VERDICT_CODES.items() if v is not None for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, code.cast("int") if isinstance(code, Column) else F.lit(code))
