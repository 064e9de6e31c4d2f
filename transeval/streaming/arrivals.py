"""Verdicts while the tests of a sample still arrive.

Log rows of a sample may come in any order, spread over files and batches. For each sample the
stream holds which tests have passed, the lowest failure and how many tests the task has, and
gives the verdict once, as soon as it is certain:

* it does not compile;
* a test has failed and all before it have passed;
* all tests of the task have passed.

A sample that gets no row for a while is given up: its verdict is what the rows that came say,
NULL if these neither failed nor were all (as ``operators.verdict.judge`` has it). Its state
stays for as long again after its verdict, so that late rows do not make a second one, and then
goes.

Everything up to the test's outcome is the batch operators' own column logic. What is held of a
sample is a bitmap of passed tests and a few numbers. Samples are dealt to groups by a hash, and
a group's samples are one state, so that a batch calls Python once for each group it touches; a
group grows with the samples that are open, not with those that a task or a model has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

from transeval import constants as K
from transeval.operators import verdict as vd

STATE = StructType([StructField("samples", BinaryType())])
#: Groups that samples are dealt to: so many that the open samples of one are some hundreds.
GROUPS = 2000
NO_FAILURE = -1
#: In an event the number of planned tests begins at this bit; below lies the test, or this.
PLANNED_AT = 34
NO_COMPILE = (1 << PLANNED_AT) - 1
CODES = {label: code for code, label in K.VERDICT_CODES.items() if label is not None}
LABELS = {code: label for label, code in CODES.items()}


class Seen:
    """What is known of one sample."""

    def __init__(self, passed: int = 0, failed_at: int = NO_FAILURE, failure: int = 0, planned: int = 0, given: bool = False, until: int = 0):
        self.passed, self.failed_at, self.failure, self.planned, self.given, self.until = passed, failed_at, failure, planned, given, until

    def row(self) -> list:
        """As it is stored; of a sample whose verdict has been given only that is kept."""
        if self.given:
            return ["", NO_FAILURE, 0, 0, True, self.until]
        return [f"{self.passed:x}", self.failed_at, self.failure, self.planned, False, self.until]

    @classmethod
    def of(cls, row: list) -> Seen:
        return cls(int(row[0] or "0", 16), *row[1:])

    def add(self, e: int) -> None:
        """What a log row tells, as ``event`` packs it."""
        self.planned = max(self.planned, e >> PLANNED_AT)
        test = e & ((1 << PLANNED_AT) - 1)
        idx, code = test >> 3, test & 7
        if test == NO_COMPILE:  # no test comes before this
            self.passed, self.failed_at, self.failure = 0, 0, CODES[K.COMPILE_FAILED]
        elif code == CODES[K.SUCCESS]:
            self.passed |= 1 << idx
        elif self.failed_at == NO_FAILURE or idx < self.failed_at:
            self.failed_at, self.failure = idx, code

    def certain(self) -> bool:
        if self.failed_at != NO_FAILURE:
            before = (1 << self.failed_at) - 1
            return self.passed & before == before
        return 0 < self.planned <= self.passed.bit_count()

    def verdict(self) -> str | None:
        if self.failed_at != NO_FAILURE:
            return LABELS[self.failure]
        return K.SUCCESS if 0 < self.planned <= self.passed.bit_count() else None


def load(state: GroupState) -> dict[tuple, Seen]:
    if not state.exists:
        return {}
    return {tuple(key): Seen.of(row) for key, row in json.loads(bytes(state.get[0]))}


def save(state: GroupState, held: dict[tuple, Seen], wait: int) -> None:
    if held:
        state.update((json.dumps([[key, seen.row()] for key, seen in held.items()]).encode(),))
        state.setTimeoutDuration(wait)
    elif state.exists:
        state.remove()


def event() -> Column:
    """A row of outcomes as one number: the task's number of tests above the test's position
    and outcome code, or NO_COMPILE in their place."""
    code = F.when(F.lit(False), F.lit(None))
    for label, c in CODES.items():
        code = code.when(F.col("outcome") == label, F.lit(c))
    test = F.when(~F.col("compile_ok"), F.lit(NO_COMPILE)).otherwise(F.shiftleft(F.col("test_idx").cast("long"), 3) + code)
    return F.shiftleft(F.coalesce("planned", F.lit(0)).cast("long"), PLANNED_AT) + test


def arriving_verdicts(log: DataFrame, tests: DataFrame, cfg: Sequence[str] = (), *, task_keys: Sequence[str] = ("task_id",),
                      give_up_after: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """Verdict rows (cfg..., task_id, completion_id, verdict, complete) of a stream of log rows,
    one for each sample. ``complete`` is false where a sample was given up, after
    ``give_up_after`` of processing time without a row. A sample's rows agree on whether it
    compiles; a row that comes twice counts once. ``groups`` stays as it is for as long as the
    stream's checkpoint is used."""
    keys = [*cfg, *vd.SAMPLE_KEYS]
    planned = tests.groupBy(*task_keys).agg(F.count(F.lit(1)).alias("planned"))
    outcomes = vd.test_outcomes(vd.attach_expected(log, tests, task_keys)).join(planned, list(task_keys), "left")
    # rows that neither fail to compile nor belong to a test tell nothing
    slim = (outcomes.select(*keys, event().alias("event")).filter(F.col("event").isNotNull())
            .withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups))))
    wait = int(pd.Timedelta(give_up_after).total_seconds() * 1000)
    out = StructType([*[log.schema[k] for k in keys], StructField("verdict", StringType()), StructField("complete", BooleanType())])
    names = out.fieldNames()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held, found = state.getCurrentProcessingTimeMs(), load(state), []
        if not state.hasTimedOut:
            touched = {}
            for rows in batches:
                for key, e in zip(zip(*[rows[k].tolist() for k in keys], strict=True), rows["event"].tolist(), strict=True):
                    seen = touched[key] = held.setdefault(key, Seen())
                    if not seen.given:
                        seen.add(e)
            for key, seen in touched.items():
                seen.until = now + wait
                if not seen.given and seen.certain():
                    found.append((*key, seen.verdict(), True))
                    seen.given = True
        for key, seen in list(held.items()):
            if seen.until <= now:
                if seen.given:
                    del held[key]
                else:
                    found.append((*key, seen.verdict(), False))
                    seen.given, seen.until = True, now + wait
        save(state, held, wait)
        if found:
            yield pd.DataFrame(dict(zip(names, zip(*found, strict=True), strict=True)))

    return slim.groupBy("_group").applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_arriving(verdicts: DataFrame, verdict_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start writing the verdicts. Each micro-batch replaces a partition named after it, so one
    that is run again after a failure leaves no verdict twice; the checkpoint holds the state.
    With ``available_now`` the query takes what is there and stops, to be started again."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(verdict_dir))

    writer = verdicts.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.trigger(processingTime="30 seconds").start()
    # time alone would make batches without end; samples are given up in the next batch with rows
    spark, key = verdicts.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
