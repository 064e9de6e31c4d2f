"""Rounds of test-input generation, for all functions at once.

Each round asks the model once for every function that has too few new inputs so far: it draws
seeds from the function's pool as grown by the rounds before, sends a message, parses the reply
and appends the inputs that the pool does not hold. A function leaves once it has enough, and
all do after 21 rounds. So a round works on a shrinking set of functions, and needs the one
before; what it brings is stored, round by round, in a folder all machines share:

    <store>/round=3/replies/   the model's replies
    <store>/round=3/added/     the inputs appended
    <store>/_done/00003.json   written last, with how many functions are left

A job that is started again goes on after the last round that is done. Of a round that was cut
short, replies that were stored whole are used, so the model is not asked again.

The pool is never rewritten: a round reads the first pool and what all rounds added, for the
functions still at work alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from transeval import constants as K
from transeval.operators import generate as gn
from transeval.operators import testgen as tg
from transeval.sources import files

DONE = "_done"


def added_schema(key: StructField) -> StructType:
    return StructType([key, StructField("round_no", LongType()), StructField("line_no", LongType()), StructField("pos", LongType()),
                       StructField("input_text", StringType()), StructField("shown", StringType())])


def added_position(round_no: Column, line_no: Column) -> Column:
    """Where an appended input stands in its pool: after those of rounds and lines before."""
    return F.shiftleft(round_no.cast("long") + 1, 32) + line_no.cast("long")


def model_call(fn: Callable[[list[str]], list[str]], sentinel: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """How a round asks a model function ``fn(messages) -> replies``."""
    def ask(requests: DataFrame) -> DataFrame:
        return gn.generate(requests, fn, prompt="message", sentinel=sentinel, materialise=False).withColumnRenamed("output", "reply")

    return ask


def rounds_done(spark: SparkSession, store: str) -> list[dict]:
    """Records of the rounds that are done, from the first on without a gap."""
    out = []
    for name in files.children(spark, f"{store}/{DONE}"):
        if name == f"{len(out):05d}.json":
            out.append(json.loads(files.read_text(spark, f"{store}/{DONE}/{name}")))
    return out


def added_inputs(spark: SparkSession, store: str, key: StructField, rounds: int) -> DataFrame:
    """What rounds 0 to ``rounds`` - 1 have added."""
    schema = added_schema(key)
    if not rounds:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{store}/round={r}/added" for r in range(rounds)])


def unfinished(keys: DataFrame, added: DataFrame, num: int, key: str) -> DataFrame:
    """The keys for which fewer than ``num`` inputs have been added."""
    enough = added.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= num)
    return keys.join(enough, key, "left_anti")


def requests_of(tasks: DataFrame, pool: DataFrame, added: DataFrame, round_no: int, num: int, key: str = "task_id", code: str = "code",
                seeds: int = K.SEED_SAMPLE_SIZE) -> DataFrame:
    """key, round_no, message: one request for each function still at work."""
    active = unfinished(tasks.select(key).distinct(), added, num, key)
    columns = [key, F.col("pos").cast("long").alias("pos"), "input_text", "shown"]
    grown = pool.select(*columns).unionByName(added.select(*columns)).join(active, key, "left_semi")
    drawn = tg.seed_selection(grown, key, "pos", seeds, seed=round_no)
    asked = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(round_no)))
    return tg.seed_messages(tasks.join(active, key, "left_semi"), drawn, key, code, instruction=asked).withColumn("round_no", F.lit(round_no).cast("long"))


def fresh_inputs(replies: DataFrame, pool: DataFrame, added: DataFrame, key: str = "task_id") -> DataFrame:
    """The inputs of one round's replies that the pool, as grown, does not hold; of one that
    is repeated the first."""
    lines = tg.reply_lines(replies.select(key, "round_no", "reply")).select(key, "round_no", "line_no", "input_text", "shown")
    asked = replies.select(key).distinct()
    held = pool.select(key, "input_text").unionByName(added.select(key, "input_text")).join(asked, key, "left_semi")
    new = lines.join(held, [key, "input_text"], "left_anti")
    firsts = new.groupBy(key, "input_text").agg(F.min(F.struct("line_no", "round_no", "shown")).alias("f"))
    return firsts.select(key, F.col("f.round_no").cast("long").alias("round_no"), F.col("f.line_no").cast("long").alias("line_no"),
                         added_position(F.col("f.round_no"), F.col("f.line_no")).alias("pos"), "input_text", F.col("f.shown").alias("shown"))


def run_rounds(tasks: DataFrame, pool: DataFrame, ask: Callable[[DataFrame], DataFrame], num: int, store: str, *, key: str = "task_id",
               code: str = "code", rounds: int = K.TESTGEN_ROUNDS, seeds: int = K.SEED_SAMPLE_SIZE,
               accept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run rounds 0 to ``rounds`` until every function has ``num`` new inputs; returns all that
    were appended: key, round_no, line_no, pos, input_text, shown, new_rank, and ``returned``,
    which marks each function's first ``num``.

    ``tasks``: key and code, one row each; ``pool``: key, pos, input_text, shown (see
    ``testgen.with_inputs``). ``ask`` turns requests (key, round_no, message) into replies
    (key, round_no, reply); ``model_call`` makes one of a model function. ``accept`` keeps those
    of the new inputs that are valid, as running the function's contract on them would.
    """
    spark = tasks.sparkSession
    field = StructField(key, tasks.schema[key].dataType)
    done = rounds_done(spark, store)
    while len(done) <= rounds and not (done and done[-1]["left"] == 0):
        r = len(done)
        added = added_inputs(spark, store, field, r)
        folder = f"{store}/round={r}"
        replied = StructType([field, StructField("round_no", LongType()), StructField("reply", StringType())])
        if not files.exists(spark, f"{folder}/replies/_SUCCESS"):
            replies = ask(requests_of(tasks, pool, added, r, num, key, code, seeds))
            replies.select(F.col(key), F.col("round_no").cast("long").alias("round_no"), "reply").write.mode("overwrite").parquet(f"{folder}/replies")
        replies = spark.read.schema(replied).parquet(f"{folder}/replies")
        new = fresh_inputs(replies, pool, added, key)
        if accept is not None:
            new = accept(new).select(*new.columns)
        new.write.mode("overwrite").parquet(f"{folder}/added")
        grown = added_inputs(spark, store, field, r + 1)
        left = unfinished(tasks.select(key).distinct(), grown, num, key).count()
        files.create_only(spark, f"{store}/{DONE}/{r:05d}.json", json.dumps({"round": r, "left": left}))
        done = rounds_done(spark, store)
    grown = added_inputs(spark, store, field, len(done))
    # a function has the lines of at most 21 replies
    nth = F.row_number().over(Window.partitionBy(key).orderBy("round_no", "line_no")).cast("long") - 1
    return grown.withColumn("new_rank", nth).withColumn("returned", F.col("new_rank") < num)
