"""Registered queries of jobs that store what they do: each writes tables of its own below the
shared folder, which the supplied tables determine, and returns what is read back. So they run
jobs when they are called, unlike those of ``plans.queries``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transeval import constants as K
from transeval import jobs
from transeval.operators import results as rs
from transeval.operators import rounds as rd
from transeval.plans.oracle import BC, BS, BT, BX, NEW, ORACLE, POOL, RLINES, chars, lit, with_
from transeval.plans.queries import r6
from transeval.session import checkpoint_dir
from transeval.sources import bindings as B
from transeval.sources import samples as sm
from transeval.streaming import arrivals as ar

JOB_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
JOB_ORACLE: dict[str, str] = {}


def query(fn):
    JOB_QUERIES[fn.__name__] = fn
    return fn


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- rounds of input generation

#: Rounds 0 to this one, which reach the last turns of the conversations.
LAST_ROUND, WANTED = 7, 3


def _rounds(spark, sf):
    """Tasks that have a conversation; its assistant turns are the model's replies, one for the
    round of their number."""
    replies = B.input_replies(spark, sf)
    known = B.sample_tasks(spark, sf)
    store = scratch(spark, "rounds")
    # the rounds read both again and again: tables, as a store of tasks and pools has them
    tasks = _written(B.tasks(spark, sf).join(known, "task_id", "left_semi").select("task_id", "code"), f"{store}/tasks")
    pool = _written(B.input_pool(spark, sf).join(known, "task_id", "left_semi"), f"{store}/pool")
    replies = _written(replies.select("task_id", F.col("round_no").cast("long").alias("round_no"), "reply"), f"{store}/scripted")

    def ask(requests):
        return requests.join(replies, ["task_id", "round_no"])

    added = rd.run_rounds(tasks, pool, ask, WANTED, store, rounds=LAST_ROUND)
    return tasks, pool, store, added


@query
def generation_rounds(spark, sf):
    _, _, _, added = _rounds(spark, sf)
    return added.select("task_id", "input_text", "round_no", "line_no", "new_rank", "returned")


@query
def generation_requests(spark, sf):
    """The messages of all rounds, whose seeds come from the pool as grown by those before."""
    tasks, pool, store, _ = _rounds(spark, sf)
    out = None
    for r in range(len(rd.rounds_done(spark, store))):
        added = rd.added_inputs(spark, store, tasks.schema["task_id"], r)
        asked = rd.requests_of(tasks, pool, added, r, WANTED).select("task_id", "round_no", F.md5("message").alias("message_md5"))
        out = asked if out is None else out.unionByName(asked)
    return out


_KNOWN = "known as (select distinct cast(conv_id as varchar) as task_id from conversations)"
_RUN = """run as (select newi.* from newi where round_no <= {last} and task_id in (select task_id from known) and task_id in (select task_id from bt))""".format(last=LAST_ROUND)
JOB_ORACLE["generation_rounds"] = with_(BT, BS, POOL, RLINES, NEW, _KNOWN, _RUN) + """
select task_id, input_text, cast(round_no as bigint) as round_no, cast(line_no as bigint) as line_no, new_rank, returned from run"""
_INSTR = "[" + ", ".join(lit(t) for t in K.TESTGEN_INSTRUCTIONS) + "]"
JOB_ORACLE["generation_requests"] = with_(BT, BS, POOL, RLINES, NEW, _KNOWN, _RUN) + f"""
, t as (select bt.* from bt where task_id in (select task_id from known)),
ex as (select t.task_id, t.code, cast(r as bigint) as r from t, range({LAST_ROUND + 1}) rr(r)
       where (select count(*) from run where run.task_id = t.task_id and run.round_no < r) < {WANTED}),
grown as (select task_id, cast(pos as bigint) as pos, shown, -1 as since from pool
          union all select task_id, (cast(round_no as bigint) + 1) * 4294967296 + line_no, substr(input_text, 2, length(input_text) - 2), round_no from run),
seeds as (select ex.task_id, ex.r, shown, row_number() over (partition by ex.task_id, ex.r order by md5(ex.task_id || ':' || cast(pos as varchar) || ':' || ex.r), pos) as n
          from ex join grown on ex.task_id = grown.task_id and grown.since < ex.r),
st as (select task_id, r, string_agg(shown, chr(10) order by n) as s from seeds where n <= 5 group by task_id, r)
select ex.task_id, ex.r as round_no, md5({lit(K.TESTGEN_HEADER)} || ex.code || chr(10) || '```' || {lit(K.TESTGEN_EXAMPLES)} || coalesce(st.s, '')
       || chr(10) || '```' || chr(10) || {_INSTR}[cast(('0x' || substr(md5(ex.task_id || ':' || ex.r), 1, 8))::bigint % 3 as integer) + 1]) as message_md5
from ex left join st on ex.task_id = st.task_id and ex.r = st.r"""


# ---------------------------------------------------------------- stores


@query
def keyed_append(spark, sf):
    """Samples written in overlapping batches, the last one twice; the first text of each stays."""
    s = B.samples(spark, sf).select(F.concat(F.lit("0"), F.col("conv_id") % 3).alias("model"), "task_id", F.col("completion_idx").alias("idx"), "solution")
    store = scratch(spark, "samples")
    sm.append_samples(s.filter("idx <= 3"), store, ["model"])
    later = s.filter("idx > 1").withColumn("solution", F.concat(F.lit("later "), F.col("solution")))
    for _ in range(2):
        sm.append_samples(later, store, ["model"])
    return sm.stored_samples(spark, store).select("model", "task_id", "idx", F.md5("solution").alias("solution_md5"))


JOB_ORACLE["keyed_append"] = with_(BS) + """
select '0' || conv_id % 3 as model, task_id, completion_idx as idx, md5(case when completion_idx <= 3 then '' else 'later ' end || solution) as solution_md5 from bs"""


@query
def versioned_results(spark, sf):
    """Verdicts of all segments, then those of two of them again; each segment's newest stays.
    Names and temperatures that look like numbers come back as they were."""
    v = B.board_verdicts(spark, sf).withColumn("temperature", F.when(F.col("model") < "F", "0.20").otherwise("007"))
    store, cfg = scratch(spark, "versions"), ["model", "temperature"]
    rs.write_versioned(v, store, cfg)
    again = v.filter(F.col("model").isin("BUILDING", "MACHINERY")).withColumn("verdict", F.when(F.col("task_id").endswith("1"), None).otherwise(F.col("verdict")))
    rs.write_versioned(again, store, cfg)
    return rs.read_latest(spark, store, cfg).groupBy(*cfg, "version").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("verdict") == K.SUCCESS).alias("n_success"), F.count_if(F.col("verdict").isNull()).alias("n_unknown"))


JOB_ORACLE["versioned_results"] = with_(BC) + """
, v as (select model, case when model < 'F' then '0.20' else '007' end as temperature, task_id, model in ('BUILDING', 'MACHINERY') as again,
               case when model in ('BUILDING', 'MACHINERY') and task_id like '%1' then null else verdict end as verdict from bc)
select model, temperature, cast(case when again then 2 else 1 end as bigint) as version, count(*) as n_rows,
       count(*) filter (where verdict = 'success') as n_success, count(*) filter (where verdict is null) as n_unknown
from v group by all"""


@query
def stored_evaluation(spark, sf):
    """The evaluation of ``evaluate_run`` as the job that stores it: judged once and read back."""
    samples, tasks, log = B.evaluation(spark, sf)
    e = jobs.evaluate_into(scratch(spark, "evaluation"), samples, tasks, B.tests(spark, sf), log, ["model"], budget="watchdog")
    n = e.verdicts.groupBy("model").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("verdict").isNull()).alias("n_unknown"),
                                        F.count_if(F.col("verdict") == K.SUCCESS).alias("n_success"))
    p = e.problems.groupBy("model").agg(F.count(F.lit(1)).alias("n_problems"))
    b = e.board.filter("k = 1").select("model", r6(F.col("pass_at_k")).alias("pass_at_1"))
    return n.join(p, "model", "left").join(b, "model", "left").withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))


JOB_ORACLE["stored_evaluation"] = ORACLE["evaluate_run"]


# ---------------------------------------------------------------- sample trees


@query
def sample_tree(spark, sf):
    """Samples written as a tree of files, some empty, and read back: two of three models."""
    s = B.samples(spark, sf)
    named = s.select(F.lit("codenet").alias("dataset"), F.concat(F.lit("model "), F.col("conv_id") % 3).alias("model"), F.lit("Java").alias("source_lang"),
                     F.lit("Python").alias("target_lang"), F.lit("0.20").alias("temperature"), F.when(F.col("conv_id") % 2 == 0, "raw").otherwise("sanitized").alias("stage"),
                     "task_id", F.col("completion_idx").alias("idx"), F.lit(".py").alias("ext"),
                     F.when(F.col("completion_idx") % 5 == 0, "").otherwise(F.col("solution")).alias("solution"))
    root = scratch(spark, "tree")
    sm.export_sample_tree(named, root, shared_mount=True)
    back = sm.read_sample_tree(spark, root, "Python").filter(F.col("model").isin("model 0", "model 2"))
    return back.select("dataset", "model", "temperature", "stage", "task_id", "completion_id", F.md5("solution").alias("solution_md5"))


JOB_ORACLE["sample_tree"] = with_(BS) + """
select 'codenet' as dataset, 'model ' || conv_id % 3 as model, '0.20' as temperature, case when conv_id % 2 = 0 then 'raw' else 'sanitized' end as stage,
       task_id, completion_id, md5(case when completion_idx % 5 = 0 then '' else solution end) as solution_md5
from bs where conv_id % 3 <> 1"""


# ---------------------------------------------------------------- verdicts as tests arrive

#: Files the log is dealt to, and of these in one batch: no file holds all tests of a sample.
LOG_FILES, FILES_A_BATCH = 6, 3


@query
def arriving_verdicts(spark, sf):
    """The execution log as files that arrive one after another, a sample's rows spread over
    them: the verdicts that are certain once all files are there."""
    where = scratch(spark, "arriving")
    log = B.exec_log(spark, sf).select("task_id", "completion_id", "test_idx", "compile_ok", "timed_out", "elapsed_s", "stdout", "stderr")
    log.repartition(LOG_FILES, F.xxhash64("completion_id", "test_idx")).write.parquet(f"{where}/log")
    tests = B.tests(spark, sf).select("task_id", "test_idx", "expected")
    tests.write.parquet(f"{where}/tests")
    tests = spark.read.schema(tests.schema).parquet(f"{where}/tests")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(f"{where}/log")
    ar.write_arriving(ar.arriving_verdicts(stream, tests), f"{where}/verdicts", f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/verdicts").select("task_id", "completion_id", "verdict", "complete")


JOB_ORACLE["arriving_verdicts"] = with_(BX) + """
, s as (select task_id, completion_id, bool_and(compile_ok) as compiles, count(*) as n, min(test_idx) filter (where outcome <> 'success') as first_at,
               min_by(outcome, test_idx) filter (where outcome <> 'success') as failure from bx_out group by all),
p as (select task_id, count(*) as planned from bx_tests group by task_id)
select s.task_id, completion_id, case when not compiles then 'compile_failed' else coalesce(failure, 'success') end as verdict, true as complete
from s join p on s.task_id = p.task_id where not compiles or first_at is not null or n >= planned"""
