"""Canonical tables derived from the supplied test data.

The supplied parquet tables contain no code samples, so each canonical table gets a
stand-in with the same shape. Every mapping here is mirrored in SQL in
``transeval.plans.oracle`` so that both engines see the same rows.

* tasks     <- documents   (doc_id -> task_id, text -> code, lang -> language)
* samples   <- conversations, assistant turns (conv_id -> task_id, turn -> completion)
* verdicts  <- events      (user_id -> task, event_id -> completion, event_type -> verdict)
* board     <- orders x customer (segment -> model, customer -> task, status F -> success)
* exec_log  <- lineitem x orders (order -> sample, line -> test, columns -> outcome inputs)
* compile   <- documents x labels (quality -> compiles)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transeval.functions.text import py_strip
from transeval.operators.testgen import with_inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# natural language of a document -> programming language of the stand-in task
LANG_MAP = [("en", "Python"), ("fr", "Java"), ("de", "C++"), ("es", "Go")]


def language_of(col) -> F.Column:
    expr = F.when(F.lit(False), F.lit(None))
    for nat, prog in LANG_MAP:
        expr = expr.when(col == nat, F.lit(prog))
    return expr.otherwise(F.lit("C"))


def tasks(spark: SparkSession, sf_dir: str, language: str | None = None) -> DataFrame:
    """Tasks; a ``language`` filter is applied to the stored column so it reaches the scan."""
    d = table(spark, sf_dir, "documents")
    if language is not None:
        natural = [nat for nat, prog in LANG_MAP if prog == language]
        if natural:
            d = d.filter(F.col("lang") == natural[0])
        else:  # the catch-all language: every natural language not in the map
            d = d.filter(~F.col("lang").isin(*[nat for nat, _ in LANG_MAP]))
    return d.select(F.col("doc_id").cast("string").alias("task_id"),
                    language_of(F.col("lang")).alias("language"),
                    F.col("text").alias("code"), "source", "doc_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return c.select(
        F.col("conv_id").cast("string").alias("task_id"),
        F.col("turn").cast("string").alias("completion_id"),
        F.col("turn").cast("int").alias("completion_idx"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".py")).alias("identifier"),
        F.col("text").alias("solution"),
        "conv_id",
    )


def sample_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task list of the sample binding: every conversation id."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("task_id")).distinct()


VERDICT_OF_EVENT = [("purchase", "success"), ("error", "runtime_failed"), ("click", "test_failed"),
                    ("view", "infinite_loop"), ("signup", "compile_failed")]


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as verdict rows; an event with value < 1 stands for an unknown (NULL) verdict."""
    e = table(spark, sf_dir, "events")
    v = F.when(F.lit(False), F.lit(None))
    for et, verdict in VERDICT_OF_EVENT:
        v = v.when(F.col("event_type") == et, F.lit(verdict))
    return e.select(
        F.col("user_id").cast("string").alias("task_id"),
        F.col("event_id").cast("string").alias("completion_id"),
        F.when(F.col("value") < 1.0, F.lit(None).cast("string")).otherwise(v).alias("verdict"),
        "event_id", "user_id", "ts", "props", "value",
    )


def board_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select(
        F.col("c_mktsegment").alias("model"),
        F.col("o_custkey").cast("string").alias("task_id"),
        F.col("o_orderkey").cast("string").alias("completion_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("success")).otherwise(F.lit("test_failed")).alias("verdict"),
    )


TEST_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


def _expected(task_key, test_idx) -> F.Column:
    """Two decimal places; for one task in ten, 26."""
    v = (task_key * 31 + test_idx * 17) % 100000
    plain = F.concat(F.floor(v / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))
    small = F.concat(F.lit("0." + "0" * 21), F.lpad(v.cast("string"), 5, "0"))
    return F.when(task_key % 10 == 3, small).otherwise(plain)


def exec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders as an execution log; the test position is the line's rank in its
    order (an order has a few lines)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *TEST_ORDER, "l_discount", "l_tax", "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    ranked = li.withColumn("test_idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*TEST_ORDER)) - 1)
    j = ranked.join(o, ranked.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        F.col("o_custkey"), F.col("l_orderkey"),
        F.col("o_custkey").cast("string").alias("task_id"),
        F.col("l_orderkey").cast("string").alias("completion_id"),
        F.col("test_idx").cast("int").alias("test_idx"),
        (F.col("o_orderpriority") != "5-LOW").alias("compile_ok"),
        (F.col("l_tax") == 0.08).alias("timed_out"),
        F.col("l_quantity").alias("elapsed_s"),
        F.when(F.col("l_linestatus") == "F", F.lit("")).otherwise(F.lit("Traceback: error")).alias("stderr"),
        F.round(F.col("l_discount") * 100).cast("int").alias("variant"),
    )


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of each task (customer): as many positions as the longest of its samples
    has lines, with an expected output each."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.max("n").alias("n"))
    t = c.select("o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("test_idx"))
    return t.select(F.col("o_custkey").cast("string").alias("task_id"), F.col("test_idx").cast("int").alias("test_idx"),
                    F.lit("").alias("input"), _expected(F.col("o_custkey"), F.col("test_idx")).alias("expected"))


def exec_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution log with the program output made from the expected output by ``variant``:
    among others decimal ties, and outputs with one decimal place fewer or more. The expected
    output is a column of its own: made anew in each branch, it is more code than the JVM
    compiles."""
    r = exec_rows(spark, sf_dir).withColumn("_exp", _expected(F.col("o_custkey"), F.col("test_idx")))
    exp = F.col("_exp")
    whole = F.floor((((F.col("o_custkey") * 31 + F.col("test_idx") * 17) % 100000)) / 100).cast("bigint")
    d = F.col("variant")
    stdout = (F.when(d == 1, F.concat(exp, F.lit("\n")))
              .when(d == 2, F.concat(exp, F.lit("3")))
              .when(d == 3, whole.cast("string"))
              .when(d == 4, (whole + 1).cast("string"))
              .when(d == 5, F.concat(exp, F.lit("9")))
              .when(d == 6, F.concat(F.lit("Error: "), exp))
              .when(d == 7, F.concat(F.lit("  "), exp, F.lit("  ")))
              .when(d == 8, F.concat(F.lit("-"), exp))
              .when(d == 9, F.replace(exp, F.lit("."), F.lit(",")))
              .when(d == 10, F.left(exp, F.length(exp) - 1))
              .when(F.col("test_idx") % 2 == 0, F.concat(exp, F.lit("5")))
              .otherwise(exp))
    return r.withColumn("stdout", stdout).drop("variant", "_exp")


def evaluation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, tasks and log of whole runs. A run is a market segment, its samples the
    orders of the segment's customers. Every eleventh order has no log, and the runs of two
    segments list all their customers as tasks, with or without orders."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("model"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    samples = o.select("model", F.col("o_custkey").cast("string").alias("task_id"), F.col("o_orderkey").cast("string").alias("completion_id"), "o_orderkey")
    full = c.filter(F.col("model").isin("BUILDING", "MACHINERY")).select("model", F.col("c_custkey").cast("string").alias("task_id"))
    tasks = full.unionByName(samples.select("model", "task_id")).distinct()
    logged = samples.filter(F.col("o_orderkey") % 11 != 0).select("model", "task_id", "completion_id")
    log = exec_log(spark, sf_dir).join(logged, on=["task_id", "completion_id"])
    return samples.drop("o_orderkey"), tasks, log


def compile_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x labels: a labelled document's quality flag plays "compiles"."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").cast("string").alias("task_id"), F.lit("0").alias("completion_id"),
                      (F.col("quality") == 1).alias("compile_ok"), "doc_id")


# model whose output path a reply sits under, by doc_id % 10
REPLY_MODELS = ["code-llama-13b", "magicoder-s-ds-6.7b", "octocoder", "mixtral-8x7b-instruct", "phi2",
                "gpt-4", "gemini-pro", "claude-3-opus", "deepseek-coder-6.7b-instruct", "starcoder"]


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies: even documents wrapped in every model's markers, odd ones bare."""
    t = tasks(spark, sf_dir)
    lang = F.col("language")
    tag = F.when(F.lower(lang) == "c++", F.lit("cpp")).otherwise(F.lower(lang))
    decorated = F.concat(F.lit("Here is the code.\n"), lang, F.lit(":\n"), lang, F.lit("\n@@ Response\nAnswer:\nOutput:\n```"),
                         tag, F.lit("\n"), F.col("code"), F.lit("\n```\nNote: end"))
    model = F.element_at(F.array(*[F.lit(m) for m in REPLY_MODELS]), (F.col("doc_id") % 10 + 1).cast("int"))
    return t.select(
        "task_id", "doc_id", F.col("language").alias("target_lang"),
        F.when(F.col("doc_id") % 2 == 0, decorated).otherwise(F.col("code")).alias("solution"),
        F.concat(F.lit("translations/codenet/"), model, F.lit("/Java/"), lang, F.lit("/temperature_0.2")).alias("path"),
    )


# aliases looked up in the model registry, by doc_id % len (valid, prefix-matched and invalid names)
ALIASES = ["codegen-2b", "codegen2-16b", "santacoder", "incoder-1b", "polycoder", "gpt-4-0125-preview",
           "gpt-3.5-turbo", "claude-3-opus-20240229", "gemini-pro", "starcoder2-15b", "codet5p-16b",
           "code-llama-13b", "code-llama-70", "deepseek-coder-6.7b-instruct", "deepseek-coder-33b-base",
           "deepseek-coder-1.30b-instruct", "deepseek-coder-xb", "wizardcoder-33b", "zephyr-7b", "mistral-7b",
           "dolphin-2.6", "solar-10.7b-instruct", "mistral-hermes-codepro-7b", "phi-2", "Mixtral-8x7B-Instruct",
           "octocoder", "magicoder-s-cl-7b", "gpt-j", "gptneo-2b", "stablelm-7b", "phind-code-llama-34b-v2",
           "codebooga-34b", "unknown-model"]
# decoder families and tokenizer limits used for the token-budget rows
BUDGET_FAMILIES = ["hf", "vllm", "deepseek_instruct", "santacoder", "incoder", "codet5p"]
TOKENIZER_LIMITS = [2048, 100000, 10000000]


def input_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's input pool: for each non-blank line of its document the pair of its length
    and number, and one list in front."""
    t = tasks(spark, sf_dir)
    lines = t.select("task_id", "doc_id", F.posexplode(F.split(F.col("code"), "\n", -1)).alias("pos", "line"))
    pairs = lines.filter(py_strip(F.col("line")) != "").select(
        "task_id", "pos", F.concat(F.length("line").cast("string"), F.lit(",  "), F.col("pos").cast("string")).alias("raw"))
    heads = t.select("task_id", F.lit(-1).alias("pos"), F.concat(F.lit("[ "), (F.col("doc_id") % 5).cast("string"), F.lit("]")).alias("raw"))
    return with_inputs(pairs.unionByName(heads), "raw")


def input_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies to input-generation requests: odd assistant turns list inputs in a
    fence (pairs in two spellings, a list, a text, the length of the turn, a bad line, a
    blank one), even ones have no fence."""
    s = samples(spark, sf_dir)
    turn, conv = F.col("completion_idx").cast("string"), F.col("conv_id")
    body = F.concat_ws("\n",
                       F.concat(turn, F.lit(","), (conv % 7).cast("string")),
                       F.concat(turn, F.lit(" , "), (conv % 7).cast("string"), F.lit("  # again")),
                       F.concat(F.lit("foo bar "), turn), F.lit("   "),
                       F.concat(F.lit("[ "), (conv % 5).cast("string"), F.lit(" ]")),
                       F.concat(F.lit("'t"), turn, F.lit("'")),
                       F.length("solution").cast("string"))
    fenced = F.concat(F.lit("Here are inputs:\n```python\n"), body, F.lit("\n```\nbye"))
    return s.select("task_id", "completion_id", F.col("completion_idx").alias("round_no"),
                    F.when(F.col("completion_idx") % 2 == 1, fenced).otherwise(body).alias("reply"))
