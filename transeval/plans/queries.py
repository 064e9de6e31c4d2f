"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query binds supplied tables to canonical ones (``transeval.sources.bindings``) and
runs one operator over the whole data. Doubles are rounded to 6 places and every
computed column is named, so the SQL twins in ``transeval.plans.oracle`` line up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transeval import constants as K
from transeval import jobs
from transeval.functions.compare import with_outputs_match
from transeval.functions.metrics import date_label
from transeval.functions.text import py_strip
from transeval.operators import check as ck
from transeval.operators import generate as gn
from transeval.operators import leaderboard as lb
from transeval.operators import prompts as pr
from transeval.operators import registry as rg
from transeval.operators import results as rs
from transeval.operators import sanitize as sz
from transeval.operators import testgen as tg
from transeval.operators import verdict as vd
from transeval.sources import bindings as B
from transeval.sources import samples as sm
from transeval.sources import tasks as tk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- metrics

@query
def pass_at_k_task(spark, sf):
    s = lb.task_scores(B.verdicts(spark, sf))
    return s.select("task_id", "k", "n", "c", r6(F.col("pass_at_k")).alias("pass_at_k"))


@query
def pass_at_k_fixed_n(spark, sf):
    s = lb.task_scores(B.verdicts(spark, sf), n_samples=100)
    return s.select("task_id", "k", "n", "c", r6(F.col("pass_at_k")).alias("pass_at_k"))


@query
def pass_at_k(spark, sf):
    b = lb.leaderboard(B.board_verdicts(spark, sf), cfg=["model"])
    return b.select("model", "k", "n_tasks", "min_n", r6(F.col("pass_at_k")).alias("pass_at_k"))


@query
def score_label(spark, sf):
    b = lb.with_score_label(lb.leaderboard(B.verdicts(spark, sf)))
    return b.select("k", "n_tasks", "min_n", "label")


@query
def date_label_q(spark, sf):
    v = B.verdicts(spark, sf)
    return v.groupBy("task_id").agg(date_label(F.max("ts")).alias("date"))


@query
def verdict_label(spark, sf):
    v = B.verdicts(spark, sf)
    code = (F.col("event_id") % 7).cast("int")
    return v.select("completion_id", code.alias("code"), vd.verdict_label(code).alias("label"))


# ---------------------------------------------------------------- verdicts

def _compared(spark, sf):
    return vd.attach_expected(B.exec_log(spark, sf), B.tests(spark, sf))


@query
def test_compare(spark, sf):
    return _compared(spark, sf).select("task_id", "completion_id", "test_idx", "stdout", "expected")


@query
def numeric_match(spark, sf):
    c = _compared(spark, sf)
    return with_outputs_match(c, "stdout", "expected", "matched").select("completion_id", "test_idx", "matched")


@query
def text_match(spark, sf):
    c = _compared(spark, sf)
    return c.select("completion_id", "test_idx",
                    (py_strip(F.col("stdout")) == py_strip(F.col("expected"))).alias("text_equal"))


@query
def test_outcome(spark, sf):
    o = vd.test_outcomes(_compared(spark, sf))
    return o.select("completion_id", "test_idx", "outcome")


@query
def test_outcome_once(spark, sf):
    """As ``test_outcome``, with equal outputs of a test compared once."""
    o = vd.test_outcomes_once(B.exec_log(spark, sf), B.tests(spark, sf))
    return o.select("completion_id", "test_idx", "outcome")


@query
def first_failure(spark, sf):
    v = vd.sample_verdicts(vd.test_outcomes(_compared(spark, sf)))
    return v.select("completion_id", "first_fail_idx", F.col("verdict"))


@query
def attempted_tests(spark, sf):
    a = vd.attempted_tests(vd.test_outcomes(_compared(spark, sf)))
    return a.select("completion_id", "test_idx", "outcome")


@query
def sample_verdict(spark, sf):
    v = vd.sample_verdicts(vd.test_outcomes(_compared(spark, sf)))
    return v.select("task_id", "completion_id", "n_tests", "verdict")


@query
def budget_verdict(spark, sf):
    v = vd.budget_verdicts(vd.test_outcomes(_compared(spark, sf)))
    return v.select("completion_id", "verdict", "verdict_watchdog", "verdict_strict")


QUERIES["date_label"] = QUERIES.pop("date_label_q")


# ---------------------------------------------------------------- sanitizer


@query
def strip_marker(spark, sf):
    r = B.replies(spark, sf)
    return r.select("task_id", sz.strip_marker(F.col("solution"), F.col("target_lang")).alias("solution"))


def _delim_by_row():
    return (F.when(F.col("doc_id") % 3 == 0, F.lit("@@ Response"))
            .when(F.col("doc_id") % 3 == 1, F.lit("Answer:"))
            .otherwise(F.concat(F.col("target_lang"), F.lit(":"))))


@query
def strip_second_part(spark, sf):
    r = B.replies(spark, sf).withColumn("_d", _delim_by_row())
    ok = sz.has_part(F.col("solution"), F.col("_d"))
    return r.select("task_id", F.when(ok, sz.second_part(F.col("solution"), F.col("_d"))).alias("solution"),
                    F.when(~ok, F.lit(sz.INDEX_ERROR)).alias("sanitize_error"))


@query
def strip_optional_part(spark, sf):
    r = B.replies(spark, sf)
    s = F.col("solution")
    return r.select("task_id", F.when(sz.has_part(s, F.lit("Output:")), sz.second_part(s, F.lit("Output:")))
                    .otherwise(s).alias("solution"))


@query
def fence_extract(spark, sf):
    r = B.replies(spark, sf)
    s, lang = F.col("solution"), F.col("target_lang")
    marker = F.when(F.col("doc_id") % 4 < 2, F.concat(F.lit("```"), sz.fence_tag(lang))).otherwise(sz.deepseek_marker(s, lang))
    return r.select("task_id", sz.fence_extract(s, marker).alias("solution"))


@query
def after_language_line(spark, sf):
    r = B.replies(spark, sf)
    s, lang = F.col("solution"), F.col("target_lang")
    found = sz.language_line_pos(s, lang) >= 0
    return r.select("task_id", F.when(found, sz.after_language_line(s, lang)).alias("solution"),
                    F.when(~found, F.lit(sz.VALUE_ERROR)).alias("sanitize_error"))


@query
def fence_remove(spark, sf):
    r = B.replies(spark, sf)
    return r.select("task_id", sz.fence_remove(F.col("solution"), F.col("target_lang")).alias("solution"))


@query
def drop_prefix_lines(spark, sf):
    r = B.replies(spark, sf)
    return r.select("task_id", sz.drop_prefix_lines(py_strip(F.col("solution")), K.DEFAULT_PREFIXES).alias("solution"))


@query
def truncate_at_marker(spark, sf):
    r = B.replies(spark, sf)
    return r.select("task_id", sz.truncate_at_markers(py_strip(F.col("solution")), K.DEFAULT_EOFS).alias("solution"))


@query
def sanitize_full(spark, sf):
    r = sz.sanitize(B.replies(spark, sf), eofs=K.DEFAULT_EOFS, prefixes=K.DEFAULT_PREFIXES)
    return r.select("task_id", "solution", "sanitize_error", "out_path")


@query
def sanitize_one_task(spark, sf):
    """Debug mode: only the task with the longest source (chosen from the data)."""
    r = B.replies(spark, sf)
    pick = r.agg(F.max_by("task_id", F.struct(F.length("solution"), F.col("doc_id"))).alias("task_id"))
    one = sz.sanitize(r.join(pick, "task_id", "left_semi"), eofs=K.DEFAULT_EOFS, prefixes=K.DEFAULT_PREFIXES)
    return one.select("task_id", "solution", "sanitize_error")


# ---------------------------------------------------------------- checker and integrity


@query
def samples_per_task(spark, sf):
    return ck.samples_per_task(B.samples(spark, sf))


@query
def sample_reindex(spark, sf):
    r = ck.reindex(B.samples(spark, sf))
    return r.select("task_id", "completion_id", "idx", F.concat(F.col("idx").cast("string"), F.lit(".py")).alias("file_name"))


@query
def integrity_checks(spark, sf):
    v = B.verdicts(spark, sf).withColumn("identifier", F.col("completion_id"))
    tasks = v.select("task_id").distinct()
    finished = v.filter(F.col("verdict").isNotNull())
    return ck.integrity(v, tasks, finished).select(
        "n_rows", "n_identifiers", "n_sampled_tasks", "n_tasks", "n_unfinished",
        "no_duplicates", "all_tasks_sampled", "all_finished")


@query
def sample_task_join(spark, sf):
    joined, _orphans = ck.attach_tasks(B.samples(spark, sf), B.tasks(spark, sf).drop("conv_id"), position="doc_id")
    return joined.select("task_id", "completion_id", "language", F.length("code").alias("code_chars"))


@query
def missing_tasks(spark, sf):
    return ck.missing_tasks(B.tasks(spark, sf), B.samples(spark, sf)).select("task_id", "language")


@query
def solution_fallback(spark, sf):
    s = B.samples(spark, sf).withColumn("solution", F.when(F.col("completion_idx") == 1, F.lit(None)).otherwise(F.col("solution")))
    return ck.solution_fallback(s, B.tasks(spark, sf)).select("task_id", "completion_id", "solution")


def _completeness(spark, sf):
    return ck.completeness(B.sample_tasks(spark, sf), B.samples(spark, sf), nsample=2)


@query
def completeness(spark, sf):
    return _completeness(spark, sf).select("task_id", "n_files", "expected", "status")


@query
def completeness_summary(spark, sf):
    return ck.completeness_summary(_completeness(spark, sf))


@query
def compile_report(spark, sf):
    """Over all documents: labelled or not, some without a text."""
    t = B.tasks(spark, sf)
    samples = t.select("task_id", "language", F.lit("0").alias("completion_id"),
                       F.when(F.col("doc_id") % 17 != 0, F.col("code")).alias("solution"))
    compiled = B.compile_log(spark, sf).join(t.select("task_id", "language"), "task_id")
    return ck.compile_report(samples, compiled, cfg=["language"], tasks=t).select("language", "n_code", "n_wrong", "n_unchecked", "pct_wrong")


@query
def evaluate_run(spark, sf):
    """Whole evaluations: verdicts of all samples, coverage, and scores where it is complete."""
    samples, tasks, log = B.evaluation(spark, sf)
    e = jobs.evaluate(samples, tasks, B.tests(spark, sf), log, ["model"], budget="watchdog")
    n = e.verdicts.groupBy("model").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("verdict").isNull()).alias("n_unknown"),
                                        F.count_if(F.col("verdict") == K.SUCCESS).alias("n_success"))
    p = e.problems.groupBy("model").agg(F.count(F.lit(1)).alias("n_problems"))
    b = e.board.filter("k = 1").select("model", r6(F.col("pass_at_k")).alias("pass_at_1"))
    return n.join(p, "model", "left").join(b, "model", "left").withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))


# ---------------------------------------------------------------- result records


@query
def verdict_array(spark, sf):
    p = rs.verdict_positions(B.verdicts(spark, sf).select("task_id", "completion_id", "verdict"))
    return p.select("task_id", "completion_id", "pos", "nfiles", "verdict")


@query
def result_document(spark, sf):
    r = rs.task_records(B.verdicts(spark, sf).select("task_id", "completion_id", "verdict"))
    base = F.array_join(F.transform("base", lambda v: F.coalesce(v, F.lit("null"))), ",")
    return r.select("task_id", "part", "nfiles", base.alias("base"))


@query
def cached_eval(spark, sf):
    v = B.verdicts(spark, sf).withColumn("run_day", F.to_date("ts").cast("string"))
    cached = v.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    return rs.plan_evaluation(v, cached, cfg=["run_day"]).select("run_day", "task_id", "completion_id", "state", "verdict")


@query
def legacy_results(spark, sf):
    """Stored records in both layouts -- old ``{"files": [...]}`` (even tasks) and new
    ``{"nfiles": n}`` -- one record per verdict row, migrated and summed per task."""
    v = B.verdicts(spark, sf)
    doc = F.when(F.col("user_id") % 2 == 0, F.to_json(F.struct(F.array(F.col("completion_id")).alias("files")))) \
           .otherwise(F.to_json(F.struct(F.lit(1).alias("nfiles"))))
    parsed = v.select("task_id", F.from_json(doc, rs.TASK_RESULT).alias("r"))
    return parsed.groupBy("task_id").agg(F.sum(rs.migrate_nfiles(F.col("r"))).cast("int").alias("nfiles"))


@query
def latest_version(spark, sf):
    """Version numbers beyond the whole numbers of a float64, and labels outside the five."""
    v = B.verdicts(spark, sf)
    label = F.when(F.col("event_id") % 13 == 0, F.lit("flaky")).otherwise(F.col("verdict"))
    v = v.select("task_id", F.get_json_object("props", "$.k").alias("k"), label.alias("verdict"),
                 (F.col("event_id") + F.lit(1 << 60)).alias("version"))
    return rs.latest_versions(v, ["task_id", "k"], "version").select("task_id", "k", "n_versions", "verdict", "version")


# ---------------------------------------------------------------- scans and paths


@query
def task_scan(spark, sf):
    return B.tasks(spark, sf, language="Python").select("task_id", "language")


@query
def extension_map(spark, sf):
    return B.tasks(spark, sf).select("task_id", "language", tk.extension(F.col("language")).alias("ext"))


@query
def class_rename(spark, sf):
    t = B.tasks(spark, sf)
    java = F.concat(F.lit("public class Main {\n"), F.col("code"), F.lit("\n}\nclass  Helper_2 {}"))
    return t.select("task_id", tk.java_class_rename(java, F.col("task_id")).alias("code"))


@query
def path_parse(spark, sf):
    s = B.samples(spark, sf)
    dataset = F.when(F.col("conv_id") % 2 == 0, F.lit("codenet")).otherwise(F.lit("avatar"))
    model = F.element_at(F.array(*[F.lit(m) for m in B.REPLY_MODELS]), (F.col("conv_id") % 10 + 1).cast("int"))
    stage = F.when(F.col("completion_idx") % 4 == 3, F.lit("sanitized")).otherwise(F.lit("raw"))
    path = sm.sample_path(F.lit("translations"), dataset, model, F.lit("Java"), F.lit("Python"), F.lit("0.2"),
                          stage, F.col("task_id"), F.col("completion_idx"), F.lit(".py"))
    return s.select(path.alias("identifier")).select("identifier", *sm.parse_path(F.col("identifier")))


# ---------------------------------------------------------------- prompts, registry, generation

PROMPT_TYPES = [*K.PROMPT_TEMPLATES, "no-such-type"]
FIM_FAMILIES = ["incoder", "codegen2", "santacoder", "starcoder_infill", "hf"]


def _pick(values, idx_col):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx_col % len(values) + 1).cast("int"))


@query
def compose_prompt(spark, sf):
    t = B.tasks(spark, sf).withColumn("prompt_type", _pick(PROMPT_TYPES, F.col("doc_id")))
    return t.select("task_id", "prompt_type",
                    pr.compose_prompt(F.col("prompt_type"), F.lit("Java"), F.col("language"), F.col("code")).alias("prompt"))


@query
def fim_wrap(spark, sf):
    t = B.tasks(spark, sf).withColumn("family", _pick(FIM_FAMILIES, F.col("doc_id")))
    base = pr.compose_prompt("base", F.lit("Java"), F.col("language"), F.col("code"))
    return t.select("task_id", "family", pr.fim_wrap(base, F.col("family")).alias("model_input"))


@query
def prompt_echo(spark, sf):
    s = B.samples(spark, sf)
    prompt = F.concat(F.lit("Translate "), F.col("task_id"), F.lit(":\n"))
    return s.select("task_id", "completion_id",
                    pr.prompt_echo(prompt, F.col("solution"), F.col("completion_idx") % 2 == 1).alias("stored"))


@query
def stop_truncate(spark, sf):
    t = B.tasks(spark, sf)
    stop = _pick(["</s>", "<|endoftext|>", ""], F.col("doc_id"))
    out = F.concat(F.col("code"), stop, F.lit("tail"))
    fam = F.when(F.col("doc_id") % 2 == 0, F.lit("incoder")).otherwise(F.lit("hf"))
    return t.select("task_id", pr.stop_truncate(out, pr.stops_for(fam)).alias("solution"))


@query
def tab_expand(spark, sf):
    t = B.tasks(spark, sf)
    return t.select("task_id", pr.tab_expand(F.concat(F.lit("\tdef f():\n\t\treturn 1\n"), F.col("code"))).alias("solution"))


@query
def sentinel_flag(spark, sf):
    t = B.tasks(spark, sf)
    fam = _pick(FIM_FAMILIES, F.col("doc_id"))
    over = gn.over_length(fam, F.lit(1024), F.floor(F.length("code") / 4))
    sol = F.when(over, F.lit(K.MAX_LENGTH_EXCEEDED)).otherwise(F.col("code"))
    return t.select("task_id", over.alias("over_length"), pr.is_sentinel(sol).alias("is_sentinel"))


@query
def json_reply(spark, sf):
    e = B.verdicts(spark, sf)
    return e.select("completion_id", pr.json_reply(F.col("props"), F.col("verdict"), field="k").alias("reply"))


@query
def chat_messages(spark, sf):
    s = B.samples(spark, sf)
    m = pr.chat_messages(F.col("solution"), F.col("completion_idx") % 2 == 0)
    return s.select("task_id", "completion_id",
                    F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"),
                    m[0]["content"].alias("system_content"), m[1]["content"].alias("user_content"))


@query
def token_budget(spark, sf):
    s = B.samples(spark, sf)
    fam = _pick(B.BUDGET_FAMILIES, F.col("conv_id"))
    tok = _pick(B.TOKENIZER_LIMITS, F.col("conv_id"))
    npos = F.when(F.col("conv_id") % 2 == 0, F.lit(4096))
    ctx = gn.context_window(fam, tok, npos, F.lit(16384))
    ptok = F.floor(F.length("solution") / 4).cast("int")
    return s.select("task_id", "completion_id", fam.alias("family"), ctx.alias("ctx"),
                    gn.token_budget(fam, F.lit(1024), ctx, ptok).alias("budget"),
                    gn.over_length(fam, ctx, ptok).alias("over_length"))


@query
def greedy_normalise(spark, sf):
    c = B.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    runs = c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n_samples"),
                                    F.max("turn").cast("int").alias("batch_size"))
    runs = runs.withColumn("greedy", F.col("conv_id") % 3 == 0).withColumn("temperature", (F.col("conv_id") % 5) * 0.2)
    g = rg.greedy_normalise(runs)
    return g.select("conv_id", "greedy", F.round("temperature", 6).alias("temperature"), "batch_size", "n_samples", "greedy_forced")


@query
def registry_lookup(spark, sf):
    t = B.tasks(spark, sf).withColumn("alias", _pick(B.ALIASES, F.col("doc_id")))
    r = rg.registry_lookup(t, "alias")
    return r.select("task_id", "alias", "family", "hub_name", "conversational", "registry_error")


@query
def work_plan(spark, sf):
    existing = B.samples(spark, sf).select("task_id", F.col("completion_idx").alias("idx"))
    p = gn.work_plan(B.sample_tasks(spark, sf), existing, cfg=[], n_samples=3, batch_size=2)
    return p.select("task_id", "idx", "batch_no", "n_existing")


@query
def work_plan_gaps(spark, sf):
    """Exactly the missing indices, where the stored ones have gaps and repeats."""
    existing = B.samples(spark, sf).select("task_id", F.col("completion_idx").alias("idx"))
    p = gn.work_plan(B.sample_tasks(spark, sf), existing.unionByName(existing), cfg=[], n_samples=6, batch_size=2, gap_fill=True)
    return p.select("task_id", "idx", "batch_no")


# ---------------------------------------------------------------- test-input generation


@query
def seed_selection(spark, sf):
    s = tg.seed_selection(B.input_pool(spark, sf))
    return s.select("task_id", "pos", "seed_rank", "input_text")


@query
def reply_lines(spark, sf):
    r = tg.reply_lines(B.input_replies(spark, sf))
    return r.select("task_id", "completion_id", "line_no", "input_text")


def _new_inputs(spark, sf):
    cand = tg.reply_lines(B.input_replies(spark, sf))
    return tg.new_inputs(cand, B.input_pool(spark, sf), num=3)


@query
def new_inputs(spark, sf):
    return _new_inputs(spark, sf).select("task_id", "input_text", "round_no", "line_no", "new_rank", "returned")


@query
def pool_union(spark, sf):
    u = tg.pool_union(B.input_pool(spark, sf), _new_inputs(spark, sf))
    return u.groupBy("task_id").agg(F.count_if(F.col("origin") == "seed").alias("n_seed"),
                                    F.count_if(F.col("origin") == "generated").alias("n_generated"))


@query
def test_prompt(spark, sf):
    seeds = tg.seed_selection(B.input_pool(spark, sf))
    return tg.seed_messages(B.tasks(spark, sf), seeds).select("task_id", "message")


@query
def run_validation(spark, sf):
    """Run arguments checked against the closed sets; rejected runs carry the reason."""
    c = B.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    runs = c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    runs = runs.select("conv_id",
                       _pick(["codenet", "avatar", "humaneval"], F.col("conv_id")).alias("dataset"),
                       _pick(["Java", "Python", "C++", "Go", "C", "Rust"], F.col("conv_id")).alias("source_lang"),
                       _pick(["Python", "Java", "Kotlin", "Go"], F.col("last_turn")).alias("target_lang"),
                       _pick([*K.CLI_PROMPT_TYPES, "phi", "magic"], F.col("conv_id") + F.col("last_turn")).alias("prompt_type"))
    return rg.validate_runs(runs).select("conv_id", "dataset", "source_lang", "target_lang", "prompt_type", "run_error")


@query
def sanitize_summary(spark, sf):
    """Cleaning counters per target language: samples seen, samples whose cleaning failed."""
    r = sz.sanitize(B.replies(spark, sf), eofs=K.DEFAULT_EOFS, prefixes=K.DEFAULT_PREFIXES)
    return sz.sanitize_summary(r, ["target_lang"])
