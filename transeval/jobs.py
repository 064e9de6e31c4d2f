"""The four end-to-end jobs, composed from the operators, for every configuration at once.

* ``translate``  -- tasks + existing samples -> prompts -> model -> stored samples
* ``clean``      -- raw samples -> cleaned samples (+ summary)
* ``check``      -- completeness report + compile report
* ``evaluate``   -- samples + execution log + tests -> verdicts -> task scores + leaderboard
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transeval import constants as K
from transeval.operators import check as ck
from transeval.operators import generate as gn
from transeval.operators import leaderboard as lb
from transeval.operators import prompts as pr
from transeval.operators import registry as rg
from transeval.operators import results as rs
from transeval.operators import sanitize as sz
from transeval.operators import verdict as vd

RUN_CFG = ["dataset", "model", "source_lang", "target_lang", "temperature"]


def translate(tasks: DataFrame, runs: DataFrame, existing: DataFrame, fn: Callable[[list[str]], list[str]], *,
              sentinel: str | None = None, token_count: Callable | None = None, context=None) -> tuple[DataFrame, DataFrame]:
    """Generate the missing samples of every run.

    ``tasks``: dataset, task_id, language, code. ``runs``: one row per run with RUN_CFG,
    prompt_type, n_samples, batch_size, greedy. ``existing``: RUN_CFG, task_id, idx; exactly
    the indices it lacks are generated. With ``token_count`` (Column -> Column) and
    ``context`` (window size, column or int), prompts that fill an infilling decoder's window
    get the sentinel text without a model call. Returns the samples (RUN_CFG, task_id, idx,
    batch_no, prompt, output, solution, registry columns) and the rejected runs: those of an
    unknown model, with ``registry_error``.
    """
    looked_up = rg.registry_lookup(rg.greedy_normalise(runs), "model")
    rejected = looked_up.filter(F.col("registry_error").isNotNull())
    r = looked_up.filter(F.col("registry_error").isNull())
    jobs = (tasks.join(r, (tasks.dataset == r.dataset) & (tasks.language == r.source_lang), "inner")
                 .select(*[r[c] for c in RUN_CFG], "task_id", "code", "prompt_type", "n_samples", "batch_size",
                         "family", "conversational"))
    # the prompt is made once per task; the samples of a task repeat it
    jobs = jobs.withColumn("prompt", pr.compose_prompt(F.col("prompt_type"), F.col("source_lang"),
                                                       F.col("target_lang"), F.col("code"))).drop("code")
    jobs = jobs.withColumn("model_input", pr.fim_wrap(F.col("prompt"), F.col("family")))
    plan = gn.work_plan(jobs, existing, RUN_CFG, "n_samples", "batch_size", gap_fill=True)
    request = [*RUN_CFG, "task_id", "batch_no"]
    if token_count is not None and context is not None:
        ctx = context if isinstance(context, F.Column) else F.lit(int(context))
        over = gn.over_length(F.col("family"), ctx, token_count(F.col("model_input")))
        plan = plan.withColumn("_over", over)
        refused = plan.filter(F.col("_over")).drop("_over").withColumn("output", F.lit(K.MAX_LENGTH_EXCEEDED))
        out = gn.generate(plan.filter(~F.col("_over")).drop("_over"), fn, prompt="model_input", batch=request, sentinel=sentinel)
        out = out.unionByName(refused)
    else:
        out = gn.generate(plan, fn, prompt="model_input", batch=request, sentinel=sentinel)
    return gn.finish_outputs(out), rejected


def clean(samples: DataFrame, cfg: Sequence[str] = RUN_CFG, *, remove_prompt: bool = True, inplace: bool = False,
          eofs: Sequence[str] = K.DEFAULT_EOFS, prefixes: Sequence[str] = K.DEFAULT_PREFIXES) -> tuple[DataFrame, DataFrame]:
    """Cleaned samples (``path`` is the run folder, ``target_lang`` per row) and counts."""
    cleaned = sz.sanitize(samples, remove_prompt=remove_prompt, eofs=eofs, prefixes=prefixes, inplace=inplace)
    return cleaned, sz.sanitize_summary(cleaned, [c for c in cfg if c in samples.columns])


def check(tasks: DataFrame, samples: DataFrame, compiled: DataFrame, cfg: Sequence[str], nsample: int = 1
          ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Completeness per task, its summary per config, and the compile report per config.
    ``tasks`` carries the cfg columns (each run's task list)."""
    rep = ck.completeness(tasks, samples, cfg, nsample)
    return rep, ck.completeness_summary(rep, cfg), ck.compile_report(samples, compiled, cfg, tasks=tasks)


class Evaluation(NamedTuple):
    """``problems``: (cfg..., problem, subject), tasks without a sample and identifiers that
    occur more than once; configurations with any are judged but not scored."""
    verdicts: DataFrame
    scores: DataFrame
    board: DataFrame
    problems: DataFrame


def coverage_problems(samples: DataFrame, tasks: DataFrame, cfg: Sequence[str]) -> DataFrame:
    """Tasks of a configuration without a sample, and repeated samples. A configuration's
    tasks are those that share its values in the config columns that ``tasks`` has."""
    cfg = list(cfg)
    shared = [c for c in cfg if c in tasks.columns]
    if cfg and not shared:
        raise ValueError(f"tasks must have one of the columns {cfg}")
    listed = tasks.select(*shared, "task_id").distinct()
    planned = samples.select(*cfg).distinct().join(listed, on=shared) if cfg else listed
    missing = planned.join(samples.select(*cfg, "task_id"), on=[*cfg, "task_id"], how="left_anti")
    twice = samples.groupBy(*cfg, "task_id", "completion_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return missing.select(*cfg, F.lit("missing task").alias("problem"), F.col("task_id").alias("subject")).unionByName(
        twice.select(*cfg, F.lit("repeated sample").alias("problem"), F.concat_ws("/", "task_id", "completion_id").alias("subject")))


def evaluate(samples: DataFrame, tasks: DataFrame, tests: DataFrame, exec_log: DataFrame, cfg: Sequence[str], *,
             cached: DataFrame | None = None, rerun: bool = False, budget: str | None = None,
             ks: Sequence[int] = K.DEFAULT_KS, task_keys: Sequence[str] | None = None, once: bool = False) -> Evaluation:
    """Verdict rows, per-task scores and the leaderboard for every configuration.

    Every sample has a verdict row, NULL where its log is missing or cut short. Configurations
    found in ``cached`` (cfg..., task_id, completion_id, verdict) keep those verdicts unless
    ``rerun``. Tests are matched on (dataset, task_id) when samples and tests carry a dataset.
    ``once``: equal outputs of a test are compared once. Nothing runs here, and each of the
    four results is computed on its own; ``evaluate_into`` judges once and stores them.
    """
    cfg = list(cfg)
    keys = [*cfg, "task_id", "completion_id"]
    if task_keys is None:
        both = "dataset" in samples.columns and "dataset" in tests.columns
        task_keys = ("dataset", "task_id") if both else ("task_id",)
    stored = None
    todo = samples
    if cached is not None and not rerun:
        done = cached.select(*cfg).distinct()
        stored = cached.select(*keys, "verdict")
        todo = samples.join(done, on=cfg, how="left_anti") if cfg else samples.limit(0)
    one_each = todo.dropDuplicates(keys)
    verdicts = vd.judge(exec_log, tests, cfg, samples=one_each, budget=budget, task_keys=task_keys, once=once)
    if stored is not None:
        verdicts = verdicts.unionByName(stored)
    problems = coverage_problems(todo, tasks, cfg)
    return Evaluation(verdicts, *scored(verdicts, problems, cfg, ks), problems)


def scored(verdicts: DataFrame, problems: DataFrame, cfg: Sequence[str], ks: Sequence[int] = K.DEFAULT_KS) -> tuple[DataFrame, DataFrame]:
    """Per-task scores and the leaderboard of the configurations without problems."""
    cfg = list(cfg)
    if cfg:
        sound = verdicts.join(problems.select(*cfg).distinct(), on=cfg, how="left_anti")
    else:  # the only configuration is scored if nothing is wrong with it
        found = problems.agg(F.count(F.lit(1)).alias("_p")).select("_p").scalar()
        sound = verdicts.filter(found == 0)
    return lb.task_scores(sound, cfg, ks), lb.leaderboard(sound, cfg, ks)


def evaluate_into(out: str, samples: DataFrame, tasks: DataFrame, tests: DataFrame, exec_log: DataFrame, cfg: Sequence[str], *,
                  rerun: bool = False, budget: str | None = None, ks: Sequence[int] = K.DEFAULT_KS, once: bool = False, date_col=None) -> Evaluation:
    """``evaluate``, with everything stored below ``out`` and read back from there.

    ``verdicts`` keeps versions (see ``sources.commits``); configurations that have one are not
    judged again unless ``rerun``. Verdicts are judged once and written; scores, the board and
    the documents of newly judged configurations come from what is stored. Configurations with
    problems are not scored, whenever they were judged.
    """
    spark, cfg = samples.sparkSession, list(cfg)
    store = f"{out}/verdicts"
    before = None if rerun else rs.read_latest_or_none(spark, store, cfg)
    todo = samples
    if before is not None:
        todo = samples.join(before.select(*cfg).distinct(), on=cfg, how="left_anti") if cfg else samples.limit(0)
    found = evaluate(todo, tasks, tests, exec_log, cfg, budget=budget, once=once)
    judged = rs.write_versioned(found.verdicts, store, cfg)
    rs.write_result_documents(evaluation_documents(judged.drop("version"), cfg, date_col), f"{out}/documents", cfg, again=True)
    asked = samples.select(*cfg).distinct()
    current = rs.read_latest_or_none(spark, store, cfg)
    current = judged if current is None else (current.join(asked, on=cfg, how="left_semi") if cfg else current)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    problems = kept(coverage_problems(samples, tasks, cfg), "problems")
    scores, board = scored(current, problems, cfg, ks)
    return Evaluation(current, kept(scores, "scores"), kept(board, "board"), problems)


def evaluation_documents(verdicts: DataFrame, cfg: Sequence[str], date_col=None) -> DataFrame:
    """Result documents (one JSON line per config and task) for ``write_result_documents``."""
    return rs.result_documents(verdicts, cfg, date_col)
