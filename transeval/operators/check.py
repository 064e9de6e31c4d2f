"""Completeness, compile-rate and integrity reports; samples joined to their tasks.

All reports group by the configuration columns, so one job checks every run. The
per-config scalars (expected sample count) come from an aggregate with one row per
config, joined back by config (or used as a scalar subquery when there is no config).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transeval.functions.compare import round_half_even
from transeval.functions.text import py_strip
from transeval.operators.ordered import position_in_group

COMPLETE, SHORT, MISSING = "complete", "short", "missing"


def samples_per_task(samples: DataFrame, cfg: Sequence[str] = (), task: str = "task_id") -> DataFrame:
    return samples.groupBy(*cfg, task).agg(F.count(F.lit(1)).alias("n_files"))


def _per_config(small: DataFrame, big: DataFrame, cfg: Sequence[str], col: str) -> DataFrame:
    """Attach a per-config scalar (``small`` has one row per config; AQE broadcasts it
    when its measured size is under the broadcast threshold)."""
    if cfg:
        return big.join(small, on=list(cfg), how="left")
    return big.withColumn(col, small.select(col).scalar())


def completeness(tasks: DataFrame, samples: DataFrame, cfg: Sequence[str] = (), nsample: int = 1,
                 task: str = "task_id") -> DataFrame:
    """Per task of ``tasks``: number of samples, expected number, status.

    expected = max(requested, most samples any sampled task has) -- also tasks outside
    ``tasks`` raise it; complete iff count == expected.
    """
    counts = samples_per_task(samples, cfg, task)
    expected = counts.groupBy(*cfg).agg(F.greatest(F.lit(int(nsample)).cast("bigint"), F.max("n_files")).alias("expected"))
    task_rows = tasks.select(*cfg, task).distinct()
    rep = task_rows.join(counts, on=[*cfg, task], how="left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    rep = _per_config(expected, rep, cfg, "expected")
    status = (F.when(F.col("n_files") == 0, F.lit(MISSING))
              .when(F.col("n_files") == F.col("expected"), F.lit(COMPLETE))
              .otherwise(F.lit(SHORT)))
    return rep.withColumn("status", status)


def completeness_summary(report: DataFrame, cfg: Sequence[str] = ()) -> DataFrame:
    """Per config: tasks, done, not done, missing, short."""
    return report.groupBy(*cfg).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(F.col("status") == COMPLETE).alias("n_done"),
        F.count_if(F.col("status") != COMPLETE).alias("n_incomplete"),
        F.count_if(F.col("status") == MISSING).alias("n_missing"),
        F.count_if(F.col("status") == SHORT).alias("n_short"),
    )


def blank(solution) -> Column:
    """``code.strip() == ""``; a missing text is blank too."""
    return F.coalesce(py_strip(solution) == "", F.lit(True))


def compile_report(samples: DataFrame, compiled: DataFrame, cfg: Sequence[str] = (),
                   keys: Sequence[str] = ("task_id", "completion_id"), tasks: DataFrame | None = None) -> DataFrame:
    """Per config: checked samples, wrong ones (blank or not compiling), percent wrong, and
    samples with a text that no compiler has seen yet.

    Only samples of known tasks are checked (semi join with ``tasks`` when given);
    ``compiled`` carries ``compile_ok`` per sample, an external compiler's verdict.
    """
    s = samples
    if tasks is not None:
        s = s.join(tasks.select(*cfg, "task_id").distinct(), on=[*cfg, "task_id"], how="left_semi")
    j = s.join(compiled.select(*cfg, *keys, "compile_ok"), on=[*cfg, *keys], how="left")
    empty = blank(F.col("solution"))
    agg = j.groupBy(*cfg).agg(F.count(F.lit(1)).alias("n_code"),
                              F.count_if(empty | ~F.coalesce(F.col("compile_ok"), F.lit(True))).alias("n_wrong"),
                              F.count_if(~empty & F.col("compile_ok").isNull()).alias("n_unchecked"))
    pct = F.when(F.col("n_code") == 0, F.lit(0.0)).otherwise(round_half_even(F.col("n_wrong") / F.col("n_code") * 100, 2))
    return agg.withColumn("pct_wrong", pct)


def first_by_position(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One row per key: the one with the lowest ``position`` (first in file order; a position
    is unique within its key). The minimum is aggregated over numbers only, so no text is
    carried through the aggregate, and a heavily repeated key is combined map-side."""
    lowest = df.groupBy(*keys).agg(F.min(position).alias(position))
    return df.join(lowest, on=[*keys, position], how="left_semi")


def attach_tasks(samples: DataFrame, tasks: DataFrame, on: Sequence[str] = ("task_id",),
                 position: str | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Samples joined to their task (inner) and the orphan samples (no such task).

    Duplicate task ids keep the first by ``position`` when given. The join strategy is
    left to the optimizer: AQE broadcasts the task side only when its measured size is
    under ``spark.sql.autoBroadcastJoinThreshold``, otherwise it shuffles both sides.
    ``strict=True`` fails the job on the first orphan, as a missing task is an error.
    """
    t = first_by_position(tasks, list(on), position) if position else tasks
    joined = samples.join(t, on=list(on), how="inner")
    orphans = samples.join(t.select(*on), on=list(on), how="left_anti")
    if strict:
        orphans = orphans.withColumn("_fail", F.raise_error(F.concat(F.lit("Cannot find problem "), F.col(on[0]))))
    return joined, orphans


def missing_tasks(tasks: DataFrame, samples: DataFrame, cfg: Sequence[str] = (), task: str = "task_id") -> DataFrame:
    """Tasks without a single sample."""
    return tasks.join(samples.select(*cfg, task), on=[*cfg, task], how="left_anti")


def solution_fallback(samples: DataFrame, tasks: DataFrame, task: str = "task_id") -> DataFrame:
    """A sample without ``solution`` takes its task's own code."""
    j = samples.join(tasks.select(task, F.col("code").alias("_code")), on=task, how="left")
    return j.withColumn("solution", F.coalesce(F.col("solution"), F.col("_code"))).drop("_code")


def reindex(samples: DataFrame, cfg: Sequence[str] = (), order: Sequence[str] = ("completion_idx",),
            task: str = "task_id", idx_col: str = "idx") -> DataFrame:
    """0-based running index per task in ``order`` (the file names a sample tree gets)."""
    return position_in_group(samples, [*cfg, task], list(order), pos_col=idx_col)


def integrity(samples: DataFrame, tasks: DataFrame, finished: DataFrame, cfg: Sequence[str] = (),
              identifier: str = "identifier", task: str = "task_id") -> DataFrame:
    """Per config: rows vs distinct identifiers (no duplicates), sampled tasks vs tasks
    (coverage, counts only), and submitted identifiers not finished (multiset difference).
    One aggregate by identifier and one by task, each combined map-side."""
    cfg = list(cfg)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ids = (samples.select(*cfg, identifier, one.alias("_sent"), none.alias("_done"))
           .unionByName(finished.select(*cfg, identifier, none.alias("_sent"), one.alias("_done")))
           .groupBy(*cfg, identifier).agg(F.sum("_sent").alias("_sent"), F.sum("_done").alias("_done")))
    by_id = ids.groupBy(*cfg).agg(F.sum("_sent").alias("n_rows"), F.count_if(F.col("_sent") > 0).alias("n_identifiers"),
                                  F.sum(F.greatest(F.col("_sent") - F.col("_done"), F.lit(0))).alias("n_unfinished"))
    known = (samples.select(*cfg, task, one.alias("_sampled"), none.alias("_task"))
             .unionByName(tasks.select(*cfg, task, none.alias("_sampled"), one.alias("_task")))
             .groupBy(*cfg, task).agg(F.max("_sampled").alias("_sampled"), F.max("_task").alias("_task")))
    by_task = known.groupBy(*cfg).agg(F.sum("_sampled").alias("n_sampled_tasks"), F.sum("_task").alias("n_tasks"))
    if cfg:
        out = by_task.join(by_id, on=cfg, how="full")
    else:  # one row each: scalar subqueries
        out = by_id
        for c in ("n_sampled_tasks", "n_tasks"):
            out = out.withColumn(c, by_task.select(c).scalar())
    out = out.fillna(0, ["n_rows", "n_identifiers", "n_unfinished", "n_sampled_tasks", "n_tasks"])
    return (out.withColumn("no_duplicates", F.col("n_rows") == F.col("n_identifiers"))
               .withColumn("all_tasks_sampled", F.col("n_sampled_tasks") == F.col("n_tasks"))
               .withColumn("all_finished", F.col("n_unfinished") == 0))
