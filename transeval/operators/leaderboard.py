"""Verdicts -> per-task pass@k -> leaderboard.

Every aggregate groups by the configuration columns as well, so one job scores all
(dataset, model, source, target, temperature) runs at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transeval import constants as K
from transeval.functions.metrics import config_label, pass_at_k, score_label


def task_counts(verdicts: DataFrame, cfg: Sequence[str] = (), task: str = "task_id") -> DataFrame:
    """n = samples per task, c = samples whose verdict is success (NULL is not success)."""
    return verdicts.groupBy(*cfg, task).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict").eqNullSafe(F.lit(K.SUCCESS))).alias("c"),
    )


def task_scores(verdicts: DataFrame, cfg: Sequence[str] = (), ks: Sequence[int] = K.DEFAULT_KS,
                n_samples: int | None = None, task: str = "task_id") -> DataFrame:
    """One row per (config, task, k) with pass@k. ``n_samples`` fixes n for every task."""
    counts = task_counts(verdicts, cfg, task)
    if n_samples is not None:
        counts = counts.withColumn("n", F.lit(int(n_samples)).cast("bigint"))
    ks_col = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    return counts.select(*cfg, task, "n", "c", ks_col).withColumn("pass_at_k", pass_at_k("n", "c", "k"))


def leaderboard(verdicts: DataFrame, cfg: Sequence[str] = (), ks: Sequence[int] = K.DEFAULT_KS,
                task: str = "task_id") -> DataFrame:
    """Mean pass@k over tasks per config; k is reported only when every task of the
    config has at least k samples (``min(n) >= k``), per config."""
    scores = task_scores(verdicts, cfg, ks, task=task)
    board = scores.groupBy(*cfg, "k").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.min("n").alias("min_n"),
        F.avg("pass_at_k").alias("pass_at_k"),
    )
    return board.filter(F.col("min_n") >= F.col("k"))


def with_score_label(board: DataFrame) -> DataFrame:
    """Printable lines: ``pass @ k :\t0.123`` and, when the run columns are present, the
    block header ``dataset (source -> target)``."""
    out = board.withColumn("label", score_label(F.col("k"), F.col("pass_at_k")))
    if all(c in board.columns for c in ("dataset", "source_lang", "target_lang")):
        out = out.withColumn("header", config_label("dataset", "source_lang", "target_lang"))
    return out
