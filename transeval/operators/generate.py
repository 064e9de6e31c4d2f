"""Generation work: what is left to generate, in which request batches, with which
token budget; the model call itself is a user function run batch-wise in
``mapInPandas``; replies are cut at stop strings and stored with or without the prompt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from transeval import constants as K
from transeval.functions.text import lit_col
from transeval.operators import prompts as P
from transeval.session import checkpoint_dir


def work_plan(tasks: DataFrame, existing: DataFrame, cfg: Sequence[str], n_samples, batch_size,
              *, gap_fill: bool = False, task: str = "task_id") -> DataFrame:
    """Indices still to generate per (config, task) and their request batch.

    ``n_samples`` and ``batch_size`` are numbers or columns of ``tasks``, whose other columns
    are kept. Count-based resume is that of a file tree, where a file is overwritten: with
    ``k`` files present the indices ``k .. n_samples-1`` are generated, even if the present
    files are not ``0..k-1``. ``gap_fill=True`` generates exactly the missing indices, as a
    table that is appended to needs it. ``existing``: (cfg..., task_id, idx), repeated or not.
    """
    keys = [*cfg, task]
    wanted, size = (F.col(v) if isinstance(v, str) else F.lit(int(v)) for v in (n_samples, batch_size))
    have = existing.groupBy(*keys)
    if gap_fill:
        # the present indices of one task are few: at most n_samples count
        present = have.agg(F.collect_set("idx").alias("_have"))
        todo = tasks.join(present, on=keys, how="left")
        gone = F.coalesce("_have", F.array().cast("array<int>"))
        todo = todo.withColumn("_idx", F.array_except(F.sequence(F.lit(0), wanted - 1), gone)).filter((wanted > 0) & (F.size("_idx") > 0))
        out = todo.select("*", F.size(gone).alias("n_existing"), F.posexplode(F.array_sort("_idx")).alias("_nth", "idx")).drop("_have", "_idx")
    else:
        counts = have.agg(F.count(F.lit(1)).cast("int").alias("n_existing"))
        todo = tasks.join(counts, on=keys, how="left").withColumn("n_existing", F.coalesce("n_existing", F.lit(0)))
        out = (todo.filter(F.col("n_existing") < wanted)
               .select("*", F.posexplode(F.sequence(F.col("n_existing"), wanted - 1)).alias("_nth", "idx")))
    return out.withColumn("batch_no", F.floor(F.col("_nth") / size).cast("int")).drop("_nth")


def context_window(family, tokenizer_max, n_positions, max_position_embeddings) -> Column:
    """Window the decoder family uses: a tokenizer limit above the family's threshold is
    a placeholder, then the model config's ``n_positions`` / ``max_position_embeddings``
    / 1024 apply."""
    thr = None
    for name, (_e, _r, threshold, _f) in K.FAMILIES.items():
        if threshold is None:
            continue
        c = lit_col(family) == name
        thr = F.when(c, F.lit(threshold)) if thr is None else thr.when(c, F.lit(threshold))
    fallback = F.coalesce(lit_col(n_positions), lit_col(max_position_embeddings), F.lit(K.DEFAULT_CONTEXT))
    return F.when(lit_col(tokenizer_max) > thr, fallback).otherwise(lit_col(tokenizer_max))


def token_budget(family, max_length, ctx, prompt_tokens) -> Column:
    """New-token budget per family rule: ``ctx``, ``ctx - prompt`` or 90 % of it."""
    expr = None
    for name, (_e, rule, _t, _f) in K.FAMILIES.items():
        if rule is None:
            continue
        if rule == "ctx":
            v = F.least(lit_col(max_length), lit_col(ctx))
        elif rule == "left":
            v = F.least(lit_col(max_length), lit_col(ctx) - lit_col(prompt_tokens))
        else:
            v = F.least(lit_col(max_length), F.floor((lit_col(ctx) - lit_col(prompt_tokens)) * 0.9).cast("int"))
        c = lit_col(family) == name
        expr = F.when(c, v) if expr is None else expr.when(c, v)
    return expr.otherwise(lit_col(max_length))


def over_length(family, ctx, prompt_tokens) -> Column:
    """Infilling decoders refuse prompts that fill the window: the sample becomes a sentinel."""
    return lit_col(family).isin("santacoder", "starcoder_infill") & (lit_col(prompt_tokens) >= lit_col(ctx))


def _replies(fn: Callable[[list[str]], list[str]], prompts: list[str], sentinel: str | None) -> list[str]:
    """Replies to one request batch. If the call fails, each prompt is asked on its own, and
    only those that fail again get the sentinel."""
    def checked(asked: list[str]) -> list[str]:
        out = list(fn(asked))
        if not out:
            raise RuntimeError("No outputs from model!")
        if len(out) != len(asked):
            raise RuntimeError(f"model returned {len(out)} replies for {len(asked)} prompts")
        return out

    if sentinel is None:
        return checked(prompts)
    try:
        return checked(prompts)
    except Exception:  # noqa: BLE001 - whatever a model client raises
        out = []
        for p in prompts:
            try:
                out += checked([p])
            except Exception:  # noqa: BLE001
                out.append(sentinel)
        return out


def generate(plan: DataFrame, fn: Callable[[list[str]], list[str]], *, prompt: str = "prompt",
             batch: Sequence[str] = (), sentinel: str | None = None, materialise: bool = True) -> DataFrame:
    """Call ``fn(prompts) -> replies`` once for each request batch of the plan; adds ``output``.

    ``batch``: the columns whose neighbouring rows of equal values are one request (without
    them, each row is one). With ``sentinel`` a failing request costs its own reply only;
    else the job fails. An empty reply list is an error. The replies are written once to the
    shared checkpoint folder, so a lost executor never calls the model again for finished
    work.
    """
    schema = StructType([*plan.schema.fields, StructField("output", StringType())])
    columns = list(batch)

    def answered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(output=pd.Series(_replies(fn, pdf[prompt].tolist(), sentinel), index=pdf.index, dtype="object"))

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            if columns:
                new = pdf[columns].ne(pdf[columns].shift()).any(axis=1).cumsum()
            else:
                new = pd.Series(range(len(pdf)), index=pdf.index)
            groups = [g for _, g in pdf.groupby(new, sort=False)]
            held = groups.pop()  # may go on in the next Arrow batch
            for g in groups:
                yield answered(g)
        if held is not None:
            yield answered(held)

    out = plan.mapInPandas(run, schema)
    if materialise:
        checkpoint_dir(plan.sparkSession)
        out = out.checkpoint(eager=True)
    return out


# decoder families whose replies are cut at stop strings from index 10,000 down
CAPPED_FAMILIES = ["hf", "incoder", "codegen2", "santacoder", "starcoder_infill", "codet5p"]
# families the serving engine stops at the stop strings (no cap)
ENGINE_STOP_FAMILIES = ["vllm", "chatml"]
# families whose replies have tabs turned into four spaces
TAB_FAMILIES = ["vllm", "chatml", "codet5p"]


def finish_outputs(df: DataFrame, *, output: str = "output", prompt: str = "prompt",
                   family: str = "family", conversational: str = "conversational") -> DataFrame:
    """Decoder post-processing per family: stop-string cut, tabs as four spaces, and the
    stored text (reply alone for chat models, else prompt + reply)."""
    fam, text = F.col(family), F.col(output)
    stops = P.stops_for(fam)
    text = (F.when(fam.isin(*CAPPED_FAMILIES), P.stop_truncate(text, stops))
            .when(fam.isin(*ENGINE_STOP_FAMILIES), P.stop_truncate(text, stops, cap=None))
            .otherwise(text))
    text = F.when(fam.isin(*TAB_FAMILIES), P.tab_expand(text)).otherwise(text)
    return df.withColumn("solution", P.prompt_echo(F.col(prompt), text, F.col(conversational)))
