"""Model alias -> decoder family, hub name, chat flag; run-argument checks.

The registry is a fixed ordered rule list (``constants.REGISTRY_RULES``); the first
matching rule wins, which is exactly a ``CASE`` chain, so a lookup is a projection
(no join, no shuffle) over any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transeval import constants as K
from transeval.functions.text import lit_col

ERROR_PREFIX = "Invalid model name: "


def _deepseek_size(alias: Column) -> Column:
    """``deepseek-coder-<n>b...``: n as written by float(n), integral values without '.0'."""
    raw = F.regexp_extract(alias, K.DEEPSEEK_SIZE_PATTERN, 1)
    val = raw.try_cast("double")
    return F.when(raw == "", F.lit(None)).when(val % 1 == 0, val.cast("bigint").cast("string")).otherwise(val.cast("string"))


def _hub(alias: Column, template: str | None) -> Column:
    if template is None:
        return alias
    if template == "bigcode/{alias}":
        return F.concat(F.lit("bigcode/"), alias)
    if "{last}" in template:
        return F.concat(F.lit("codellama/CodeLlama-"), F.substring_index(alias, "-", -1), F.lit("-Instruct-hf"))
    if "{size}" in template:
        variant = F.when(F.contains(alias, F.lit("instruct")), F.lit("instruct")).otherwise(F.lit("base"))
        return F.concat(F.lit("deepseek-ai/deepseek-coder-"), _deepseek_size(alias), F.lit("b-"), variant)
    return F.lit(template)


def lookup(alias_col) -> Column:
    """Struct (family, hub_name, conversational, error) for a model alias (lower-cased first)."""
    alias = F.lower(lit_col(alias_col))
    expr = None
    for order, (kind, pattern, family, hub, conv) in enumerate(K.REGISTRY_RULES):
        cond = alias == pattern if kind == "exact" else alias.startswith(pattern)
        fam = F.lit(family)
        conv_c = F.lit(conv)
        err = F.lit(None).cast("string")
        if family == "deepseek":
            instruct = F.contains(alias, F.lit("instruct"))
            fam = F.when(instruct, F.lit("deepseek_instruct")).otherwise(F.lit("vllm"))
            conv_c = instruct
            err = F.when(_deepseek_size(alias).isNull(), F.concat(F.lit(ERROR_PREFIX), alias))
        if pattern == "code-llama-":
            err = F.when(~alias.endswith("b"), F.concat(F.lit(ERROR_PREFIX), alias))
        val = F.struct(fam.alias("family"), _hub(alias, hub).alias("hub_name"), conv_c.alias("conversational"),
                       err.alias("error"), F.lit(order).alias("rule_order"))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    missing = F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("hub_name"),
                       F.lit(None).cast("boolean").alias("conversational"),
                       F.concat(F.lit(ERROR_PREFIX), alias).alias("error"), F.lit(None).cast("int").alias("rule_order"))
    return expr.otherwise(missing)


def registry_lookup(df: DataFrame, alias: str = "model") -> DataFrame:
    """Add family, hub_name, conversational, registry_error, rule_order."""
    r = df.withColumn("_reg", lookup(F.col(alias)))
    r = r.select("*", F.col("_reg.family").alias("family"), F.col("_reg.hub_name").alias("hub_name"),
                 F.col("_reg.conversational").alias("conversational"), F.col("_reg.error").alias("registry_error"),
                 F.col("_reg.rule_order").alias("rule_order"))
    r = r.withColumn("family", F.when(F.col("registry_error").isNull(), F.col("family"))) \
         .withColumn("hub_name", F.when(F.col("registry_error").isNull(), F.col("hub_name"))) \
         .withColumn("conversational", F.when(F.col("registry_error").isNull(), F.col("conversational")))
    return r.drop("_reg")


def greedy_normalise(runs: DataFrame) -> DataFrame:
    """Greedy decoding forces temperature 0, batch size 1 and one sample whenever any of
    them differs; ``greedy_forced`` marks the runs that were changed."""
    forced = F.col("greedy") & ((F.col("temperature") != 0) | (F.col("batch_size") != 1) | (F.col("n_samples") != 1))
    return (runs.withColumn("greedy_forced", forced)
                .withColumn("temperature", F.when(forced, F.lit(0.0)).otherwise(F.col("temperature").cast("double")))
                .withColumn("batch_size", F.when(forced, F.lit(1)).otherwise(F.col("batch_size")))
                .withColumn("n_samples", F.when(forced, F.lit(1)).otherwise(F.col("n_samples"))))


def validate_runs(runs: DataFrame) -> DataFrame:
    """``run_error`` for values outside the closed sets (dataset, languages, prompt type)."""
    def bad(col, allowed, what):
        return F.when(~F.col(col).isin(*allowed), F.concat(F.lit(f"invalid {what}: "), F.col(col)))
    err = F.coalesce(bad("dataset", K.DATASETS, "dataset"), bad("source_lang", K.LANGUAGES, "source_lang"),
                     bad("target_lang", K.LANGUAGES, "target_lang"))
    if "prompt_type" in runs.columns:
        err = F.coalesce(err, bad("prompt_type", K.CLI_PROMPT_TYPES, "prompt_type"))
    return runs.withColumn("run_error", err)
