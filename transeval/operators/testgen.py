"""Test-input generation bookkeeping, per function (``key``), for all functions at once.

A round: pick up to 5 seeds from the function's input pool at random, send a message
with the code, the seeds and one of three instructions, parse the reply's first fenced
block into inputs (one per non-blank line, comment cut at ``#``, must parse as a Python
literal list), append those not yet in the pool to it. Stop after the round that brings
enough new inputs, or after 21 rounds. The model call is outside; replies arrive as a table.

Inputs are compared by value: ``input_text`` is the canonical text of the parsed list, so
``1,2`` and ``1, 2`` are one input.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from transeval import constants as K
from transeval.functions.text import lit_col, py_lines, py_strip, split_part
from transeval.operators.ordered import first_in_group


def seed_order(key, pos, seed: int = 0) -> Column:
    """Deterministic pseudo-random order of pool entries (same in every engine:
    md5 of ``key:pos:seed``)."""
    return F.md5(F.concat_ws(":", lit_col(key).cast("string"), lit_col(pos).cast("string"), F.lit(str(seed))))


def seed_selection(pool: DataFrame, key: str = "task_id", pos: str = "pos", k: int = K.SEED_SAMPLE_SIZE,
                   seed: int = 0) -> DataFrame:
    """Up to ``k`` distinct pool entries per key, without replacement."""
    ordered = pool.withColumn("_ord", seed_order(F.col(key), F.col(pos), seed))
    return first_in_group(ordered, [key], ["_ord", pos], k, pos_col="seed_rank").drop("_ord")


@F.pandas_udf(StructType([StructField("canonical", StringType()), StructField("shown", StringType())]))
def parsed_input(text: pd.Series) -> pd.DataFrame:
    """Each line as a literal list: its canonical text, by which inputs are compared, and the
    text by which it is shown as an example. Both NULL where the line is no literal."""
    import ast

    def show(value) -> str:
        if isinstance(value, str):
            raw = value.encode("unicode-escape").decode().replace("\\\\", "\\")
            return f"'{raw}'"
        return str(value)

    def one(line):
        try:
            values = ast.literal_eval(f"[{line}]")
            return str(values), ", ".join(map(show, values))
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None, None

    return pd.DataFrame([one(t) for t in text], columns=["canonical", "shown"])


# so that a filter on the parsed value does not parse a second time
parsed_input = parsed_input.asNondeterministic()


def with_inputs(lines: DataFrame, line: str) -> DataFrame:
    """Replaces the text column ``line`` by ``input_text`` (canonical) and ``shown``; lines
    that are no literals are dropped."""
    out = lines.withColumn("_p", parsed_input(F.col(line))).drop(line)
    return out.filter(F.col("_p.canonical").isNotNull()).select("*", F.col("_p.canonical").alias("input_text"), F.col("_p.shown").alias("shown")).drop("_p")


def reply_lines(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Inputs of each reply: the text between the first two fences, split into lines, blank
    lines skipped, everything from ``#`` cut, parsed. Replies without a fence give none.
    Adds ``line_no``, ``input_text`` and ``shown``."""
    r = F.col(reply)
    block = split_part(r, F.lit("```"), 2)
    lines = F.when(F.contains(r, F.lit("```")), py_lines(block)).otherwise(F.array().cast("array<string>"))
    out = replies.select("*", F.posexplode(lines).alias("line_no", "_line"))
    out = out.filter(py_strip(F.col("_line")) != "")
    return with_inputs(out.withColumn("_line", py_strip(F.substring_index(F.col("_line"), "#", 1))), "_line")


def new_inputs(candidates: DataFrame, pool: DataFrame, num: int, *, key: str = "task_id",
               text: str = "input_text", order: Sequence[str] = ("round_no", "line_no"),
               rounds: int = K.TESTGEN_ROUNDS) -> DataFrame:
    """Inputs that the rounds of each key append to its pool: rounds ``0..rounds`` only,
    inputs already in the pool dropped, the first occurrence of a repeated one kept, and of
    these the rounds before which fewer than ``num`` had been found. ``returned`` marks the
    first ``num`` in ``order`` (round number, line number), which a caller gets back."""
    r, ln = order
    asked = candidates.filter(F.col(r) <= rounds)
    # the pool is needed only for keys that have candidates
    held = pool.select(key, text).join(asked.select(key).distinct(), on=key, how="left_semi")
    fresh = asked.join(held, on=[key, text], how="left_anti")
    # first occurrence by (round, line), packed into one bigint so the dedupe is a hash aggregate
    packed = F.shiftleft(F.col(r).cast("long"), 32) + F.col(ln).cast("long")
    firsts = fresh.groupBy(key, text).agg(F.min(packed).alias("_first"))
    found = firsts.select(key, text, F.shiftright("_first", 32).cast("int").alias(r),
                          F.col("_first").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias(ln))
    # a key has the lines of at most rounds + 1 replies
    by_key = Window.partitionBy(key)
    before = F.count(F.lit(1)).over(by_key.orderBy(r).rangeBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(by_key.orderBy(r, ln)).cast("long") - 1
    ranked = found.withColumn("_before", before).withColumn("new_rank", nth).filter(F.col("_before") < num)
    return ranked.withColumn("returned", F.col("new_rank") < num).drop("_before")


def pool_union(pool: DataFrame, added: DataFrame, key: str = "task_id", text: str = "input_text") -> DataFrame:
    """The pool after a generation step: old entries, then all that the rounds appended."""
    return pool.select(key, text).withColumn("origin", F.lit("seed")).unionByName(
        added.select(key, text).withColumn("origin", F.lit("generated")))


def instruction_index(key) -> Column:
    """Which of the three instructions a message uses (pseudo-random by key)."""
    h = F.conv(F.substring(F.md5(lit_col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(len(K.TESTGEN_INSTRUCTIONS))).cast("int")


def test_prompt(code, seeds_text, key) -> Column:
    """Message asking for new inputs: code block, example inputs block, instruction."""
    instr = F.element_at(F.array(*[F.lit(t) for t in K.TESTGEN_INSTRUCTIONS]), instruction_index(key) + 1)
    return F.concat(F.lit(K.TESTGEN_HEADER), lit_col(code), F.lit("\n```"), F.lit(K.TESTGEN_EXAMPLES),
                    lit_col(seeds_text), F.lit("\n```"), F.lit("\n"), instr)


def seed_messages(tasks: DataFrame, seeds: DataFrame, key: str = "task_id", code: str = "code",
                  text: str = "shown", rank: str = "seed_rank", instruction: Column | None = None) -> DataFrame:
    """One message per key from its selected seeds (at most ``SEED_SAMPLE_SIZE`` rows per
    key, so collecting them is bounded). ``instruction`` chooses among the instructions, by
    default the key does."""
    joined = seeds.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(text)))),
                                 lambda s: s[text]), "\n").alias("_seeds"))
    t = tasks.select(key, code).join(joined, on=key, how="left").withColumn("_seeds", F.coalesce("_seeds", F.lit("")))
    chosen = F.col(key) if instruction is None else instruction
    return t.select(key, test_prompt(F.col(code), F.col("_seeds"), chosen).alias("message"))
