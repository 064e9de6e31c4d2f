"""Cleaning raw model replies into code (per-model text rules, then generic rules).

Order per row: the model rules whose trigger substring occurs in the output path (only
with ``remove_prompt``), then fence removal, then prefix-line removal for each prefix in
order, then truncation at each end marker in order, then a final strip. All rules are
built-in column expressions; the whole job is one projection (no shuffle), so it scales
with the number of rows and the length of the texts.

Rules that the original tool lets crash (missing ``@@ Response``/``Answer:``/
``<Lang>:`` marker, missing language line) give ``solution = NULL`` and a
``sanitize_error`` instead; ``strict=True`` turns any such row into an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transeval import constants as K
from transeval.functions.text import (after_first, before_first, find, lit_col,
                                      normalise_breaks, py_lstrip, py_strip, split_part, sql, substr_from)

INDEX_ERROR = "IndexError"
VALUE_ERROR = "ValueError"


# ---------------------------------------------------------------- single rules (Column -> Column)

def fence_tag(lang, cpp_as: str = "cpp") -> Column:
    """Fence language tag: lower-case language, ``c++`` written as ``cpp_as``."""
    low = F.lower(lit_col(lang))
    return F.when(low == "c++", F.lit(cpp_as)).otherwise(low)


def strip_marker(s, lang) -> Column:
    """code-llama: cut through the first ``"<Lang>:\\n"``; while the stripped rest still
    starts with ``"<Lang>:"``, cut again.

    The text is split at the full markers once. The cut goes on from piece to piece while
    the rest begins with ``"<Lang>:"``: either in the piece itself, or because the piece is
    blank and a marker follows it. Where no full marker is left, each cut drops
    ``len("<Lang>:")`` characters, first of the blanks in front; that goes on while blanks of
    a whole number of such cuts stand before the next ``"<Lang>:"``, so the same split does
    it. Every step is one pass over the text, however often the marker occurs."""
    lang = lit_col(lang)
    m, p = F.concat(lang, F.lit(":\n")), F.concat(lang, F.lit(":"))
    size = F.length(p)

    def pieces(text, mark):
        return F.split(text, F.concat(F.lit("\\Q"), mark, F.lit("\\E")), -1)

    def rest(parts, n, mark):
        return sql("array_join", F.slice(parts, n + 1, F.size(parts) - n), mark)

    def leading(parts, holds):
        """How many pieces from the first on hold; the last piece never counts."""
        fails = F.transform(parts, lambda x, i: ~holds(x) | (i == F.size(parts) - 1))
        return F.array_position(fails, True) - 1

    def bind(value, use):
        return F.transform(F.array(value), use)[0]

    def begins(x):
        return (py_strip(x) == "") | py_lstrip(x).startswith(p)

    def short_cuts(text):
        def cut(parts):
            n = leading(parts, lambda x: (py_strip(x) == "") & (F.length(x) % size == 0))
            # blanks that are no whole number of cuts: the last cut ends inside the marker
            def last(left):
                blanks = F.length(left) - F.length(py_lstrip(left))
                chop = (F.floor(blanks / size) + 1) * size
                return F.when(py_lstrip(left).startswith(p), substr_from(left, chop)).otherwise(left)
            return bind(rest(parts, n, p), last)
        return bind(pieces(text, p), cut)

    def full_cuts(parts):
        left = rest(parts, leading(parts, begins), m)
        return bind(left, lambda x: F.when((find(x, m) < 0) & py_lstrip(x).startswith(p), short_cuts(x)).otherwise(x))

    return bind(pieces(after_first(s, m), m), full_cuts)


def has_part(s, delim) -> Column:
    return find(s, delim) >= 0


def second_part(s, delim) -> Column:
    """``s.split(delim)[1].strip()`` (caller checks ``has_part``)."""
    return py_strip(split_part(s, delim, 2))


def fence_extract(s, marker) -> Column:
    """gpt / deepseek: text after the first ``marker`` up to the next ``` fence, with the
    original tool's index arithmetic when either is missing."""
    return before_first(after_first(s, marker), F.lit("```"))


def deepseek_marker(s, lang) -> Column:
    low = F.lower(lit_col(lang))
    tag = (F.when((low == "c++") & F.contains(lit_col(s), F.lit("```c++")), F.lit("c++"))
           .when((low == "c++") & F.contains(lit_col(s), F.lit("```cpp")), F.lit("cpp"))
           .otherwise(low))
    return F.concat(F.lit("```"), tag)


def language_line_pos(s, lang) -> Column:
    """0-based start of the text after the first line equal to ``lang`` (-1 when none)."""
    padded = F.concat(F.lit("\n"), lit_col(s), F.lit("\n"))
    hit = find(padded, F.concat(F.lit("\n"), lit_col(lang), F.lit("\n")))
    return F.when(hit >= 0, hit + F.length(lit_col(lang)) + 1).otherwise(F.lit(-1))


def after_language_line(s, lang) -> Column:
    """gemini / claude: everything after the first line equal to the language, stripped."""
    return py_strip(substr_from(s, language_line_pos(s, lang)))


def fence_remove(s, lang) -> Column:
    """Remove ```` ```<lang> ```` then every ```` ``` ````, then strip."""
    tagged = F.concat(F.lit("```"), F.lower(lit_col(lang)))
    return py_strip(F.replace(F.replace(lit_col(s), tagged, F.lit("")), F.lit("```"), F.lit("")))


def drop_prefix_lines(s, prefixes: Sequence[str]) -> Column:
    """For each prefix in order: drop the lines starting with it, rejoin with ``\\n``, strip.

    Line breaks are normalised once; a prefix that starts no line leaves the text as it
    is, which the guard uses to skip the split/filter/join for that prefix."""
    if not prefixes:
        return lit_col(s)
    start = py_strip(normalise_breaks(s))

    def step(acc, p):
        drop = F.array_join(F.filter(F.split(acc, "\n", -1), lambda line: ~line.startswith(p)), "\n")
        hit = acc.startswith(p) | F.contains(acc, F.concat(F.lit("\n"), p))
        return F.when(hit, py_strip(drop)).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(p) for p in prefixes]), start, step)


def truncate_at_markers(s, eofs: Sequence[str]) -> Column:
    """For each end marker in order: keep the text before its first occurrence, strip.

    When no marker starts or ends with whitespace, stripping between the cuts cannot
    create, remove or move a later marker occurrence, so one strip at the end gives the
    same text (the strip is a full pass over the text; this saves one per marker)."""
    out = lit_col(s)
    if all(e and not e[0].isspace() and not e[-1].isspace() for e in eofs):
        for eof in eofs:
            out = F.substring_index(out, eof, 1)
        return py_strip(out)
    for eof in eofs:
        out = py_strip(F.substring_index(out, eof, 1))
    return out


# ---------------------------------------------------------------- the job

def _stage(df: DataFrame, trigger: Column, value: Column, error: Column | None = None) -> DataFrame:
    active = F.col("sanitize_error").isNull() & trigger
    if error is not None:
        df = df.withColumn("sanitize_error", F.when(active & error.isNotNull(), error).otherwise(F.col("sanitize_error")))
        active = active & error.isNull()
    return df.withColumn("_s", F.when(active, value).otherwise(F.col("_s")))


def _trig(names: Sequence[str]) -> Column:
    cond = F.lit(False)
    for n in names:
        cond = cond | F.contains(F.col("_path"), F.lit(n))
    return cond


def output_path(path, inplace: bool = False) -> Column:
    """Sanitized samples go to ``<path>-sanitized`` unless written in place."""
    return lit_col(path) if inplace else F.concat(lit_col(path), F.lit(K.SANITIZED_SUFFIX))


def sanitize(samples: DataFrame, *, path: str = "path", target: str = "target_lang",
             solution: str = "solution", remove_prompt: bool = True, inplace: bool = False,
             eofs: Sequence[str] = (), prefixes: Sequence[str] = (), task_id: str | None = None,
             strict: bool = False) -> DataFrame:
    """Return ``samples`` with ``solution`` cleaned and a ``sanitize_error`` column.

    ``eofs`` / ``prefixes`` default to none, like the command line; the shipped script
    passes ``constants.DEFAULT_EOFS`` and ``constants.DEFAULT_PREFIXES``.
    ``task_id`` keeps only that task (debug mode).
    """
    df = samples
    if task_id is not None:
        df = df.filter(F.col("task_id") == task_id)
    lang = F.col(target)
    df = (df.withColumn("_path", output_path(F.col(path), inplace))
            .withColumn("_s", F.col(solution))
            .withColumn("sanitize_error", F.lit(None).cast("string")))
    s = F.col("_s")
    if remove_prompt:
        trig = dict(K.SANITIZE_TRIGGERS)
        df = _stage(df, _trig(trig["strip_marker"]), strip_marker(s, lang))
        for rule, delim in (("magicoder", F.lit("@@ Response")), ("octocoder", F.lit("Answer:")),
                            ("mixtral", F.concat(lang, F.lit(":")))):
            df = _stage(df, _trig(trig[rule]), second_part(s, delim),
                        F.when(~has_part(s, delim), F.lit(INDEX_ERROR)))
        df = _stage(df, _trig(trig["phi2"]) & has_part(s, F.lit("Output:")), second_part(s, F.lit("Output:")))
        gpt_marker = F.concat(F.lit("```"), fence_tag(lang))
        df = _stage(df, _trig(trig["gpt_fence"]), fence_extract(s, gpt_marker))
        for rule in ("gemini", "claude"):
            df = _stage(df, _trig(trig[rule]), after_language_line(s, lang),
                        F.when(language_line_pos(s, lang) < 0, F.lit(VALUE_ERROR)))
        df = df.withColumn("_dm", deepseek_marker(s, lang))
        df = _stage(df, _trig(trig["deepseek_fence"]), fence_extract(s, F.col("_dm"))).drop("_dm")
    df = df.withColumn("_s", fence_remove(s, lang))
    if prefixes:
        df = df.withColumn("_s", drop_prefix_lines(s, list(prefixes)))
    if eofs:
        df = df.withColumn("_s", truncate_at_markers(s, list(eofs)))
    df = df.withColumn(solution, F.when(F.col("sanitize_error").isNull(), py_strip(s)))
    if strict:
        df = df.withColumn(solution, F.when(F.col("sanitize_error").isNull(), F.col(solution))
                           .otherwise(F.raise_error(F.concat(F.lit("sanitize failed: "), F.col("sanitize_error")))))
    return df.withColumn("out_path", F.col("_path")).drop("_s", "_path")


def sanitize_summary(cleaned: DataFrame, cfg: Sequence[str] = ()) -> DataFrame:
    """Per config: samples seen and samples whose cleaning failed."""
    return cleaned.groupBy(*cfg).agg(F.count(F.lit(1)).alias("n_total"),
                                     F.count_if(F.col("sanitize_error").isNotNull()).alias("n_failed"))
