"""pass@k and report labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transeval.functions.compare import round_half_even
from transeval.functions.text import lit_col


def _arg(x):
    """Column names given as strings are columns; numbers are literals."""
    return F.col(x) if isinstance(x, str) else lit_col(x)


def pass_at_k(n, c, k) -> Column:
    """Unbiased pass@k of one task: ``1 - C(n-c, k) / C(n, k)``.

    The ratio telescopes to ``prod_{j=0..k-1} (n-c-j) / (n-j)``: k factors (k is 1 or 5)
    instead of the c factors of ``prod_{i=n-c+1..n} (1 - k/i)``, so a task with any number
    of samples costs the same. ``n - c < k`` gives 1.0, ``c = 0`` gives 0.0.
    ``n`` may be a column or a scalar (one sample count for every task).
    """
    n, c, k = _arg(n).cast("bigint"), _arg(c).cast("bigint"), _arg(k).cast("bigint")
    ratio = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k - 1),
        F.lit(1.0).cast("double"),
        lambda acc, j: acc * ((n - c - j).cast("double") / (n - j).cast("double")),
    )
    return (F.when(n - c < k, F.lit(1.0))
            .when(c == 0, F.lit(0.0))
            .otherwise(F.lit(1.0) - ratio)).cast("double")


def score_label(k, value) -> Column:
    """``pass @ k :\\t0.123``: three decimals, half to even on the exact binary value (the
    format alone would round the decimal text half up)."""
    return F.format_string("pass @ %d :\t%.3f", _arg(k).cast("int"), round_half_even(_arg(value).cast("double"), 3))


def date_label(ts) -> Column:
    """``YYYY-MM-DD HH:MM`` stamp of a result document."""
    return F.date_format(_arg(ts), "yyyy-MM-dd HH:mm")


def config_label(dataset, source_lang, target_lang) -> Column:
    """Header of a leaderboard block: ``codenet (Java -> Python)``."""
    return F.format_string("%s (%s -> %s)", _arg(dataset), _arg(source_lang), _arg(target_lang))
