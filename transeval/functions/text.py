"""Column functions that reproduce Python ``str`` semantics with built-in
Spark expressions (no Python worker).

* ``py_strip``      -- ``str.strip()``: Spark's ``trim`` removes only spaces.
* ``py_lines``      -- ``str.splitlines()`` (line-break set, no trailing empty item).
* ``after_first``   -- ``s[s.find(m) + len(m):]`` including the ``find == -1`` case.
* ``before_first``  -- ``s[:s.find(m)]`` including the ``find == -1`` case.

All positions are in code points, as in Python and in Spark string functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python treats as whitespace, built from the rule ``str.isspace``.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Single-character line boundaries of ``str.splitlines`` (plus the pair \r\n).
LINE_BREAK_CHARS = "".join(
    chr(c) for c in range(0x3001) if len(("a" + chr(c) + "b").splitlines()) == 2
)
LINE_BREAK_PATTERN = "\r\n|[" + "".join("\\x{%x}" % ord(c) for c in LINE_BREAK_CHARS) + "]"


def lit_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def sql(name: str, *args) -> Column:
    """Call a built-in SQL function with column (or literal) arguments."""
    return F.call_function(name, *[lit_col(a) for a in args])


def py_strip(c) -> Column:
    """``str.strip()`` with Python's whitespace set."""
    return F.btrim(lit_col(c), F.lit(PY_WHITESPACE))


def py_lstrip(c) -> Column:
    """``str.lstrip()``."""
    return F.ltrim(lit_col(c), F.lit(PY_WHITESPACE))


def normalise_breaks(c) -> Column:
    """Every ``splitlines`` boundary becomes ``\\n``."""
    return F.regexp_replace(lit_col(c), LINE_BREAK_PATTERN, "\n")


def py_lines(c) -> Column:
    """``s.splitlines()`` as an array column."""
    norm = normalise_breaks(c)
    body = F.when(norm.endswith(F.lit("\n")), sql("left", norm, F.length(norm) - 1)).otherwise(norm)
    return F.when(lit_col(c) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def find(c, marker) -> Column:
    """0-based ``str.find`` (-1 when missing)."""
    return sql("instr", c, marker) - 1


def substr_from(c, pos0) -> Column:
    """``s[pos0:]`` for a non-negative 0-based column position."""
    return sql("substring", c, lit_col(pos0) + 1)


def after_first(c, marker) -> Column:
    """``s[s.find(m) + len(m):]``; a missing marker drops ``len(m) - 1`` chars, as in Python."""
    m = lit_col(marker)
    return substr_from(c, find(c, m) + F.length(m))


def before_first(c, marker) -> Column:
    """``s[:s.find(m)]``; a missing marker means ``s[:-1]``, dropping the last char."""
    s = lit_col(c)
    pos = find(s, marker)
    return F.when(pos >= 0, sql("left", s, pos)).otherwise(sql("left", s, F.greatest(F.length(s) - 1, F.lit(0))))


def count_occurrences(c, marker) -> Column:
    """Non-overlapping occurrences of a marker."""
    s, m = lit_col(c), lit_col(marker)
    return ((F.length(s) - F.length(F.replace(s, m, F.lit("")))) / F.length(m)).cast("int")


def split_part(c, delim, n: int) -> Column:
    """``s.split(d)[n - 1]`` for a literal or column delimiter (plain text, no regex).

    Only meaningful when the delimiter occurs at least ``n - 1`` times; callers check.
    """
    s, d = lit_col(c), lit_col(delim)
    upto = sql("substring_index", s, d, F.lit(n))
    return upto if n == 1 else sql("substring_index", upto, d, F.lit(-1))
