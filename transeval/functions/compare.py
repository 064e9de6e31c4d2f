"""Program output vs expected output (number-aware comparison).

Rules, in the order the evaluator applies them:

1. integral branch -- the stripped stdout parses as a finite number ``x`` with ``x % 1 == 0``:
   match iff ``x == trunc(y)`` for the expected number ``y`` (expected is truncated, stdout
   is not: stdout ``5`` matches ``5.7`` but ``5.7`` does not match ``5``). Both are
   float64, so ``2**53 + 1`` equals ``2**53``.
2. fractional branch -- otherwise, if both texts contain ``.``: round both to the smaller
   count of characters after the first ``.`` and compare (``-0.0`` is not ``0.0``, as the
   evaluator compares the rounded values as text).
3. anything else -- compare the stripped texts.

Undecodable stdout never matches. Rounding is half to even on the exact binary value, so
``2.675`` (a little below the decimal tie) rounds to ``2.67``. Beyond 44 decimal places the
shortest decimal text of the value is moved first; only a decimal tie there may differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transeval.functions.text import lit_col, py_strip, sql

# Python ``float()`` literal syntax (finite values): digits with single underscores.
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER_PATTERN = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
# powers of ten that a float64 holds exactly
EXACT_POWERS = [10.0 ** i for i in range(23)]
MOST = len(EXACT_POWERS) - 1
# from here on a float64 has no binary places left
NO_FRACTION = float(2 ** 53)
SPLITTER = float(2 ** 27 + 1)


def parse_number(text) -> Column:
    """Finite double of a stripped numeric literal, else NULL."""
    s = py_strip(text)
    cast = F.when(s.rlike(NUMBER_PATTERN), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(~F.isnan(cast) & (F.abs(cast) < F.lit(float("inf"))), cast)


def decimals_after_point(text) -> Column:
    """``len(s.strip().split('.')[1])``; NULL when there is no ``.``."""
    s = py_strip(text)
    pos = sql("instr", s, F.lit("."))
    rest = sql("substring", s, pos + 1)
    return F.when(pos > 0, F.length(F.substring_index(rest, ".", 1)))


def _scaled_up(x: Column, digits: Column) -> Column:
    """``x >= 0`` moved by ``digits - 44`` decimal places where more than 44 are asked for, by
    its shortest text; a value too large to lose anything there is left as it is."""
    text = x.cast("string")
    power = F.coalesce(F.regexp_extract(text, "E(.*)$", 1).try_cast("int"), F.lit(0)) + digits - 2 * MOST
    moved = F.concat(F.substring_index(text, "E", 1), F.lit("E"), power.cast("string")).try_cast("double")
    return F.when((digits > 2 * MOST) & (x < 1e-20) & (moved < 1e-20), moved).otherwise(x)


def _product(x: Column, y: Column) -> tuple[Column, Column]:
    """x * y as the nearest float and what it lacks, exactly: each factor is split into
    halves of 26 bits, whose products are exact."""
    def halves(v):
        big = v * F.lit(SPLITTER)
        upper = big - (big - v)
        return upper, v - upper

    high = x * y
    (a, b), (c, d) = halves(x), halves(y)
    return high, ((a * c - high) + a * d + b * c) + b * d


def _sum(x: Column, y: Column) -> tuple[Column, Column]:
    """x + y as the nearest float and what it lacks, exactly."""
    s = x + y
    t = s - x
    return s, (x - (s - t)) + (y - t)


def _rounded(values: Column) -> Column:
    """An array of structs of ``x >= 0`` and ``m`` to each ``x`` rounded to ``m`` decimal places,
    half to even on the exact binary value, in a form that two values rounded to the same places
    can be compared by: beyond 22 places the result is in units of 10^(22 - m), or negative where
    rounding changes nothing.

    The value times the power of ten, in one factor or two, is kept exactly as a sum of
    floats, so the sign of what lies beyond the half decides. Each step is a ``transform`` of the
    one before, so it is made once, and a null array, which most rows have, costs nothing.
    """
    powers = F.array(*[F.lit(v) for v in EXACT_POWERS])

    def factors(r):
        first = F.element_at(powers, F.least(r.m, F.lit(MOST)).cast("int") + 1)
        second = F.element_at(powers, F.greatest(F.least(r.m - MOST, F.lit(MOST)), F.lit(0)).cast("int") + 1)
        return F.struct(r.x.alias("x"), r.m.alias("m"), first.alias("first"), second.alias("second"))

    def once(r):
        high, low = _product(r.x, r.first)
        return F.struct(r.x.alias("x"), r.m.alias("m"), r.first.alias("first"), r.second.alias("second"), high.alias("h"), low.alias("l"))

    def twice(r):
        (high, low), (more, less) = _product(r.h, r.second), _product(r.l, r.second)
        return F.struct(r.x.alias("x"), r.m.alias("m"), r.first.alias("first"), high.alias("h"), low.alias("l"),
                        more.alias("h2"), less.alias("l2"), F.floor(high).cast("double").alias("whole"))

    def rest(r):
        s, lack = _sum(r.l, r.h2)
        return F.struct(r.x.alias("x"), r.m.alias("m"), r.first.alias("first"), r.h.alias("h"), r.whole.alias("whole"),
                        r.l2.alias("l2"), s.alias("s"), lack.alias("e"))

    def result(r):
        total, lack = _sum(r.h - r.whole - F.lit(0.5), r.s)
        beyond = F.when(total != 0, total).otherwise(lack + r.e + r.l2)
        up = F.when(beyond > 0, 1.0).when(beyond < 0, 0.0).otherwise(r.whole % 2)
        same = F.when(r.m > MOST, -r.x).otherwise(r.x)
        return F.when(r.h >= F.lit(NO_FRACTION), same).otherwise((r.whole + up) / r.first)

    for step in (factors, once, twice, rest, result):
        values = F.transform(values, step)
    return values


def round_abs(x: Column, digits: int) -> Column:
    """``x >= 0`` rounded to a fixed number (at most 22) of decimal places, half to even on
    the exact binary value; a product of 2^53 or more means that rounding changes nothing."""
    power = F.lit(EXACT_POWERS[digits])
    high, low = _product(x, power)
    whole = F.floor(high).cast("double")
    beyond = (high - whole - F.lit(0.5)) + low
    up = F.when(beyond > 0, 1.0).when(beyond < 0, 0.0).otherwise(whole % 2)
    return F.when(high >= F.lit(NO_FRACTION), x).otherwise((whole + up) / power)


def round_half_even(x, digits: int) -> Column:
    """Any double rounded to a fixed number of decimal places, as ``round_abs`` does."""
    c = lit_col(x)
    r = round_abs(F.abs(c), digits)
    return F.when(c < 0, -r).otherwise(r)


EXPECTED_PARTS = ("_sb", "_y", "_db")


def with_expected_parts(tests, expected: str = "expected"):
    """Parse the expected outputs once per test (stripped text, number, decimals) so the
    per-execution comparison only parses the program output."""
    return (tests.withColumn("_sb", py_strip(F.col(expected)))
                 .withColumn("_y", parse_number(F.col("_sb")))
                 .withColumn("_db", decimals_after_point(F.col("_sb"))))


# below this a product with a power of ten is off by less than 2^-10, so a fraction further than
# 2^-8 from the half tells how it rounds
SURE_BELOW, SURE_APART = float(2 ** 43), 2.0 ** -8


def _sure(product: Column) -> Column:
    return (product < F.lit(SURE_BELOW)) & (F.abs(product - F.floor(product) - F.lit(0.5)) > F.lit(SURE_APART))


def with_outputs_match(df, stdout: str, expected: str, out: str = "matched", stdout_valid=None):
    """Adds whether the program output counts as the expected output. The parsed pieces become
    columns first, so the generated code evaluates each of them once per row. Expected-side pieces already
    attached by ``with_expected_parts`` are reused.

    Equal texts match under each rule and are not parsed. Of two fractions that differ, one
    product each tells the rounded values, unless it is near a half or large: only these rows
    are rounded exactly, apart from the generated code of the others, which stays below the
    8000 bytes of a method that the JVM compiles.
    """
    t = df if all(c in df.columns for c in EXPECTED_PARTS) else with_expected_parts(df, expected)
    t = t.withColumn("_sa", py_strip(F.col(stdout))).withColumn("_eq", F.coalesce(F.col("_sa") == F.col("_sb"), F.lit(False)))
    t = (t.withColumn("_x", F.when(~F.col("_eq"), parse_number(F.col("_sa"))))
          .withColumn("_da", F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), decimals_after_point(F.col("_sa"))))
          .withColumn("_m", F.least("_da", "_db")))
    x, y, m = F.col("_x"), F.col("_y"), F.col("_m")
    whole = x.isNotNull() & ((x % 1) == 0)
    frac = ~whole & F.col("_da").isNotNull() & F.col("_db").isNotNull() & y.isNotNull()
    power = F.element_at(F.array(*[F.lit(v) for v in EXACT_POWERS]), F.least(m, F.lit(MOST)).cast("int") + 1)
    t = t.withColumn("_p", F.when(frac, power))
    t = t.withColumn("_tx", F.abs(x) * F.col("_p")).withColumn("_ty", F.abs(y) * F.col("_p"))
    t = t.withColumn("_easy", (m <= MOST) & _sure(F.col("_tx")) & _sure(F.col("_ty")))
    hard = F.col("_p").isNotNull() & ~F.coalesce(F.col("_easy"), F.lit(False))
    both = F.array(*[F.struct(_scaled_up(F.abs(v), m).alias("x"), m.alias("m")) for v in (x, y)])
    t = t.withColumn("_r", _rounded(F.when(hard, both)))
    near = F.when(F.col("_easy"), F.floor(F.col("_tx") + F.lit(0.5)) == F.floor(F.col("_ty") + F.lit(0.5))).otherwise(F.col("_r")[0] == F.col("_r")[1])
    res = (F.when(F.col("_eq"), F.lit(True))
           .when(whole, F.coalesce(x == (y - (y % 1)), F.lit(False)))
           .when(F.col("_p").isNotNull(), near & (F.col("_sa").startswith("-") == F.col("_sb").startswith("-")))
           .otherwise(F.lit(False)))
    if stdout_valid is not None:
        res = F.when(lit_col(stdout_valid), res).otherwise(F.lit(False))
    return t.withColumn(out, res).drop("_sa", "_sb", "_eq", "_x", "_y", "_da", "_db", "_m", "_p", "_tx", "_ty", "_easy", "_r")
