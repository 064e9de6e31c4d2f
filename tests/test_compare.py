"""The comparison of outputs against exact rational arithmetic."""

import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from transeval.functions.compare import round_half_even, with_outputs_match
from transeval.functions.metrics import score_label

GOLDEN = [
    ("5.0\n", "5", True), ("5", "5.7", True), ("5.7", "5", False), ("-0.0", "-0.9", True),
    ("1.454", "1.45", True), ("1.50", "1.5", True), ("9007199254740993", "9007199254740992", True),
    ("2.675", "2.67", True), ("2.675", "2.68", False), ("0.001", "-0.0", False), ("abc ", "abc", True),
    ("123456789012345678901", "1e20", False), ("nan", "NaN", False),
    ("2.665", "2.67", True), ("3.145", "3.15", True), ("0.125", "0.12", True), ("0.375", "0.38", True),
    ("0.0000000000000000000000014", "0.000000000000000000000001", True),
    ("0.0000000000000000000000016", "0.000000000000000000000001", False),
    ("1." + "0" * 30 + "1", "1." + "0" * 30, True), ("0." + "0" * 398 + "1", "0." + "0" * 399, True),
    ("1.5", "1." + "5" + "0" * 400, True), ("1" * 20 + ".5", "1" * 20 + ".7", True),
]
NUMBER = re.compile(r"[+-]?(\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?")


def nearest(text, places):
    """The multiple of 10^-places nearest to the float of ``text``, half to even, as the
    float nearest to that."""
    exact = Fraction(float(text)) * 10**places
    low = exact.numerator // exact.denominator
    twice = 2 * (exact - low)
    if twice > 1 or (twice == 1 and low % 2):
        low += 1
    return float(Fraction(low, 10**places))


def expected(out, exp):
    """The documented rule on numbers and texts."""
    a, b = out.strip(), exp.strip()
    numbers = [bool(NUMBER.fullmatch(t)) and abs(float(t)) != float("inf") for t in (a, b)]
    if numbers[0] and Fraction(float(a)).denominator == 1:
        return numbers[1] and Fraction(float(a)) == int(Fraction(float(b)))
    if all(numbers) and "." in a and "." in b:
        places = min(len(t.split(".")[1]) for t in (a, b))
        return nearest(a, places) == nearest(b, places) and a.startswith("-") == b.startswith("-")
    return a == b


def matches(spark, pairs):
    rows = with_outputs_match(spark.createDataFrame(pairs, "a string, b string"), "a", "b", "m").collect()
    return {(r.a, r.b): r.m for r in rows}


def test_golden(spark):
    got = matches(spark, [(a, b) for a, b, _ in GOLDEN])
    assert {k: m for k, m in got.items()} == {(a, b): m for a, b, m in GOLDEN}
    assert all(expected(a, b) == m for a, b, m in GOLDEN)


def _number(rnd):
    forms = [lambda: str(rnd.randint(-50, 50)), lambda: f"{rnd.uniform(-100, 100):.{rnd.randint(0, 6)}f}",
             lambda: f"{rnd.randint(0, 9)}.{rnd.randint(0, 999)}", lambda: f"{rnd.uniform(-5, 5):.3e}",
             lambda: rnd.choice(["", " ", "abc", "1_000", "1__0", ".5", "5.", "+3", "-0", "inf", "nan", "1,5", "0x10"]),
             lambda: f" {rnd.randint(0, 9)}.{rnd.randint(0, 9)}\n",
             lambda: f"{rnd.randint(0, 99)}.{rnd.randint(0, 99):02d}5", lambda: f"{rnd.randint(0, 99)}.{rnd.randint(0, 99):02d}",
             lambda: repr(rnd.uniform(0, 10) ** rnd.randint(1, 20))]
    return rnd.choice(forms)()


def test_random_pairs(spark):
    rnd = random.Random(3)
    pairs = [(_number(rnd), _number(rnd)) for _ in range(6000)]
    pairs += [(f"{v}5", f"{v}") for v in (f"{rnd.randint(0, 999)}.{rnd.randint(0, 999):03d}" for _ in range(2000))]
    pairs += [(f"{v}5", f"{v}") for v in (f"0.{'0' * rnd.randint(16, 35)}{rnd.randint(1, 99999):05d}" for _ in range(2000))]
    bad = [(k, m) for k, m in matches(spark, pairs).items() if m != expected(*k)]
    assert not bad, bad[:10]


def test_rounding_equals_python(spark):
    rnd = random.Random(5)
    values = [rnd.choice([1, -1]) * v for v in [rnd.randint(0, 10**6) / 10**rnd.randint(0, 6) for _ in range(1500)]
              + [rnd.random() * 10.0 ** rnd.randint(-12, 18) for _ in range(1500)] + [k / 2**10 for k in range(300)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2, 3, 7, 15, 22):
        bad = [(r.v, r.o) for r in df.select("v", round_half_even(F.col("v"), places).alias("o")).collect() if r.o != round(r.v, places)]
        assert not bad, (places, bad[:5])


def test_score_label_rounds_the_binary_value(spark):
    values = [0.0045, 0.0625, 0.3125, 0.1235, 0.5195, 1.0, 0.0, 2 / 3]
    got = [r.l for r in spark.createDataFrame([(v,) for v in values], "v double").select(score_label(1, "v").alias("l")).collect()]
    assert got == [f"pass @ 1 :\t{v:.3f}" for v in values]
