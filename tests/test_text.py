import random

from pyspark.sql import functions as F

from transeval.functions.text import PY_WHITESPACE, after_first, before_first, py_lines, py_strip

ALPHABET = list("ab :#\n\r\t") + ["\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", " ",
                                   "　", "​", "é", "```", "Python:", "\r\n"]


def random_strings(n, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_whitespace_set_is_pythons():
    assert len(PY_WHITESPACE) == 29
    assert all(ch.isspace() for ch in PY_WHITESPACE)


def test_strip_and_splitlines_match_python(spark):
    data = random_strings(3000)
    df = spark.createDataFrame([(s,) for s in data], "s string")
    got = df.select("s", py_strip(F.col("s")).alias("st"), py_lines(F.col("s")).alias("ln")).collect()
    for r in got:
        assert r.st == r.s.strip(), repr(r.s)
        assert list(r.ln) == r.s.splitlines(), repr(r.s)


def test_find_slicing_matches_python(spark):
    data = random_strings(2000, seed=11)
    markers = ["```", "Python:", "a", "ab:"]
    df = spark.createDataFrame([(s, m) for s in data for m in markers], "s string, m string")
    got = df.select("s", "m", after_first(F.col("s"), F.col("m")).alias("a"),
                    before_first(F.col("s"), F.col("m")).alias("b")).collect()
    for r in got:
        assert r.a == r.s[r.s.find(r.m) + len(r.m):], (r.s, r.m)
        assert r.b == r.s[:r.s.find(r.m)], (r.s, r.m)
