"""Property tests: Spark expressions against Python's own string and float semantics."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transeval.functions.compare import with_outputs_match
from transeval.functions.text import after_first, py_lines, py_strip

from test_compare import expected

TEXT = st.lists(st.sampled_from(list("ab1.:# -\n\r\t\x0b\x1c\x85\u3000\u00e9") + ["```", "\r\n"]), max_size=16).map("".join)
NUM = st.one_of(st.integers(-10**6, 10**6).map(str),
                st.floats(allow_nan=False, allow_infinity=False, width=64).map(repr),
                st.decimals(allow_nan=False, allow_infinity=False, places=4).map(str),
                st.sampled_from([" 5 ", "5.", ".5", "+1", "-0.0", "1_0", "1e3", "abc", ""]))
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=60), st.sampled_from(["```", ":", "a", "\n"]))
def test_text_primitives(spark, texts, marker):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", py_strip(F.col("s")).alias("st"), py_lines(F.col("s")).alias("ln"),
                     after_first(F.col("s"), F.lit(marker)).alias("af")).collect()
    for r in rows:
        assert r.st == r.s.strip()
        assert list(r.ln) == r.s.splitlines()
        assert r.af == r.s[r.s.find(marker) + len(marker):]


@SETTINGS
@given(st.lists(st.tuples(NUM, NUM), min_size=1, max_size=60))
def test_output_comparison(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in with_outputs_match(df, "a", "b", "m").collect():
        assert r.m == expected(r.a, r.b), (r.a, r.b)
