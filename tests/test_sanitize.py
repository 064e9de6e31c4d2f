import random

import duckdb
from pyspark.sql import functions as F

from transeval import constants as K
from transeval.operators import sanitize as sz
from transeval.plans import oracle


def _run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "task_id string, solution string, target_lang string, path string")
    out = sz.sanitize(df, **kw).orderBy("task_id").collect()
    return [(r.solution, r.sanitize_error) for r in out]


def test_golden_rules(spark):
    rows = [
        ("00", "Hi\n```python\nx=1\n```\nbye", "Python", "m/gpt-4/t"),
        ("01", "abcdefghijklm", "Python", "m/gpt-4/t"),
        ("02", "Java\ncode\nPython\nx=1", "Python", "m/gemini-pro/t"),
        ("03", "x=1", "Python", "m/claude/t"),
        ("04", "a@@ Response b@@ Response c", "Python", "m/magicoder/t"),
        ("05", "p\nPython:\nPython:\nx", "Python", "m/code-llama-7b/t"),
        ("06", "```cpp\nint a;```", "C", "m/none/t"),
    ]
    got = _run(spark, rows)
    assert got == [("x=1", None), ("ijkl", None), ("x=1", None), (None, sz.VALUE_ERROR), ("b", None),
                   ("x", None), ("pp\nint a;", None)]


def test_prefix_order_and_eofs(spark):
    rows = [("a", "Here it is\n   The code\nx", "Python", "p")]
    assert _run(spark, rows, prefixes=["Here", "The"]) == [("x", None)]
    assert _run(spark, rows, prefixes=["The", "Here"]) == [("The code\nx", None)]
    assert _run(spark, [("a", "x=1\nNote: ok", "Python", "p")], eofs=["Note"]) == [("x=1", None)]


FRAGMENTS = ["```python", "```cpp", "```c++", "```", "Python:\n", "Python:", "C++:\n", "Python", "C++", "\n", "\r\n",
             "  ", "x = 1", "@@ Response", "Answer:", "Output:", "Note", "1.", "The ", "Here ", "# <END-OF-CODE>",
             "-", "go", "\x0b", "é", "A:"]
PATHS = ["out/code-llama-13b/t", "out/magicoder/t", "out/octocoder/t", "out/mixtral/t", "out/phi2/t", "out/gpt-4/t",
         "out/gemini-pro/t", "out/claude/t", "out/deepseek-coder/t", "out/starcoder/t", "out/claude-gpt-4/t"]


def test_random_replies_match_the_sql_twin(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        text = "".join(rnd.choice(FRAGMENTS) for _ in range(rnd.randint(0, 14)))
        rows.append((f"{i:05d}", text, rnd.choice(["Python", "C++", "C"]), rnd.choice(PATHS)))
    got = _run(spark, rows, eofs=K.DEFAULT_EOFS, prefixes=K.DEFAULT_PREFIXES)
    con = duckdb.connect()
    con.execute("create table replies (task_id varchar, solution varchar, target_lang varchar, path varchar, doc_id bigint)")
    con.executemany("insert into replies values (?, ?, ?, ?, 0)", rows)
    sql = f"with {oracle._sanitize_sql('replies')} select case when err is null then {oracle.strip('s')} end, err from s12 order by task_id"
    want = con.execute(sql).fetchall()
    bad = [(rows[i], got[i], want[i]) for i in range(len(rows)) if got[i] != want[i]]
    assert not bad, bad[:5]


MARKERS = [("p\nPython:\nPython:\nx", "x"), ("Python:\nx", "x"), ("Python:\nPython: a Python:\nb", "b"),
           ("Python:\n       Python: a", " a"), ("Python:\n  Python: a", "n: a"[-4:]), ("Python:\n\n\nPython:\n\nx", "\nx"),
           ("no marker", "er"), ("Python:\n" * 5000 + "x", "x"), ("Python:\n" + "Python:" * 5000 + "x", "x"),
           ("Python:\n" + "a Python:\n" * 3, "a Python:\n" * 3), ("", "")]


def test_markers_are_cut_in_constant_passes(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MARKERS)], "i int, s string")
    got = {r.i: r.o for r in df.select("i", sz.strip_marker(F.col("s"), F.lit("Python")).alias("o")).collect()}
    for i, (t, want) in enumerate(MARKERS):
        assert got[i] == want, (t[:60], got[i][:60])


def test_debug_task_and_strict(spark):
    rows = [("a", "x", "Python", "m/magicoder/t"), ("b", "y@@ Responsez", "Python", "m/magicoder/t")]
    df = spark.createDataFrame(rows, "task_id string, solution string, target_lang string, path string")
    assert [r.solution for r in sz.sanitize(df, task_id="b").collect()] == ["z"]
    import pytest
    with pytest.raises(Exception):
        sz.sanitize(df, strict=True).collect()


def test_end_markers_with_whitespace_keep_step_strips(spark):
    rnd = random.Random(9)
    eofs = [" x", "y ", "\nNote"]
    frags = ["a", " ", "x", "y", "\n", "Note", "  "]
    texts = ["".join(rnd.choice(frags) for _ in range(rnd.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.o for r in df.select(sz.truncate_at_markers(F.col("s"), eofs).alias("o")).collect()]

    def py(t):
        for e in eofs:
            t = t.split(e)[0].strip()
        return t
    assert got == [py(t) for t in texts]
