"""Rounds of input generation against a plain loop with a scripted model."""

import ast
import hashlib

import pytest
from pyspark.sql import functions as F

from transeval import constants as K
from transeval.operators import rounds as rd
from transeval.operators import testgen as tg
from transeval.sources import files

TASKS = [("a", "def a(x): ..."), ("b", "def b(): pass"), ("c", "def c():\n  return 1"), ("d", "def d(q)"), ("none", "def none()")]
POOL = {"a": ["1", "2, 3", "'x'"], "b": ["[1, 2]"], "c": [str(i) for i in range(12)], "d": ["0"], "none": ["7"]}


def show(values):
    return ", ".join("'" + v.encode("unicode-escape").decode().replace("\\\\", "\\") + "'" if isinstance(v, str) else str(v) for v in values)


def scripted():
    """A model whose replies depend on the code, the seeds and the instruction; made here, so
    that it travels to the workers by value."""
    import hashlib

    def reply(m):
        h = int(hashlib.md5(m.encode()).hexdigest(), 16)
        if "def none" in m:
            return "no fence here"
        if "def d" in m:  # always the same input, so it never has enough
            return "```\n5 # five\n0\nnot a literal\n```"
        lines = [f"{h % 7}", f"{h % 5},  {h // 5 % 3}", "'x'", "", f"{h % 7} # again", "oops("]
        return "text\n```python\n" + "\n".join(lines) + "\n```"

    return lambda messages: [reply(m) for m in messages]


model = scripted()


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def plain(num, rounds=20):
    """The loop, function by function."""
    out = []
    for key, code in TASKS:
        pool = [(i, str(ast.literal_eval(f"[{t}]")), show(ast.literal_eval(f"[{t}]"))) for i, t in enumerate(POOL[key])]
        new, r = [], 0
        while len(new) < num and r <= rounds:
            seeds = sorted(pool, key=lambda p: (md5(f"{key}:{p[0]}:{r}"), p[0]))[:5]
            instruction = K.TESTGEN_INSTRUCTIONS[int(md5(f"{key}:{r}")[:8], 16) % 3]
            message = (K.TESTGEN_HEADER + code + "\n```" + K.TESTGEN_EXAMPLES + "\n".join(s[2] for s in seeds) + "\n```\n" + instruction)
            reply = model([message])[0]
            if "```" in reply:
                for n, line in enumerate(reply.split("```")[1].splitlines()):
                    if not line.strip():
                        continue
                    try:
                        v = ast.literal_eval(f"[{line.split('#')[0].strip()}]")
                    except (ValueError, SyntaxError):
                        continue
                    if str(v) not in {p[1] for p in pool}:
                        pool.append((((r + 1) << 32) + n, str(v), show(v)))
                        new.append((r, n, str(v)))
            r += 1
        out += [(key, *x, i, i < num) for i, x in enumerate(new)]
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    tasks = spark.createDataFrame(TASKS, "task_id string, code string")
    lines = spark.createDataFrame([(k, i, t) for k, ts in POOL.items() for i, t in enumerate(ts)], "task_id string, pos int, raw string")
    return tasks, tg.with_inputs(lines, "raw")


def found(df):
    return sorted(tuple(r) for r in df.select("task_id", "round_no", "line_no", "input_text", "new_rank", "returned").collect())


def test_equal_to_a_plain_loop_and_stops_after_21_rounds(spark, tables, tmp_path):
    store = str(tmp_path / "s")
    got = rd.run_rounds(*tables, rd.model_call(model), 4, store)
    want = plain(4)
    assert found(got) == want
    assert {k for k, *_ in want} == {"a", "b", "c", "d"} and any(not x[-1] for x in want)
    done = rd.rounds_done(spark, store)
    # one function always brings the same, one nothing: both are asked to the end
    assert len(done) == K.TESTGEN_ROUNDS + 1 == 21 and done[-1]["left"] == 2
    asked = {r: {x.task_id for x in spark.read.parquet(f"{store}/round={r}/replies").collect()} for r in (0, 20)}
    assert asked == {0: {k for k, _ in TASKS}, 20: {"d", "none"}}


def test_stops_when_all_have_enough(spark, tables, tmp_path):
    tasks, pool = tables
    store = str(tmp_path / "s")
    got = rd.run_rounds(tasks.filter("task_id in ('a', 'b')"), pool, rd.model_call(model), 2, store)
    assert found(got) == [x for x in plain(2) if x[0] in "ab"]
    assert rd.rounds_done(spark, store)[-1]["left"] == 0 and len(rd.rounds_done(spark, store)) < 21


def test_goes_on_where_it_was_cut(spark, tables, tmp_path, monkeypatch):
    store, asked = str(tmp_path / "s"), []

    def counted(requests):
        asked.append(requests.first().round_no)
        return rd.model_call(model)(requests)

    real = files.create_only
    monkeypatch.setattr(files, "create_only", lambda s, p, t: (_ for _ in ()).throw(OSError("lost")) if p.endswith("00002.json") else real(s, p, t))
    with pytest.raises(OSError):
        rd.run_rounds(*tables, counted, 4, store, rounds=4)
    assert asked == [0, 1, 2] and len(rd.rounds_done(spark, store)) == 2
    monkeypatch.setattr(files, "create_only", real)
    got = rd.run_rounds(*tables, counted, 4, store, rounds=4)
    # the replies of round 2 were stored: the model is not asked for them again
    assert asked == [0, 1, 2, 3, 4] and found(got) == plain(4, 4)
    assert found(rd.run_rounds(*tables, counted, 4, store, rounds=4)) == plain(4, 4) and len(asked) == 5


def test_inputs_that_are_not_accepted_are_not_appended(tables, tmp_path):
    got = rd.run_rounds(*tables, rd.model_call(model), 1, str(tmp_path / "s"), rounds=1, accept=lambda df: df.filter(~F.col("input_text").startswith("['")))
    assert found(got) and not any(x[3].startswith("['") for x in found(got))
