import os

from pyspark.sql import functions as F

from transeval.operators import testgen as tg
from transeval.sources import samples as sm
from transeval.sources import tasks as tk


def test_reply_lines_golden(spark):
    reply = "```\n1, 2 # c\n\n'a'\nfoo bar\n# only\n1,2\n[ 3 ]\n```"
    df = spark.createDataFrame([("t", reply, 0), ("u", "no fence", 0)], "task_id string, reply string, round_no int")
    lines = tg.reply_lines(df)
    assert [(r.line_no, r.input_text, r.shown) for r in lines.collect()] == [
        (1, "[1, 2]", "1, 2"), (3, "['a']", "'a'"), (5, "[]", ""), (6, "[1, 2]", "1, 2"), (7, "[[3]]", "[3]")]
    assert lines.filter("task_id = 'u'").count() == 0


def test_seed_selection_and_new_inputs(spark):
    pool = spark.createDataFrame([("t", i, f"in{i}") for i in range(9)] + [("s", 0, "only")],
                                 "task_id string, pos int, input_text string")
    seeds = tg.seed_selection(pool)
    per = {r.task_id: r["count"] for r in seeds.groupBy("task_id").count().collect()}
    assert per == {"t": 5, "s": 1}
    assert seeds.select("task_id", "pos").distinct().count() == 6
    cand = spark.createDataFrame([("t", "in1", 0, 0), ("t", "new", 0, 1), ("t", "new", 1, 0), ("t", "n2", 21, 0),
                                  ("t", "n3", 2, 0)], "task_id string, input_text string, round_no int, line_no int")
    new = tg.new_inputs(cand, pool, num=1)
    assert [(r.input_text, r.round_no, r.returned) for r in new.collect()] == [("new", 0, True)]
    # all that the last round brings goes to the pool, beyond what was asked for
    more = cand.unionByName(spark.createDataFrame([("t", "n4", 2, 1), ("t", "n5", 3, 0)], cand.schema))
    got = sorted((r.new_rank, r.input_text, r.returned) for r in tg.new_inputs(more, pool, num=2).collect())
    assert got == [(0, "new", True), (1, "n3", True), (2, "n4", False)]
    assert tg.pool_union(pool, tg.new_inputs(more, pool, num=2)).filter("origin = 'generated'").count() == 3
    shown = seeds.withColumnRenamed("input_text", "shown")
    msg = tg.seed_messages(spark.createDataFrame([("s", "def f(): pass")], "task_id string, code string"), shown).first()
    assert msg.message.startswith("Here is a function that we want to test:\n```\ndef f(): pass\n```\n")
    assert "```\nonly\n```\nPlease generate" in msg.message


def test_path_parse_and_extension(spark):
    p = "translations/codenet/deepseek-coder-6.7b-instruct/Java/Python/temperature_0.2-sanitized/p0001/10.py"
    df = spark.createDataFrame([(p,)], "path string")
    r = df.select(*sm.parse_path(F.col("path")), tk.extension(F.lit("C++")).alias("ext")).first()
    assert (r.dataset, r.model, r.source_lang, r.target_lang, r.temperature, r.stage, r.task_id, r.completion_id, r.ext) == \
        ("codenet", "deepseek-coder-6.7b-instruct", "Java", "Python", "0.2", "sanitized", "p0001", "10", ".cpp")


def test_class_rename(spark):
    df = spark.createDataFrame([("public class Main {}\nclass  Helper_2 {} // subclass x", "p$1")], "c string, t string")
    got = df.select(tk.java_class_rename(F.col("c"), F.col("t")).alias("o")).first().o
    assert got == "public class p$1 {}\nclass p$1 {} // subclass x"


def test_read_samples_keeps_empty_files(spark, tmp_path):
    root = tmp_path / "temperature_0.2"
    for task, files in {"p1": {"0.py": "x=1", "1.py": ""}, "p 2": {"0.py": "y+1", "0.java": "no"}}.items():
        os.makedirs(root / task)
        for name, text in files.items():
            (root / task / name).write_text(text)
    (root / "stray.py").write_text("not a task")
    got = sorted((r.task_id, r.completion_id, r.solution) for r in sm.read_samples(spark, str(root), "Python").collect())
    assert got == [("p 2", "0", "y+1"), ("p1", "0", "x=1"), ("p1", "1", "")]


def test_read_a_tree_of_configurations(spark, tmp_path):
    for model in ("m1", "m2"):
        d = tmp_path / "codenet" / model / "Java" / "Python" / "temperature_0.2" / "p1"
        os.makedirs(d)
        (d / "0.py").write_text(f"x={model!r}")
        (d / "1.py").write_text("")
    got = sorted((r.model, r.stage, r.task_id, r.completion_id, r.solution) for r in sm.read_sample_tree(spark, str(tmp_path), "Python").collect())
    assert got == [(m, "raw", "p1", i, s) for m in ("m1", "m2") for i, s in (("0", f"x={m!r}"), ("1", ""))]


def test_export_then_read_back(spark, tmp_path):
    df = spark.createDataFrame([("p/1", 0, ".py", "x=1"), ("p/1", 1, ".py", ""), ("q", 0, ".py", "y")],
                               "task_id string, idx int, ext string, solution string")
    root = str(tmp_path / "temperature_0.2")
    sm.export_sample_tree(df, root)
    got = sorted((r.task_id, r.completion_id, r.solution) for r in sm.read_samples(spark, root, "Python").collect())
    assert got == [("p_1", "0", "x=1"), ("p_1", "1", ""), ("q", "0", "y")]


def test_append_samples_skips_undecodable_text(spark, tmp_path):
    df = spark.createDataFrame([("m", "t", 0, b"ok"), ("m", "t", 1, b"\xff\xfe")],
                               "model string, task_id string, idx int, raw binary")
    df = df.withColumn("solution", F.col("raw").cast("string")).drop("raw")
    skipped = sm.append_samples(df, str(tmp_path / "s"), cfg=["model"])
    assert [r.idx for r in skipped.collect()] == [1]
    assert [(r.idx, r.solution) for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [(0, "ok")]


def test_read_exec_log_json_keeps_raw_bytes(spark, tmp_path):
    import base64
    import json
    from transeval.operators.verdict import judge, tests_from_tasks
    from transeval.sources.exec_log import read_exec_log
    recs = [{"task_id": "t", "completion_id": "0", "test_idx": 0, "compile_ok": True, "timed_out": False,
             "elapsed_s": 0.5, "stdout_b64": base64.b64encode(b"1\n").decode(), "stderr_b64": ""},
            {"task_id": "t", "completion_id": "1", "test_idx": 0, "compile_ok": True, "timed_out": False,
             "elapsed_s": 0.5, "stdout_b64": base64.b64encode(b"2").decode(), "stderr_b64": base64.b64encode(b"\xff").decode()}]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(r) for r in recs))
    log = read_exec_log(spark, str(tmp_path / "log.jsonl"), fmt="json", cfg=[])
    assert dict(log.dtypes)["stdout"] == "binary"
    tasks = spark.createDataFrame([("t", [("", "1")])], "task_id string, test_io array<struct<input:string, output:string>>")
    v = {r.completion_id: r.verdict for r in judge(log, tests_from_tasks(tasks)).collect()}
    assert v == {"0": "success", "1": "compile_failed"}      # undecodable stderr on a mismatch
