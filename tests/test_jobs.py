from pyspark.sql import functions as F

from transeval import jobs
from transeval.operators.verdict import tests_from_tasks

CFG = jobs.RUN_CFG


def test_translate_then_evaluate(spark):
    tasks = spark.createDataFrame([("codenet", "p1", "Java", "int x;", [("", "1")]),
                                   ("codenet", "p2", "Java", "int y;", [("", "2")]),
                                   ("codenet", "p3", "Python", "z", [("", "3")])],
                                  "dataset string, task_id string, language string, code string, "
                                  "test_io array<struct<input:string, output:string>>")
    runs = spark.createDataFrame([("codenet", "gpt-4", "Java", "Python", "0.2", "gpt", 2, 1, False),
                                  ("codenet", "nope", "Java", "Python", "0.2", "base", 2, 1, False)],
                                 "dataset string, model string, source_lang string, target_lang string, temperature string, "
                                 "prompt_type string, n_samples int, batch_size int, greedy boolean")
    existing = spark.createDataFrame([("codenet", "gpt-4", "Java", "Python", "0.2", "p1", 0)],
                                     ", ".join(f"{c} string" for c in CFG) + ", task_id string, idx int")
    out, rejected = jobs.translate(tasks, runs, existing, lambda prompts: ["print(1)</s>" for _ in prompts])
    assert [(r.model, r.registry_error) for r in rejected.collect()] == [("nope", "Invalid model name: nope")]
    got = sorted((r.task_id, r.idx, r.solution) for r in out.collect())
    assert got == [("p1", 1, "print(1)</s>"), ("p2", 0, "print(1)</s>"), ("p2", 1, "print(1)</s>")]
    assert all(r.prompt.startswith("You are a code translation expert.") for r in out.collect())

    log = out.select(*CFG, "task_id", F.col("idx").cast("string").alias("completion_id"),
                     F.lit(0).alias("test_idx"), F.lit(True).alias("compile_ok"), F.lit(False).alias("timed_out"),
                     F.lit(1.0).alias("elapsed_s"), F.when(F.col("task_id") == "p1", "1").otherwise("x").alias("stdout"),
                     F.lit("").alias("stderr"))
    java = tasks.withColumnRenamed("language", "source_lang")
    samples = log.select(*CFG, "task_id", "completion_id")
    tests = tests_from_tasks(tasks, ("dataset", "task_id"))
    e = jobs.evaluate(samples, java, tests, log, CFG)
    assert {(r.task_id, r.verdict) for r in e.verdicts.collect()} == {("p1", "success"), ("p2", "test_failed")}
    b = e.board.filter("k = 1").first()
    assert b.model == "gpt-4" and abs(b.pass_at_k - 0.5) < 1e-12 and e.problems.count() == 0
    docs = [r.document for r in jobs.evaluation_documents(e.verdicts, CFG, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()]
    assert len(docs) == 2
    # an unsampled task and a repeated sample keep a configuration from being scored
    short = jobs.evaluate(samples.filter("task_id = 'p1'"), java, tests, log, CFG)
    assert [(r.problem, r.subject) for r in short.problems.collect()] == [("missing task", "p2")]
    assert short.verdicts.count() == 1 and short.board.count() == 0
    twice = jobs.evaluate(samples.unionByName(samples.filter("task_id = 'p1'")), java, tests, log, CFG)
    assert [(r.problem, r.subject) for r in twice.problems.collect()] == [("repeated sample", "p1/1")] and twice.board.count() == 0
    # stored verdicts of a configuration are used, unless it is run again
    cached = e.verdicts.withColumn("verdict", F.lit("runtime_failed"))
    assert {r.verdict for r in jobs.evaluate(samples, java, tests, log, CFG, cached=cached).verdicts.collect()} == {"runtime_failed"}
    again = jobs.evaluate(samples, java, tests, log, CFG, cached=cached, rerun=True).verdicts
    assert {r.verdict for r in again.collect()} == {"success", "test_failed"}


def test_one_bad_prompt_costs_one_reply(spark):
    from transeval.operators.generate import generate

    def model(prompts):
        if "bad" in prompts:
            raise ValueError("bad")
        return [f"{p}@{len(prompts)}" for p in prompts]

    rows = [(i // 4, "bad" if i == 5 else f"p{i}") for i in range(500)]
    plan = spark.createDataFrame(rows, "batch_no int, prompt string").coalesce(1)
    got = [r.output for r in generate(plan, model, batch=["batch_no"], sentinel="ERROR").collect()]
    assert got.count("ERROR") == 1 and "p0@4" in got and "p4@1" in got and "p499@4" in got


def test_resume_fills_gaps_once(spark):
    tasks = spark.createDataFrame([("codenet", "p1", "Java", "c")], "dataset string, task_id string, language string, code string")
    runs = spark.createDataFrame([("codenet", "gpt-4", "Java", "Python", "0.2", "gpt", 4, 2, False)],
                                 "dataset string, model string, source_lang string, target_lang string, temperature string, "
                                 "prompt_type string, n_samples int, batch_size int, greedy boolean")
    existing = spark.createDataFrame([("codenet", "gpt-4", "Java", "Python", "0.2", "p1", i) for i in (0, 2)],
                                     ", ".join(f"{c} string" for c in CFG) + ", task_id string, idx int")
    out, _ = jobs.translate(tasks, runs, existing, lambda prompts: ["x"] * len(prompts))
    assert sorted((r.idx, r.batch_no) for r in out.collect()) == [(1, 0), (3, 0)]


def test_evaluate_command_keeps_versions(spark, tmp_path):
    import subprocess
    import sys
    d = str(tmp_path)
    spark.createDataFrame([("t", "Java", [("", "1")])], "task_id string, language string, test_io array<struct<input:string, output:string>>").write.parquet(f"{d}/tasks")
    spark.createDataFrame([("m", "Java", "t", "0")], "model string, source_lang string, task_id string, completion_id string").write.parquet(f"{d}/samples")
    spark.createDataFrame([("m", "Java", "t", "0", 0, True, False, 1.0, "1", "")],
                          "model string, source_lang string, task_id string, completion_id string, test_idx int, compile_ok boolean, "
                          "timed_out boolean, elapsed_s double, stdout string, stderr string").write.parquet(f"{d}/log")
    env = dict(__import__("os").environ, SPARK_MASTER="local[1]")
    for extra, versions in (([], {1}), ([], {1}), (["--rerun"], {1, 2})):
        subprocess.run([sys.executable, "-m", "transeval", "evaluate", "--exec_log", f"{d}/log", "--samples", f"{d}/samples", "--tasks", f"{d}/tasks",
                        "--out", f"{d}/out", *extra], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]), env=env, capture_output=True, timeout=300)
        rows = spark.read.parquet(f"{d}/out/verdicts").collect()
        assert {r.version for r in rows} == versions and {r.verdict for r in rows} == {"success"}


def test_clean_and_check(spark):
    samples = spark.createDataFrame([("codenet", "gpt-4", "Java", "Python", "0.2", "p1", "0", "```python\nx=1\n```",
                                      "r/codenet/gpt-4/Java/Python/temperature_0.2")],
                                    ", ".join(f"{c} string" for c in CFG) + ", task_id string, completion_id string, "
                                    "solution string, path string").withColumn("target_lang", F.col("target_lang"))
    cleaned, summary = jobs.clean(samples)
    assert [r.solution for r in cleaned.collect()] == ["x=1"]
    assert summary.first().n_total == 1
    tasks = samples.select(*CFG, "task_id").unionByName(
        samples.select(*CFG, F.lit("p2").alias("task_id")))
    compiled = cleaned.select(*CFG, "task_id", "completion_id", F.lit(True).alias("compile_ok"))
    rep, summ, comp = jobs.check(tasks, cleaned, compiled, CFG, nsample=1)
    assert sorted((r.task_id, r.status) for r in rep.collect()) == [("p1", "complete"), ("p2", "missing")]
    assert (summ.first().n_done, comp.first().n_wrong) == (1, 0)


def test_clean_command_on_a_sample_tree(spark, tmp_path):
    import subprocess
    import sys
    from transeval.sources import samples as sm
    root = tmp_path / "translations" / "codenet" / "gpt-4" / "Java" / "Python" / "temperature_0.2"
    df = spark.createDataFrame([("p1", 0, ".py", "Sure:\n```python\nprint(1)\n```\nHope this helps"),
                                ("p2", 0, ".py", "no fence here")], "task_id string, idx int, ext string, solution string")
    sm.export_sample_tree(df, str(root))
    out = tmp_path / "clean"
    env = dict(__import__("os").environ, SPARK_MASTER="local[1]")
    subprocess.run([sys.executable, "-m", "transeval", "clean", "--samples", str(root), "--target_lang", "Python",
                    "--out", str(out), "--remove_prompt"], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]),
                   env=env, capture_output=True, timeout=300)
    got = {r.task_id: (r.solution, r.model, r.stage) for r in spark.read.parquet(str(out)).collect()}
    assert got["p1"] == ("print(1)", "gpt-4", "sanitized")
    assert got["p2"][0] == "her"         # no opening fence: 8 characters go; no closing fence: the last goes


def test_translate_refuses_over_long_prompts(spark):
    tasks = spark.createDataFrame([("codenet", "p1", "Java", "x" * 400), ("codenet", "p2", "Java", "y")],
                                  "dataset string, task_id string, language string, code string")
    runs = spark.createDataFrame([("codenet", "santacoder", "Java", "Python", "0.2", "base", 1, 1, False)],
                                 "dataset string, model string, source_lang string, target_lang string, temperature string, "
                                 "prompt_type string, n_samples int, batch_size int, greedy boolean")
    existing = spark.createDataFrame([], ", ".join(f"{c} string" for c in CFG) + ", task_id string, idx int")
    calls = []
    out, _ = jobs.translate(tasks, runs, existing, lambda p: [calls.append(1) or "z=1" for _ in p],
                         token_count=lambda c: F.floor(F.length(c) / 4), context=60)
    got = {r.task_id: r.output for r in out.collect()}
    assert got == {"p1": "MODEL MAX LENGTH EXCEEDED", "p2": "z=1"}


def test_evaluate_command_keeps_types_and_stores_all(spark, tmp_path, capsys, monkeypatch):
    """Names and temperatures that look like numbers, more configurations than a screen has rows."""
    import transeval.__main__ as cli
    d = str(tmp_path)
    models = ["007", "1e5", *[f"m{i}" for i in range(28)]]
    cfg = [(m, "Java", t) for m in models for t in ("0.20", "0.2")]
    spark.createDataFrame([("t", "Java", [("", "1")]), ("u", "Java", [("", "2")])], "task_id string, language string, test_io array<struct<input:string, output:string>>").write.parquet(f"{d}/tasks")
    rows = [(*c, t, "0") for c in cfg for t in "tu" if not (c[0] == "m3" and t == "u")]
    spark.createDataFrame(rows, "model string, source_lang string, temperature string, task_id string, completion_id string").write.parquet(f"{d}/samples")
    spark.createDataFrame([(*r, 0, True, False, 1.0, "1", "") for r in rows],
                          "model string, source_lang string, temperature string, task_id string, completion_id string, test_idx int, compile_ok boolean, "
                          "timed_out boolean, elapsed_s double, stdout string, stderr string").write.parquet(f"{d}/log")
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    args = ["evaluate", "--exec_log", f"{d}/log", "--samples", f"{d}/samples", "--tasks", f"{d}/tasks", "--out", f"{d}/out"]
    cli.main(args)
    shown = capsys.readouterr().out
    sound = [c for c in cfg if c[0] != "m3"]
    board = spark.read.parquet(f"{d}/out/board")
    got = {(r.model, r.source_lang, r.temperature): r.pass_at_k for r in board.filter("k = 1").collect()}
    assert got == {c: 0.5 for c in sound} and len(sound) == 58
    assert all(f"|{m}" in shown or f" {m}" in shown for m in models)
    problems = {(r.model, r.temperature, r.problem, r.subject) for r in spark.read.parquet(f"{d}/out/problems").collect()}
    assert problems == {("m3", t, "missing task", "u") for t in ("0.20", "0.2")}
    assert spark.read.parquet(f"{d}/out/scores").filter("k = 1").count() == 2 * len(sound)
    cli.main([*args, "--once"])  # all are stored: nothing is judged again, the same is scored
    again = {(r.model, r.source_lang, r.temperature): r.pass_at_k for r in spark.read.parquet(f"{d}/out/board").filter("k = 1").collect()}
    assert again == got
    from transeval.sources import commits
    assert {r.version for r in commits.records(spark, f"{d}/out/verdicts").collect()} == {1}
    cli.main([*args, "--rerun", "--once"])
    assert {r.version for r in commits.newest(spark, f"{d}/out/verdicts").values()} == {2}


def test_equal_outputs_judged_once(spark):
    """Same outcomes as row by row: nulls, binary outputs, missing tests, compile-only rows."""
    from transeval.operators.verdict import attach_expected, test_outcomes, test_outcomes_once
    tests = spark.createDataFrame([("t", 0, "1.50"), ("t", 1, "x"), ("u", 0, None)], "task_id string, test_idx int, expected string")
    outs = [b"1.5", b"1.504\n", b"x ", b"", b"\xff", None]
    rows = [(k, f"{i}{j}", t, True, False, 1.0, o, e) for i, o in enumerate(outs) for j in range(4) for k, t in (("t", 0), ("t", 1), ("t", 2), ("u", 0), ("z", 0))
            for e in (b"", b"\xff") if (e == b"") == (j < 3)]
    rows += [("t", "c", None, False, False, 0.0, None, b"error")]
    schema = "task_id string, completion_id string, test_idx int, compile_ok boolean, timed_out boolean, elapsed_s double, stdout binary, stderr binary"
    log = spark.createDataFrame(rows, schema)
    cols = ["task_id", "completion_id", "test_idx", "matched", "outcome"]
    want, got = test_outcomes(attach_expected(log, tests)).select(*cols), test_outcomes_once(log, tests).select(*cols)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # the comparison sees each output of a test once
    judged = log.filter("test_idx is not null").select("task_id", "test_idx", "stdout").distinct().count()
    plan = test_outcomes_once(log, tests)._jdf.queryExecution().optimizedPlan().toString()
    assert judged == 30 < log.count() / 3 and "Aggregate" in plan
