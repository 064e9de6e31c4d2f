from transeval.sources.runs import record_run
from transeval.streaming.incremental import EXEC_LOG_SCHEMA, current_leaderboard, score_stream
from transeval.operators.sanitize import sanitize, sanitize_summary


def test_stream_scores_new_files_once(spark, tmp_path):
    tests = spark.createDataFrame([("t", 0, "", "1"), ("t", 1, "", "2")], "task_id string, test_idx int, input string, expected string")
    logs, out, ck = str(tmp_path / "logs"), str(tmp_path / "verdicts"), str(tmp_path / "ck")
    first = [("t", "0", 0, True, False, 1.0, "1", ""), ("t", "0", 1, True, False, 1.0, "2", "")]
    second = [("t", "1", 0, True, False, 1.0, "x", "")]
    spark.createDataFrame(first, EXEC_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(logs)
    score_stream(spark, logs, tests, out, ck).awaitTermination()
    spark.createDataFrame(second, EXEC_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(logs)
    score_stream(spark, logs, tests, out, ck).awaitTermination()    # resumes: only the new file
    v = {r.completion_id: r.verdict for r in spark.read.parquet(out).collect()}
    assert v == {"0": "success", "1": "test_failed"}
    assert spark.read.parquet(out).count() == 2
    b = current_leaderboard(spark, out).filter("k = 1").first()
    assert abs(b.pass_at_k - 0.5) < 1e-12


def test_run_rows_and_sanitize_summary(spark, tmp_path):
    path = str(tmp_path / "runs")
    record_run(spark, path, {"dataset": "codenet", "model": "m", "source_lang": "Java", "target_lang": "Python",
                             "temperature": 0.2}, "started", {"batch_size": 1}, {"n_samples": 10})
    record_run(spark, path, {"dataset": "codenet", "model": "m"}, "finished")
    assert sorted(r.event for r in spark.read.parquet(path).collect()) == ["finished", "started"]
    df = spark.createDataFrame([("a", "x", "Python", "m/magicoder/t"), ("b", "@@ Responsey", "Python", "m/magicoder/t")],
                               "task_id string, solution string, target_lang string, path string")
    s = sanitize_summary(sanitize(df)).first()
    assert (s.n_total, s.n_failed) == (2, 1)
