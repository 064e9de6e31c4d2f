import json

import pytest
from pyspark.sql import functions as F

from transeval.operators import check as ck
from transeval.operators import results as rs
from transeval.operators.ordered import position_in_group


def _samples(spark, counts):
    rows = [(t, str(i), f"{t}/{i}.py", "x=1") for t, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "task_id string, completion_id string, identifier string, solution string")


def test_completeness_golden(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task_id string")
    rep = ck.completeness(tasks, _samples(spark, {"a": 3, "b": 2}), nsample=2)
    got = {r.task_id: (r.n_files, r.expected, r.status) for r in rep.collect()}
    assert got == {"a": (3, 3, "complete"), "b": (2, 3, "short"), "c": (0, 3, "missing")}
    s = ck.completeness_summary(rep).first()
    assert (s.n_tasks, s.n_done, s.n_incomplete) == (3, 1, 2)


def test_compile_report_golden(spark):
    samples = spark.createDataFrame([("t", "0", "x=1"), ("t", "1", "x="), ("t", "2", " \n")],
                                    "task_id string, completion_id string, solution string")
    compiled = samples.select("task_id", "completion_id", (F.col("solution") == "x=1").alias("compile_ok"))
    r = ck.compile_report(samples, compiled).first()
    assert (r.n_code, r.n_wrong, r.n_unchecked, r.pct_wrong) == (3, 2, 0, 66.67)
    # a missing text is blank; a text that no compiler has seen is neither right nor wrong
    more = samples.unionByName(spark.createDataFrame([("t", "3", None), ("t", "4", "y=1")], samples.schema))
    r = ck.compile_report(more, compiled).first()
    assert (r.n_code, r.n_wrong, r.n_unchecked, r.pct_wrong) == (5, 3, 1, 60.0)
    empty = ck.compile_report(samples.limit(0), compiled.limit(0)).collect()
    assert empty == [] or empty[0].pct_wrong == 0.0


def test_attach_tasks_first_by_position_and_orphans(spark):
    tasks = spark.createDataFrame([("a", "first", 0), ("a", "second", 1), ("b", "only", 0)],
                                  "task_id string, code string, pos int")
    samples = _samples(spark, {"a": 1, "z": 1})
    joined, orphans = ck.attach_tasks(samples, tasks, position="pos")
    assert [(r.task_id, r.code) for r in joined.collect()] == [("a", "first")]
    assert [r.task_id for r in orphans.collect()] == ["z"]
    _, strict = ck.attach_tasks(samples, tasks, position="pos", strict=True)
    with pytest.raises(Exception):
        strict.collect()


def test_integrity(spark):
    s = _samples(spark, {"a": 2, "b": 1}).unionByName(_samples(spark, {"a": 1}))   # duplicate identifier a/0
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task_id string")
    finished = _samples(spark, {"a": 2})
    r = ck.integrity(s, tasks, finished).first()
    assert (r.n_rows, r.n_identifiers, r.n_sampled_tasks, r.n_tasks, r.n_unfinished) == (4, 3, 2, 3, 2)
    assert not r.no_duplicates and not r.all_tasks_sampled and not r.all_finished


def test_verdict_order_is_textual_and_keeps_nulls(spark):
    v = spark.createDataFrame([("t", "0", "success"), ("t", "1", None), ("t", "2", "test_failed"), ("t", "10", "success")],
                              "task_id string, completion_id string, verdict string")
    rec = rs.task_records(v).first()
    assert rec.nfiles == 4 and rec.part == 0 and list(rec.base) == ["success", None, "success", "test_failed"]
    parts = sorted((r.part, r.nfiles, list(r.base)) for r in rs.task_records(v, part_verdicts=3).collect())
    assert parts == [(0, 4, ["success", None, "success"]), (1, 4, ["test_failed"])]
    pos = {r.completion_id: (r.pos, r.nfiles) for r in rs.verdict_positions(v).collect()}
    assert pos == {"0": (0, 4), "1": (1, 4), "10": (2, 4), "2": (3, 4)}


def test_documents_round_trip_and_legacy(spark, tmp_path):
    v = spark.createDataFrame([("m", "t1", "0", "success"), ("m", "t1", "1", None)],
                              "model string, task_id string, completion_id string, verdict string")
    docs = rs.result_documents(v, ["model"], date_col=F.lit("2024-01-02 03:04:05").cast("timestamp"))
    out = str(tmp_path / "docs")
    rs.write_result_documents(docs, out, ["model"])
    back = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert back == [{"task_id": "t1", "part": 0, "nfiles": 2, "base": ["success", None], "date": "2024-01-02 03:04"}]
    with pytest.raises(Exception):
        rs.write_result_documents(docs, out, ["model"])          # never overwrites
    legacy = {"date": "2024-01-01 00:00", "eval": {"p1": {"files": ["a", "b", "c"], "base": ["success"] * 3},
                                                   "p2": {"nfiles": 2, "base": ["test_failed", None]}}}
    (tmp_path / "eval_results.json").write_text(json.dumps(legacy))
    got = {r.task_id: r.nfiles for r in rs.read_result_documents(spark, str(tmp_path / "eval_results.json")).collect()}
    assert got == {"p1": 3, "p2": 2}


def test_cache_and_versions(spark):
    samples = spark.createDataFrame([("c1", "t", "0"), ("c2", "t", "0")], "cfg string, task_id string, completion_id string")
    cached = spark.createDataFrame([("c1", "t", "0", "success")], "cfg string, task_id string, completion_id string, verdict string")
    got = {r.cfg: (r.state, r.verdict) for r in rs.plan_evaluation(samples, cached, ["cfg"]).collect()}
    assert got == {"c1": ("cached", "success"), "c2": ("pending", None)}
    assert {r.state for r in rs.plan_evaluation(samples, cached, ["cfg"], rerun=True).collect()} == {"pending"}
    vers = spark.createDataFrame([("t", 1, "test_failed"), ("t", 2, None)], "task_id string, version int, verdict string")
    r = rs.latest_versions(vers, ["task_id"], "version").first()
    assert (r.n_versions, r.version, r.verdict) == (2, 2, None)


def test_written_documents_are_read_back(spark, tmp_path):
    v = spark.createDataFrame([(m, t, str(i), None if i % 3 else f"v{i}") for m in "ab" for t in ("t1", "t2") for i in range(7)],
                              "model string, task_id string, completion_id string, verdict string")
    out = str(tmp_path / "docs")
    rs.write_result_documents(rs.result_documents(v, ["model"], part_verdicts=3), out, ["model"])
    back = rs.read_result_lines(spark, out)
    want = rs.verdict_positions(v, ["model"]).select("model", "task_id", "nfiles", "pos", "verdict")
    assert sorted(map(repr, back.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_documents_keep_names_that_look_like_numbers(spark, tmp_path):
    v = spark.createDataFrame([(m, t, "t", "0", "success") for m in ("007", "1e5") for t in ("0.20", "0.2")],
                              "model string, temperature string, task_id string, completion_id string, verdict string")
    out = str(tmp_path / "docs")
    rs.write_result_documents(rs.result_documents(v, ["model", "temperature"]), out, ["model", "temperature"])
    back = rs.read_result_lines(spark, out)
    assert sorted((r.model, r.temperature) for r in back.collect()) == [("007", "0.2"), ("007", "0.20"), ("1e5", "0.2"), ("1e5", "0.20")]
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"


def test_latest_version_keeps_large_numbers_and_any_label(spark):
    big = 1_800_000_000_000_000_001
    rows = [("t", big, "flaky"), ("t", big - 1, "success"), ("u", 1, None)]
    df = spark.createDataFrame(rows, "task_id string, version long, verdict string")
    got = {r.task_id: (r.n_versions, r.version, r.verdict) for r in rs.latest_versions(df, ["task_id"], "version").collect()}
    assert got == {"t": (2, big, "flaky"), "u": (1, 1, None)}


@pytest.mark.parametrize("sampled, large", [(64, 512), (2, 8)])
def test_position_in_group_equals_a_window(spark, monkeypatch, sampled, large):
    from pyspark.sql import Window

    from transeval.operators import ordered
    monkeypatch.setattr(ordered, "SAMPLED", sampled)
    monkeypatch.setattr(ordered, "LARGE_SAMPLE", large)
    monkeypatch.setattr(ordered, "SLICE_SAMPLE", large // 4)
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        F.when(F.col("l_orderkey") % 9 > 0, F.col("l_orderkey") % 5).alias("k"), F.monotonically_increasing_id().alias("n"))
    li = li.withColumn("t", F.col("n").cast("string"))
    for order in ("n", "t"):
        w = Window.partitionBy("k").orderBy(order)
        ref = li.withColumn("p", F.row_number().over(w) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("k")))
        got = position_in_group(li, ["k"], [order], pos_col="p", size_col="m")
        assert got.select("k", "n", "p", "m").exceptAll(ref.select("k", "n", "p", "m")).count() == 0
        assert got.count() == li.count()


def test_versioned_results(spark, tmp_path):
    path = str(tmp_path / "results")
    v1 = spark.createDataFrame([("m", "t", "0", "test_failed")], "model string, task_id string, completion_id string, verdict string")
    v2 = spark.createDataFrame([("m", "t", "0", "success")], "model string, task_id string, completion_id string, verdict string")
    assert {r.version for r in rs.write_versioned(v1, path, ["model"]).collect()} == {1}
    assert {r.version for r in rs.write_versioned(v2, path, ["model"]).collect()} == {2}
    latest = rs.read_latest(spark, path, ["model"]).collect()
    assert [(r.verdict, r.version) for r in latest] == [("success", 2)]
    assert spark.read.parquet(path).count() == 2          # the older version is kept


def test_integrity_per_config(spark):
    s = spark.createDataFrame([("m1", "a", "a/0"), ("m1", "b", "b/0"), ("m2", "a", "a/0"), ("m2", "a", "a/0")],
                              "model string, task_id string, identifier string")
    tasks = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "a"), ("m2", "b")], "model string, task_id string")
    finished = s.filter("model = 'm1'")
    got = {r.model: (r.n_rows, r.n_identifiers, r.n_sampled_tasks, r.n_tasks, r.n_unfinished)
           for r in ck.integrity(s, tasks, finished, cfg=["model"]).collect()}
    assert got == {"m1": (2, 2, 2, 2, 0), "m2": (2, 1, 1, 2, 2)}


def test_scale_settings():
    from transeval.session import scale_settings
    conf = scale_settings(100 << 40, cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert scale_settings(1 << 20, cores=8)["spark.sql.shuffle.partitions"] == "16"


def test_checkpoint_dir_needs_shared_storage_off_local_mode():
    from transeval.session import checkpoint_dir

    class Conf(dict):
        """A session's settings: reading only."""

    class Ctx:
        def __init__(self, master, d=None):
            self.master, self.d = master, d

        def getCheckpointDir(self):
            return self.d

        def setCheckpointDir(self, d):
            self.d = d

    class Session:
        def __init__(self, master, conf=None):
            self.conf, self.sparkContext = Conf(conf or {}), Ctx(master)

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session("yarn"))
    named = Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert checkpoint_dir(named) == "hdfs:///shared/ckpt" and named.sparkContext.d == "hdfs:///shared/ckpt"
    local = Session("local[2]")
    assert checkpoint_dir(local) and local.sparkContext.d


def test_a_real_session_without_the_setting_gets_a_folder(tmp_path):
    import subprocess
    import sys
    code = """
from transeval.session import checkpoint_dir, get_session
s = get_session(master="local[1]")
path = checkpoint_dir(s)
s.range(3).checkpoint()
print("PATH", path, s.sparkContext.master, "spark.sql.shuffle.partitions" in dict(s.sparkContext.getConf().getAll()))
"""
    import os
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)}).stdout
    assert "PATH /" in out and out.split("PATH")[1].split()[1:] == ["local[1]", "False"]
