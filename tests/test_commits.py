"""The commit log: types, crashes, conflicts, keyed merges."""

import threading

import pytest
from pyspark.sql import functions as F

from transeval.operators import results as rs
from transeval.sources import commits, files
from transeval.sources import samples as sm

SCHEMA = "model string, temperature string, task_id string, completion_id string, verdict string"


def verdicts(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def found(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_values_come_back_as_written(spark, tmp_path):
    path, cfg = str(tmp_path / "s"), ["model", "temperature"]
    rows = [("007", "0.20", "t", "0", "success"), ("1e5", "0.2", "t", "0", None), (None, "0.2", "t", "0", "success"),
            ("a/b=c d", "%41", "t", "0", "success"), ("", "0.2", "t", "0", "success")]
    rs.write_versioned(verdicts(spark, *rows), path, cfg)
    back = rs.read_latest(spark, path, cfg)
    assert found(back, *SCHEMA.replace(" string", "").split(", ")) == sorted(rows, key=repr)
    assert dict(back.dtypes)["model"] == dict(back.dtypes)["temperature"] == "string"


def test_only_the_configurations_written_get_a_version(spark, tmp_path):
    path, cfg = str(tmp_path / "s"), ["model", "temperature"]
    a, b = ("a", "1", "t", "0", "success"), ("b", "1", "t", "0", "success")
    rs.write_versioned(verdicts(spark, a, b), path, cfg)
    again = rs.write_versioned(verdicts(spark, (*a[:4], "test_failed")), path, cfg)
    assert found(again, "model", "verdict", "version") == [("a", "test_failed", 2)]
    assert found(rs.read_latest(spark, path, cfg), "model", "verdict", "version") == [("a", "test_failed", 2), ("b", "success", 1)]
    assert commits.records(spark, path).count() == 3


def test_many_configurations(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(f"m{i}", "1", "t", str(k), "success") for i in range(30) for k in range(2)]
    rs.write_versioned(verdicts(spark, *rows), path, ["model", "temperature"])
    assert rs.read_latest(spark, path, ["model"]).groupBy("model").count().filter("count = 2").count() == 30
    # rows of many tasks become a file or so for each configuration
    rs.write_versioned(verdicts(spark, *rows).repartition(40), path, ["model", "temperature"])
    assert len(list((tmp_path / "s").glob("write=*/part=*/version=2/*.parquet"))) <= 60


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path, cfg = str(tmp_path / "s"), ["model", "temperature"]
    row = ("m", "1", "t", "0", "success")
    rs.write_versioned(verdicts(spark, row), path, cfg)
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            rs.write_versioned(verdicts(spark, (*row[:4], "half")), path, cfg)
    assert found(rs.read_latest(spark, path, cfg), "verdict", "version") == [("success", 1)]
    assert len(commits.unreferenced(spark, path)) == 1
    rs.write_versioned(verdicts(spark, (*row[:4], "whole")), path, cfg)
    assert found(rs.read_latest(spark, path, cfg), "verdict", "version") == [("whole", 2)]


def test_a_write_that_another_is_ahead_of_takes_the_next_number(spark, tmp_path, monkeypatch):
    path, cfg = str(tmp_path / "s"), ["model", "temperature"]
    rows = {m: (m, "1", "t", "0", "success") for m in "ab"}
    rs.write_versioned(verdicts(spark, *rows.values()), path, cfg)
    real, done = commits.commit, []

    def late(session, root, record):
        if not done:  # another writer commits the same configuration first
            done.append(record.config)
            write = commits.put(verdicts(spark, (*rows["a"][:4], "other")), root, cfg, F.lit(2), "version")
            config = write[1].first().config
            real(session, root, commits.Record(config, 2, write[0], {"": commits.folder(write[0], config, "2", "version")}, record.schema, 1))
        return real(session, root, record)

    monkeypatch.setattr(commits, "commit", late)
    mine = rs.write_versioned(verdicts(spark, *[(*r[:4], "mine") for r in rows.values()]), path, cfg)
    assert found(mine, "model", "verdict", "version") == [("a", "mine", 3), ("b", "mine", 2)]
    assert found(rs.read_latest(spark, path, cfg), "model", "version") == [("a", 3), ("b", 2)]


def test_one_of_several_creators_is_first(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append((i, files.create_only(spark, str(tmp_path / "r.json"), f"text {i}")))) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    first = [i for i, ok in won if ok]
    assert len(first) == 1 and len(won) == 6
    assert not files.create_only(spark, str(tmp_path / "r.json"), "late")
    assert (tmp_path / "r.json").read_text() == f"text {first[0]}" == files.read_text(spark, str(tmp_path / "r.json"))
    assert files.children(spark, str(tmp_path)) == ["r.json"]


def test_creation_by_renaming(spark, tmp_path, monkeypatch):
    """The way of file systems that are not local."""
    class Scheme:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def getUri(self):  # noqa: N802
            uri = self.fs.getUri()
            return uri if calls.append(1) or len(calls) % 2 == 0 else type("U", (), {"getScheme": lambda _: "other"})()

    calls: list[int] = []
    real = files._file_system
    monkeypatch.setattr(files, "_file_system", lambda s, p: (*(x := real(s, p))[:3], Scheme(x[3])))
    path = str(tmp_path / "log" / "r.json")
    assert files.create_only(spark, path, "first é") and not files.create_only(spark, path, "second")
    assert (tmp_path / "log" / "r.json").read_text() == "first é"
    assert [x for x in files.children(spark, str(tmp_path / "log")) if not x.endswith(".crc")] == ["r.json"]


def test_types_that_changed_between_runs_are_read_as_text(spark, tmp_path):
    path = str(tmp_path / "s")
    commits.write_version(spark.createDataFrame([("a", 0.5)], "model string, score double"), path, ["model"])
    commits.write_version(spark.createDataFrame([("b", "high", 1)], "model string, score string, extra int"), path, ["model"])
    back = commits.read_newest(spark, path)
    assert found(back, "model", "score", "extra") == [("a", "0.5", None), ("b", "high", 1)]


SAMPLES = "model string, task_id string, idx int, solution string"


def samples(spark, *rows):
    return spark.createDataFrame(list(rows), SAMPLES)


def test_a_batch_written_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    batch = samples(spark, *[(m, f"t/{t}", i, f"{m}{t}{i}") for m in ("007", "b") for t in range(9) for i in range(2)])
    sm.append_samples(batch, path, ["model"])
    before = {r.config: (r.version, tuple(sorted(r.folders.items()))) for r in commits.records(spark, path).collect()}
    sm.append_samples(batch, path, ["model"])
    sm.append_samples(batch.filter("idx = 1").withColumn("solution", F.lit("another reply")), path, ["model"])
    assert {r.config: (r.version, tuple(sorted(r.folders.items()))) for r in commits.records(spark, path).collect()} == before
    assert found(sm.stored_samples(spark, path), "model", "task_id", "idx", "solution") == sorted(
        (m, f"t_{t}", i, f"{m}{t}{i}") for m in ("007", "b") for t in range(9) for i in range(2))
    assert commits.unreferenced(spark, path) == []


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    path = str(tmp_path / "s")
    sm.append_samples(samples(spark, *[("m", f"t{t}", 0, "x") for t in range(40)], ("n", "t0", 0, "x")), path, ["model"])
    old = {c: r.folders for c, r in commits.newest(spark, path).items()}
    sm.append_samples(samples(spark, ("m", "t3", 0, "again"), ("m", "t3", 1, "y"), ("m", "t3", 1, "z"), ("m", None, 0, "n"), ("m", None, 0, "n")), path, ["model"])
    new = commits.newest(spark, path)
    changed = {(c, b) for c, r in new.items() for b, f in r.folders.items() if old[c].get(b) != f}
    assert 1 <= len(changed) <= 2 and {r.version for r in new.values()} == {1, 2}
    got = found(sm.stored_samples(spark, path), "model", "task_id", "idx", "solution")
    assert len(got) == 43 and ("m", "t3", 1, "y") in got and ("m", "t3", 0, "x") in got and ("m", None, 0, "n") in got


def test_a_merge_that_another_is_ahead_of_merges_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    sm.append_samples(samples(spark, ("m", "t", 0, "x")), path, ["model"])
    real, done = commits._commit_all, []

    def late(*args):
        if not done:
            done.append(1)
            sm.append_samples(samples(spark, ("m", "t", 1, "theirs"), ("m", "t", 2, "theirs")), path, ["model"])
        return real(*args)

    monkeypatch.setattr(commits, "_commit_all", late)
    sm.append_samples(samples(spark, ("m", "t", 1, "mine"), ("m", "t", 3, "mine")), path, ["model"])
    assert found(sm.stored_samples(spark, path), "idx", "solution") == [(0, "x"), (1, "theirs"), (2, "theirs"), (3, "mine")]
    assert max(r.version for r in commits.records(spark, path).collect()) == 3


def test_an_empty_write(spark, tmp_path):
    path = str(tmp_path / "s")
    assert rs.read_latest_or_none(spark, path, ["model"]) is None and sm.stored_samples(spark, path) is None
    rs.write_versioned(verdicts(spark).limit(0), path, ["model", "temperature"])
    sm.append_samples(samples(spark).limit(0), path, ["model"])
    assert rs.read_latest_or_none(spark, path, ["model"]) is None
