"""Sample trees: reading by folders, writing with a commit."""

import os

import pytest
from pyspark.sql import functions as F

from transeval.sources import samples as sm
from transeval.sources import tree


def make(root, files):
    for path, text in files.items():
        p = os.path.join(root, path)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(text.encode())


def all_files(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


TREE = {f"codenet/{m}/Java/{t}/temperature_0.{x}{s}/task {k}/{i}{e}": f"{m}{t}{k}{i}" * (i != 1)
        for m in ("m 1", "007") for t, e in (("Python", ".py"), ("Go", ".go")) for x in (2, 8) for s in ("", "-sanitized") for k in range(3) for i in range(3)}


def found(df):
    return sorted((r.dataset, r.model, r.target_lang, r.temperature, r.stage, r.task_id, r.completion_id, r.solution) for r in df.collect())


def wanted(keep=lambda *c: True):
    out = []
    for path, text in TREE.items():
        d, m, _, t, temp, task, name = path.split("/")
        value = temp.removeprefix("temperature_")
        row = (d, m, t, value.removesuffix("-sanitized"), "sanitized" if value.endswith("-sanitized") else "raw", task, name.split(".")[0], text)
        if t == "Python" and keep(*row):
            out.append(row)
    return sorted(out)


@pytest.fixture
def root(tmp_path):
    make(tmp_path, TREE)
    # neither samples nor configurations
    make(tmp_path, {"stray.py": "x", "codenet/m 1/Java/Python/other/t/0.py": "x", "codenet/m 1/Java/Python/temperature_0.2/0.py": "x",
                    "codenet/m 1/Java/Python/temperature_0.2/task 0/deeper/9.py": "x", "codenet/m 1/Java/Python/temperature_0.2/task 0/0.txt": "x"})
    return str(tmp_path)


@pytest.mark.parametrize("slices", [1, 3])
def test_whole_tree(spark, root, slices):
    assert found(sm.read_sample_tree(spark, root, "Python", slices)) == wanted()


def test_equal_to_sparks_text_reader(spark, root):
    config = f"{root}/codenet/m 1/Java/Python/temperature_0.2"
    text = spark.read.text(f"{config}/*/*.py", wholetext=True).select("value", F.url_decode("_metadata.file_path").alias("p"))
    want = sorted((r.value, r.p.removeprefix("file://").removeprefix("file:")) for r in text.collect())
    got = sorted((r.solution, r.identifier) for r in sm.read_samples(spark, config, "Python").filter("solution <> ''").collect())
    assert got == want and len(got) == 6


def test_filters_choose_the_folders_listed(spark, root, monkeypatch):
    df = sm.read_sample_tree(spark, root, "Python").filter((F.col("model") == "007") & F.col("temperature").isin("0.2", "0.9") & (F.col("task_id") == "task 1"))
    assert found(df) == wanted(lambda d, m, t, x, s, task, *_: m == "007" and x == "0.2" and task == "task 1")
    reader = tree.TreeReader({"path": root, "ext": ".py"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    left = list(reader.pushFilters([EqualTo(("model",), "007"), In(("temperature",), ("0.2", "0.9")), EqualTo(("task_id",), "x"), GreaterThan(("stage",), "a")]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "GreaterThan"]
    listed = []
    real = tree.names
    monkeypatch.setattr(tree, "names", lambda fs, path, kind: listed.append(os.path.relpath(path, root)) or real(fs, path, kind))
    shares = reader.partitions()
    assert {s.config[1] for s in shares} == {"007"} and len(shares) == 4 * tree.SLICES
    # the driver lists nothing of another model, and nothing below a configuration
    assert not any("m 1" in x or "temperature" in x for x in listed)


def test_no_tree(spark, tmp_path):
    assert sm.read_sample_tree(spark, str(tmp_path / "none"), "Python").collect() == []


SAMPLES = "task_id string, idx int, ext string, solution string"


def test_written_tree_is_read_back(spark, tmp_path):
    cfg = [("codenet", "m/../1".replace("/", "_"), "Java", "Python", "0.20", s) for s in ("raw", "sanitized")]
    rows = [(*c, f"p/{k}", i, ".py", "" if i == 2 else f"é{k}{i}\r\n") for c in cfg for k in range(4) for i in range(3)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in sm.CFG) + ", " + SAMPLES)
    for _ in range(2):  # once more leaves the same
        sm.export_sample_tree(df.repartition(5), str(tmp_path))
    assert len(all_files(tmp_path)) == len(rows)
    got = sorted((r.model, r.temperature, r.stage, r.task_id, r.completion_id, r.solution) for r in sm.read_sample_tree(spark, str(tmp_path), "Python").collect())
    assert got == sorted((r[1], r[4], r[5], r[6].replace("/", "_"), str(r[7]), r[9]) for r in rows)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    sm.export_sample_tree(spark.createDataFrame([("p", 0, ".py", "old")], SAMPLES), str(tmp_path))
    rows = [("p", i, ".py", None if i == 90 else "new") for i in range(100)]
    with pytest.raises(Exception, match="without a name or a text"):
        sm.export_sample_tree(spark.createDataFrame(rows, SAMPLES).repartition(4), str(tmp_path))
    assert all_files(tmp_path) == ["p/0.py"] and (tmp_path / "p" / "0.py").read_text() == "old"
    assert os.listdir(tmp_path) == ["p"]


def test_a_doubled_attempt_leaves_no_file(tmp_path):
    import pyarrow as pa

    def batch(*rows):
        return iter([pa.RecordBatch.from_pylist([{"file": f, "solution": s} for f, s in rows])])

    writer = tree.TreeWriter({"path": str(tmp_path)})
    first = writer.write(batch(("p/0.py", "x"), ("p/1.py", "y")))
    # the other attempt of the same task got further, or saw other rows: Spark has not taken it
    writer.write(batch(("p/0.py", "z"), ("p/1.py", "z"), ("p/2.py", "z")))
    other = writer.write(batch(("q/0.py", "q")))
    assert not (tmp_path / "p").exists()  # nothing is seen before the commit
    writer.commit([first, other, writer.write(iter([])), None])
    assert all_files(tmp_path) == ["p/0.py", "p/1.py", "q/0.py"] and (tmp_path / "p" / "0.py").read_text() == "x"
    again = tree.TreeWriter({"path": str(tmp_path)})
    again.write(batch(("r/0.py", "r")))
    again.abort([None])
    # an attempt that outlives its job fails
    with pytest.raises(OSError):
        again.write(batch(("s/0.py", "s")))
    assert sorted(os.listdir(tmp_path)) == ["p", "q"]


@pytest.mark.parametrize("name", ["../x.py", "a//b.py", "/a.py", "a/./b.py"])
def test_names_stay_below_the_root(tmp_path, name):
    import pyarrow as pa

    with pytest.raises(ValueError, match="below the root"):
        tree.TreeWriter({"path": str(tmp_path)}).write(iter([pa.RecordBatch.from_pylist([{"file": name, "solution": "x"}])]))
