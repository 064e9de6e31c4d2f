import math

from pyspark.sql import functions as F

from transeval.functions.metrics import pass_at_k, score_label
from transeval.operators.leaderboard import leaderboard, task_scores


def exact(n, c, k):
    if n - c < k:
        return 1.0
    return 1.0 - math.comb(n - c, k) / math.comb(n, k)


def test_golden_rows(spark):
    df = spark.createDataFrame([(10, 0, 1), (10, 3, 1), (10, 3, 5), (10, 10, 5), (4, 0, 5)], "n long, c long, k int")
    got = [r.p for r in df.select(pass_at_k("n", "c", "k").alias("p")).collect()]
    assert got[0] == 0.0
    assert abs(got[1] - 0.3) < 1e-12
    assert abs(got[2] - (1 - 21 / 252)) < 1e-12
    assert got[3] == 1.0 and got[4] == 1.0


def test_matches_binomial_form_on_a_grid(spark):
    grid = [(n, c, k) for n in range(1, 41) for c in range(0, n + 1) for k in (1, 2, 5, 10)]
    df = spark.createDataFrame(grid, "n long, c long, k int").withColumn("p", pass_at_k("n", "c", "k"))
    for n, c, k, p in [(r.n, r.c, r.k, r.p) for r in df.collect()]:
        assert abs(p - exact(n, c, k)) < 1e-9
        assert 0.0 <= p <= 1.0
        if k == 1:
            assert abs(p - c / n) < 1e-12


def test_monotone_in_c_and_k(spark):
    grid = [(20, c, k) for c in range(21) for k in range(1, 8)]
    df = spark.createDataFrame(grid, "n long, c long, k int").withColumn("p", pass_at_k("n", "c", "k"))
    p = {(r.c, r.k): r.p for r in df.collect()}
    for c in range(20):
        for k in range(1, 8):
            assert p[(c + 1, k)] >= p[(c, k)] - 1e-12
            if k < 7:
                assert p[(c, k + 1)] >= p[(c, k)] - 1e-12


def test_leaderboard_gate_is_per_config(spark):
    # config A: every task has 5 samples -> k=5 kept; config B: one task has 4 -> k=5 dropped
    rows = [("A", f"t{t}", str(i), "success" if i < 2 else "test_failed") for t in range(3) for i in range(5)]
    rows += [("B", "t0", str(i), "success") for i in range(4)]
    rows += [("B", "t1", str(i), None) for i in range(6)]
    v = spark.createDataFrame(rows, "model string, task_id string, completion_id string, verdict string")
    b = {(r.model, r.k): r for r in leaderboard(v, ["model"]).collect()}
    assert set(b) == {("A", 1), ("A", 5), ("B", 1)}
    assert abs(b[("A", 1)].pass_at_k - 0.4) < 1e-12
    assert b[("B", 1)].min_n == 4
    # NULL verdicts count as samples but not as successes
    assert abs(b[("B", 1)].pass_at_k - 0.5) < 1e-12


def test_fixed_n_and_labels(spark):
    v = spark.createDataFrame([("t", str(i), "success") for i in range(3)], "task_id string, completion_id string, verdict string")
    s = task_scores(v, n_samples=10).filter("k = 1").first()
    assert s.n == 10 and s.c == 3 and abs(s.pass_at_k - 0.3) < 1e-12
    lab = spark.range(1).select(score_label(F.lit(1), F.lit(0.91666)).alias("l")).first().l
    assert lab == "pass @ 1 :\t0.917"


def test_block_header(spark):
    from transeval.operators.leaderboard import with_score_label
    b = spark.createDataFrame([("codenet", "Java", "Python", 1, 0.5)],
                              "dataset string, source_lang string, target_lang string, k int, pass_at_k double")
    r = with_score_label(b).first()
    assert (r.header, r.label) == ("codenet (Java -> Python)", "pass @ 1 :\t0.500")
