"""Hard negatives against brute force: packed products, ties, odd rows, blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transeval.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, lowest=80, highest=100, k=5):
    known = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    anchors = {(i, lab, tuple(v)) for i, lab, v in known if i % 100 == 0}
    for i, label, a in anchors:
        def score(v, a=a):
            return sum(x * y for x, y in zip(v, a, strict=False))
        pos = sorted([(-score(v), j) for j, lab, v in known if lab == label and j != i])[:k]
        neg = sorted([(-score(v), j) for j, lab, v in known if lab != label])
        for p, j in pos:
            hard = [(s, n) for s, n in neg if lowest * -p <= 100 * -s <= highest * -p][:k]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(hard, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("low", "high", "rows", "dims"), [(-160, 160, 101, 64), (-1, 1, 40, 3), (0, 5, 9, 7), (-(1 << 40), 1 << 40, 33, 5), (-7, -7, 5, 1), (0, 0, 3, 4)])
def test_packed_scores_are_exact(low, high, rows, dims):
    rng = np.random.default_rng(rows)
    c, a = rng.integers(low, high + 1, (rows, dims)), rng.integers(low, high + 1, (7, dims))
    packed = hn.Packed(c, int(a.min()), int(a.max()))
    want = np.clip(a.astype(object) @ c.T.astype(object), hn.LONG.min, hn.LONG.max)
    assert (packed.scores(a).astype(object) == want).all()
    assert packed.in_words == (high < 1 << 40)
    assert packed.fields > 1


def odd(rng, n=400):
    rows = [(i, rng.randrange(3), [rng.choice([-0.5, -0.1, 0.0, 0.1, 0.25, 0.5]) for _ in range(6)]) for i in range(n)]
    # one vector and label that a third of the rows have, short, long, empty and odd vectors
    rows += [(1000 + i, 1, [0.5] * 6) for i in range(n // 2)]
    rows += [(2000, 0, [0.25, 0.5]), (2001, 1, []), (2002, 2, [0.5] * 9), (2003, None, [0.5] * 6), (2004, 1, None), (None, 1, [0.5] * 6),
             (2100, 1, [0.5, None, 0.1]), (2200, 1, [float("nan")] * 6), (2201, 1, [float("inf")] * 6), (2300, 9, [0.5] * 6), (2202, 2, [1e9, -1e9])]
    # an id that several rows have, an anchor that is repeated
    rows += [(300, 2, [0.1] * 6), (7, 0, [0.5] * 6), rows[100]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [{}, {"candidate_block": 50, "anchor_block": 3}])
def test_against_brute_force(spark, blocks):
    rows = odd(random.Random(5))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("anchor", F.lit("x")).repartition(3)
    want = brute(rows)
    assert len(want) > 50
    assert found(hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **blocks)) == want


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(hn.hard_negatives(none, F.col("vec_id") % 100 == 0)) == []
    alone = spark.createDataFrame([(100, 1, [0.5])], SCHEMA)
    assert found(hn.hard_negatives(alone, F.col("vec_id") % 100 == 0)) == []


def test_components_beyond_a_word(spark):
    rows = [(0, 0, [1e12, -3e11]), (1, 0, [1e12, 1.0]), (2, 1, [9e11, 2.0]), (3, 1, [-1e12, 1e12])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = found(hn.hard_negatives(df, F.col("vec_id") % 100 == 0))
    # both scores are beyond a long, and so the nearest one
    assert got == [(0, 1, 1, 2, int(hn.LONG.max), int(hn.LONG.max))]
