"""Positions in groups: sampled splitters against a plain window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from transeval.operators import ordered
from transeval.operators.ordered import position_in_group


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ordered, "SAMPLED", 4)
    monkeypatch.setattr(ordered, "LARGE_SAMPLE", 16)
    monkeypatch.setattr(ordered, "SLICE_SAMPLE", 8)


def same_as_a_window(df, keys, order):
    w = Window.partitionBy(*keys).orderBy(*order)
    want = df.withColumn("p", F.row_number().over(w).cast("long") - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    got = position_in_group(df, keys, order, pos_col="p", size_col="m").select(*want.columns)
    assert got.count() == df.count()
    return got.exceptAll(want).count() == 0


@pytest.mark.parametrize("order", [["n"], ["t"], ["same", "t"]])
def test_equal_to_a_window(spark, small, order):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        F.when(F.col("l_orderkey") % 9 > 0, F.col("l_orderkey") % 5).alias("k"), F.monotonically_increasing_id().alias("n"))
    df = li.select("k", "n", F.when(F.col("n") % 100 > 0, F.concat(F.lit("a common beginning "), F.col("n").cast("string"))).alias("t"), F.lit("x").alias("same"))
    df = df.filter("t is not null or n = 0")
    assert same_as_a_window(df, ["k"], order)
    assert ordered.splitters(df, ["k"], order).count() == 6


def test_small_groups_have_no_splitters(spark):
    df = spark.range(3000).select((F.col("id") % 10).alias("k"), "id")
    assert ordered.splitters(df, ["k"], ["id"]).count() == 0
    assert same_as_a_window(df, ["k"], ["id"])


def test_a_million_ids_with_one_beginning_spread_over_the_tasks(spark):
    ids = F.concat(F.lit("translations/codenet/model/"), F.lpad(F.col("id").cast("string"), 9, "0"))
    df = spark.range(0, 1_000_000, 1, 8).select(F.when(F.col("id") < 990_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), ids.alias("t"), "id")
    sizes = [r.n for r in ordered.with_slice(df, ["k"], ["t"]).filter("k = 'hot'").groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 990_000 and len(sizes) > 50 and max(sizes) < 4 * 990_000 / len(sizes)
    placed = position_in_group(df, ["k"], ["t"], pos_col="p")
    # ids of the hot key are its first, in order; those of the others are every 500th
    want = F.when(F.col("k") == "hot", F.col("id")).otherwise(F.floor((F.col("id") - 990_000) / 500))
    assert placed.count() == 1_000_000 and placed.filter(F.col("p") != want).count() == 0


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "k string, t string")
    assert position_in_group(none, ["k"], ["t"]).collect() == []
