"""Position of each row inside its group, without putting a whole group in one task.

A plain ``row_number().over(Window.partitionBy(key).orderBy(...))`` sends every row of a key
to one task. Here each large group is cut into slices of about equal size at splitters, which
are quantiles of a sample of the group's own order values, so a common prefix or a crowded
range makes no slice larger. Rows are counted per slice (partial counts first), the slices of
a key are summed up in order (one row per slice), and each row's position is its rank inside
its slice plus the rows of the slices before.

* The sample of a key is the rows with the smallest hashes among one row in ``SAMPLED``: the
  same rows whenever it is taken, at most ``SAMPLE_ROWS`` of a key from each task and in all.
* A key with fewer than ``LARGE_SAMPLE`` sampled rows (about ``SAMPLED`` times as many in all)
  is one slice. A larger one gets splitters, ``MOST_SLICES`` slices at most.
* Rows find their splitters by a join that is dealt over ``SPREAD`` tasks a key.

One algorithm for every size, and no job runs while the query is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLED = 64
SAMPLE_ROWS, LARGE_SAMPLE = 8192, 512
#: Sampled rows of one slice, at least.
SLICE_SAMPLE = 128
MOST_SLICES = 256
SPREAD = 64


def splitters(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``_k0``, ``_k1``, …, ``_splitters``: the sorted order values at which a large key is cut."""
    named = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*order).alias("_v"), F.xxhash64(*keys, *order).alias("_h"))
    by_key = [f"_k{i}" for i in range(len(keys))]
    few = (named.filter(F.pmod("_h", F.lit(SAMPLED)) == 0)
           .withColumn("_n", F.row_number().over(Window.partitionBy(*by_key).orderBy("_h"))).filter(F.col("_n") <= SAMPLE_ROWS))
    taken = few.groupBy(*by_key).agg(F.array_sort(F.collect_list("_v")).alias("_s")).filter(F.size("_s") >= LARGE_SAMPLE)
    slices = F.least(F.floor(F.size("_s") / SLICE_SAMPLE), F.lit(MOST_SLICES)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), slices - 1), lambda i: F.element_at("_s", (i * F.size("_s") / slices).cast("int") + 1))
    return taken.select(*by_key, F.array_distinct(cuts).alias("_splitters"))


def with_slice(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``_slice``: how many of its key's splitters are not above the row."""
    cuts = splitters(df, keys, order).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    salted = df.withColumn("_mine", F.pmod(F.xxhash64(*order), F.lit(SPREAD)).cast("int"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_mine") == F.col("_salt")]
    not_above = F.size(F.filter("_splitters", lambda s: s <= F.struct(*order)))
    return (salted.join(cuts, same, "left").withColumn("_slice", F.when(F.col("_splitters").isNull(), 0).otherwise(not_above))
            .drop("_mine", "_salt", "_splitters", *[f"_k{i}" for i in range(len(keys))]))


def position_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, pos_col: str = "pos",
                      size_col: str | None = None) -> DataFrame:
    """Add ``pos_col`` (0-based position in ``order`` within ``keys``; ``order`` is complete
    per group) and optionally the group size ``size_col``."""
    keys, order = list(keys), list(order)
    cut = with_slice(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_ks"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                            F.sum("_n").over(Window.partitionBy(*keys)).alias("_size"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_slice") == F.col("_ks")]
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, same, "inner")
    out = ranked.withColumn(pos_col, (F.col("_rank") + F.col("_before")).cast("long"))
    if size_col:
        out = out.withColumn(size_col, F.col("_size").cast("long"))
    return out.drop("_slice", "_ks", "_rank", "_before", "_size", *[f"_k{i}" for i in range(len(keys))])


def first_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, *, pos_col: str = "pos") -> DataFrame:
    """The first ``k`` rows of each group with their position: each task keeps at most ``k``
    rows of a group before the shuffle, so a large group costs no more than others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(pos_col, F.row_number().over(w)).filter(F.col(pos_col) <= k)
            .withColumn(pos_col, (F.col(pos_col) - 1).cast("long")))
