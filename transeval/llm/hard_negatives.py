"""Hard negatives by Kronecker-packed products.

Components are whole numbers, floor(256 x). A field of ``width`` bits holds any sum of products
of biased components, so several candidates' components, biased to be no less than zero, stand
side by side in one wide integer, and one multiplication by an anchor's biased component
multiplies all of them. Summed over the components, each field is the candidate's score plus
terms that depend on one of the two rows alone; these are subtracted when the fields are
unpacked. Scores are exact: the width follows from the largest components of the rows at hand.
Fields of 64-bit words are used while one fits, and Python's integers of any width beyond.

Anchors are a stated part of the rows and meet all rows in blocks: a grid of anchor blocks and
candidate blocks, one task's work each. Rows are dealt to blocks by a hash of their id, so
neither a label nor a vector that very many rows share makes a block larger.

1. Each cell of the grid gives for each anchor its first positives, the rows of its own label;
   the first of all cells' are its positives.
2. Each cell, now given the scores of the anchor's positives, gives for each of them the first
   rows of other labels whose scores lie in its range; the first of all cells' are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

SCALE = 256
#: Scores in percent of the positive's between which a negative is hard.
LOWEST, HIGHEST = 80, 100
POSITIVES, NEGATIVES = 5, 5
#: Rows of a block of candidates and of anchors: some tens of MB each in a task. A row moves once
#: for each block of the other side, so blocks of anchors, which are few, are as large.
CANDIDATE_BLOCK, ANCHOR_BLOCK, LEAST_BLOCK = 1 << 16, 1 << 16, 1 << 10
WORD_BITS = 63
#: Cells beyond this number share tasks.
MOST_TASKS = 20_000
LONG = np.iinfo(np.int64)

ROWS = "vec_id long, label long, components binary"


def quantised(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label, components (of the rows that take part) as little-endian whole numbers
    of the smallest size that holds them, after one byte that tells this size."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    rows = (vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("whole")))
    return rows.mapInArrow(_packed_rows, ROWS)


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(row: np.ndarray) -> bytes:
        for size in (1, 2, 4, 8):
            kind = np.dtype(f"<i{size}")
            if not len(row) or (row.min() >= np.iinfo(kind).min and row.max() <= np.iinfo(kind).max):
                return bytes([size]) + row.astype(kind).tobytes()
        raise AssertionError

    for b in batches:
        rows = [packed(np.array(x.as_py(), np.int64)) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["vec_id", "label", "components"])


def matrix(components: pa.ChunkedArray, dims: int) -> np.ndarray:
    """One row of ``dims`` whole numbers each; shorter vectors end in zeros."""
    raw = components.to_pylist()
    out = np.zeros((len(raw), dims), np.int64)
    for size in (1, 2, 4, 8):
        rows = [i for i, x in enumerate(raw) if x[0] == size]
        for n in {len(raw[i]) for i in rows}:
            same = [i for i in rows if len(raw[i]) == n]
            flat = np.frombuffer(b"".join(raw[i][1:] for i in same), f"<i{size}")
            out[same, :(n - 1) // size] = flat.reshape(len(same), -1)
    return out


def dimensions(*columns: pa.ChunkedArray) -> int:
    return max(((len(x) - 1) // x[0] for c in columns for x in c.to_pylist()), default=0)


class Packed:
    """Candidates' components in fields of wide integers, to be multiplied by anchors whose
    components lie in [``low``, ``high``]."""

    def __init__(self, candidates: np.ndarray, low: int, high: int):
        self.n, self.dims = candidates.shape
        self.bias_c, self.bias_a = (int(-min(0, candidates.min(initial=0))), -min(0, low))
        largest = self.dims * (int(candidates.max(initial=0)) + self.bias_c) * (max(0, high) + self.bias_a)
        self.width = max(1, largest.bit_length())
        self.in_words = self.width <= WORD_BITS
        self.fields = WORD_BITS // self.width if self.in_words else 32
        self.of_rows = self._sums(candidates)
        groups = -(-self.n // self.fields)
        biased = np.zeros((groups * self.fields, self.dims), np.uint64 if self.in_words else object)
        biased[:self.n] = candidates.astype(biased.dtype if not self.in_words else np.int64) + self.bias_c
        parts = biased.reshape(groups, self.fields, self.dims)
        kind = np.uint64 if self.in_words else int
        # words[d]: component d of all candidates, ``fields`` of them in each integer
        self.words = sum((parts[:, f] << kind(f * self.width) for f in range(self.fields)), np.zeros((groups, self.dims), biased.dtype)).T.copy()

    def _sums(self, rows: np.ndarray) -> np.ndarray:
        return rows.sum(1) if self.in_words else rows.astype(object).sum(1)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The inner products of some anchors with all candidates; those beyond a long are
        the nearest long."""
        kind = np.uint64 if self.in_words else object
        biased = (anchors.astype(np.int64 if self.in_words else object) + self.bias_a).astype(kind)
        total = np.zeros((len(anchors), self.words.shape[1]), kind)
        term = np.empty_like(total)
        for d in range(self.dims):
            np.multiply(biased[:, d, None], self.words[d], out=term)
            total += term
        mask = (1 << self.width) - 1
        fields = [(total >> (np.uint64(f * self.width) if self.in_words else f * self.width)) & (np.uint64(mask) if self.in_words else mask)
                  for f in range(self.fields)]
        out = np.stack(fields, 2).reshape(len(anchors), -1)[:, :self.n]
        own = self._sums(anchors) * self.bias_c + self.dims * self.bias_a * self.bias_c
        if self.in_words:
            return out.astype(np.int64) - own[:, None] - self.bias_a * self.of_rows
        exact = out - own[:, None] - self.bias_a * self.of_rows
        return np.clip(exact, int(LONG.min), int(LONG.max)).astype(np.int64)


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores in order; of equal ones the smaller place is first."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        more = np.flatnonzero(scores > least)
        at = np.concatenate([more, np.flatnonzero(scores == least)[:k - len(more)]])
    return np.array(sorted(at.tolist(), key=lambda i: (-int(scores[i]), i)), np.int64)


class _Cell:
    """A block of anchors and a block of candidates, in the order of their ids."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        rows = rows.sort_by("vec_id")
        dims = dimensions(anchors.column("components"), rows.column("components"))
        self.anchor_parts, self.parts = matrix(anchors.column("components"), dims), matrix(rows.column("components"), dims)
        self.anchor_ids, self.anchor_labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()

    def blocks(self, anchors: np.ndarray, rows: np.ndarray, size: int = 1 << 16) -> Iterator[tuple[int, np.ndarray]]:
        """(anchor, its scores with these rows) of these anchors, so many at a time that what
        they add up stays in a processor's cache."""
        if not len(anchors) or not len(rows):
            return
        some = self.anchor_parts[anchors]
        packed = Packed(self.parts[rows], int(some.min(initial=0)), int(some.max(initial=0)))
        step = max(1, size // len(rows))
        for a in range(0, len(anchors), step):
            for i, s in zip(anchors[a:a + step].tolist(), packed.scores(some[a:a + step]), strict=True):
                yield i, s


KEY = ["anchor_id", "anchor"]
FOUND = [("anchor_id", pa.int64()), ("anchor", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
HARD = [("anchor_id", pa.int64()), ("anchor", pa.int64()), ("positive", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())]


def _table(columns: list[tuple[str, pa.DataType]], parts: list[tuple]) -> pa.Table:
    cols = [np.concatenate([p[i] for p in parts]) if parts else [] for i in range(len(columns))]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, columns, strict=True)], names=[n for n, _ in columns])


def _positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    out = []
    if anchors.num_rows and rows.num_rows:
        cell, keys = _Cell(anchors, rows), anchors.column("anchor").to_numpy()
        for label in np.unique(cell.anchor_labels):
            same = np.flatnonzero(cell.labels == label)
            for i, s in cell.blocks(np.flatnonzero(cell.anchor_labels == label), same):
                other = np.flatnonzero(cell.ids[same] != cell.anchor_ids[i])
                at = other[first(s[other], k)]
                out.append((np.full(len(at), cell.anchor_ids[i]), np.full(len(at), keys[i]), cell.ids[same[at]], s[at]))
    return _table(FOUND, out)


def _negatives(anchors: pa.Table, rows: pa.Table, k: int, lowest: int, highest: int) -> pa.Table:
    out = []
    if anchors.num_rows and rows.num_rows:
        cell, keys = _Cell(anchors, rows), anchors.column("anchor").to_numpy()
        wanted = anchors.column("scores").to_pylist()
        for i, s in cell.blocks(np.arange(anchors.num_rows), np.arange(len(cell.ids))):
            # whole percentages: lowest * p <= 100 * s <= highest * p
            low, high = [-(-lowest * p // 100) for p in wanted[i]], [highest * p // 100 for p in wanted[i]]
            within = np.flatnonzero((s >= max(min(low), int(LONG.min))) & (s <= min(max(high), int(LONG.max))) & (cell.labels != cell.anchor_labels[i]))
            left = s[within]
            for no, (lo, hi) in enumerate(zip(low, high, strict=True), 1):
                hard = np.flatnonzero((left >= max(lo, int(LONG.min))) & (left <= min(hi, int(LONG.max))))
                at = within[hard[first(left[hard], k)]]
                if len(at):
                    out.append((np.full(len(at), cell.anchor_ids[i]), np.full(len(at), keys[i]), np.full(len(at), no, np.int32), cell.ids[at], s[at]))
    return _table(HARD, out)


def _ranked(found: DataFrame, keys: list[str], score: str, tie: str, k: int, name: str) -> DataFrame:
    """The first k rows of each key; a task sends at most k of a key on."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def _grid(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int):
    """Both sides dealt to the cells of the grid. The work of a cell does not show in its bytes,
    so the number of tasks is set here rather than by them."""
    tasks = min(anchor_blocks * row_blocks, MOST_TASKS)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")

    cell = F.col("mine") * F.lit(row_blocks) + F.col("other")
    left = (anchors.select("*", F.pmod(F.xxhash64("anchor"), F.lit(anchor_blocks)).alias("mine"), every(row_blocks))
            .withColumn("cell", cell).drop("mine", "other"))
    back = F.col("other") * F.lit(row_blocks) + F.col("mine")
    right = (rows.select("*", F.pmod(F.xxhash64("vec_id", "components"), F.lit(row_blocks)).alias("mine"), every(anchor_blocks))
             .withColumn("cell", back).drop("mine", "other"))
    return left.repartition(tasks, "cell").groupBy("cell").cogroup(right.repartition(tasks, "cell").groupBy("cell"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", *,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, scale: int = SCALE,
                   candidate_block: int = CANDIDATE_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    anchor and each of its first ``positives`` rows of the same label, the first ``negatives``
    rows of other labels with ``lowest * positive_score <= 100 * negative_score <=
    highest * positive_score``. Higher scores are first, ties by the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component take no part. A
    shorter vector counts as ending in zeros. Rows of one id are never each other's positives;
    each of them is a candidate of its own, and anchors that repeat id, label and components
    are one anchor. Components and scores beyond a long are the nearest long. Other columns of
    ``vectors`` are read by ``is_anchor`` alone.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, label_col, vector_col, scale)
    chosen = quantised(vectors.filter(is_anchor), id_col, label_col, vector_col, scale)
    same = ["vec_id", "label", "components"]
    anchors = chosen.dropDuplicates(same).withColumn("anchor", F.xxhash64(*same))
    n_rows, n_anchors = rows.count(), anchors.count()
    row_blocks = max(1, -(-n_rows // candidate_block), min(shuffle_partitions(spark), n_rows // LEAST_BLOCK))
    anchor_blocks = max(1, -(-n_anchors // anchor_block))
    found = _grid(anchors, rows, anchor_blocks, row_blocks).applyInArrow(
        lambda a, c: _positives(a, c, positives), "anchor_id long, anchor long, vec_id long, score long")
    best = _ranked(found, KEY, "score", "vec_id", positives, "positive")
    wanted = best.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("positive", "vec_id", "score"))).alias("found"))
    asked = (anchors.withColumnRenamed("vec_id", "anchor_id").join(wanted, KEY)
             .select("anchor", F.col("anchor_id").alias("vec_id"), "label", "components", F.transform("found", lambda p: p.score).alias("scores")))
    hard = _grid(asked, rows, anchor_blocks, row_blocks).applyInArrow(
        lambda a, c: _negatives(a, c, negatives, lowest, highest), "anchor_id long, anchor long, positive int, negative_id long, negative_score long")
    kept = _ranked(hard, [*KEY, "positive"], "negative_score", "negative_id", negatives, "rank")
    named = wanted.select(*KEY, F.explode("found").alias("p")).select(
        *KEY, F.col("p.positive").alias("positive"), F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return kept.join(named, [*KEY, "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
