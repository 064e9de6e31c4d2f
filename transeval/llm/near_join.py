"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Texts become sets of hashed five-word shingles; equal sets are one class of copies from
   here on. Each distinct set gets MinHash values.
2. Sets that share a run of ``ROWS`` MinHash values are linked to the smallest set with that
   run; the components of these links hold every pair that any band suggests.
3. Inside a component all pairs are compared by their MinHash values, ``STEP`` at a time. A
   pair is dropped once the posterior probability that its similarity reaches the threshold,
   given the matches so far, is below ``TOLERANCE``. What is left joins into finer components.
4. Inside these the pairs that were not dropped are verified exactly on their shingle sets.
   The verified links give each set's number of links and, by their components, the classes.

Components of more than ``BLOCK`` sets are dealt as pairs of blocks, so each pair of sets
meets once, in one task, and no task holds more than two blocks. Pairs never become rows:
tasks return for each set the smallest set it is linked with and its number of links.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, small_batches, written
from .components import components
from .shards import MULTIPLIERS, firsts, mixed, rolled

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
VALUES = BANDS * ROWS
STEP, TOLERANCE = 20, 1e-6
BLOCK = 1024
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

PRINTS = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))]


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of five consecutive words, lower-cased in A-Z; a shorter text
    that has words is one shingle."""
    words = WORDS.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(rolled(h, min(SHINGLE, len(h)), MULTIPLIERS[0]))


def node_of(s: np.ndarray) -> int:
    """The set's number: a hash of all its shingles."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(99)
    a = rng.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, VALUES, np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (16 bits each) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), VALUES), np.uint16)
    for j, (a, b) in enumerate(zip(*_permutations(), strict=True)):
        out[:, j] = mixed(np.minimum.reduceat(flat * a + b, starts)) >> np.uint64(48)
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A hash of each band's values and its number."""
    x = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]) * MULTIPLIERS[1]
    for j in range(ROWS):
        h = mixed(h + x[:, :, j]) * MULTIPLIERS[0]
    return mixed(h).view(np.int64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py().encode()) for t in b.column(1)]
        full = [s for s in sets if len(s)]
        sk = sketches(full) if full else np.empty((0, VALUES), np.uint16)
        keys, raw = band_keys(sk), iter(range(len(full)))
        rows = [next(raw) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([
            b.column(0), b.column(2), pa.array([None if i is None else node_of(s) for i, s in zip(rows, sets, strict=True)], pa.int64()),
            pa.array(list(map(len, sets)), pa.int32()),
            pa.array([None if i is None else sk[i].tobytes() for i in rows], pa.binary()),
            pa.array([None if i is None else keys[i] for i in rows], pa.list_(pa.int64()))], names=[n for n, _ in PRINTS])


@functools.cache
def fewest_matches() -> dict[int, int]:
    """For each number of values compared, the fewest matches with which a pair stays. With a
    uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), and its
    upper tail at t is the chance of at most m successes in n + 1 trials of chance t."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < TOLERANCE:
            m += 1
            tail += math.comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        out[n] = m
    return out


def surviving_pairs(a: np.ndarray, b: np.ndarray | None, size_a: np.ndarray, size_b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b; or two rows of a) not dropped by the incremental posterior,
    nor by sizes too different for the threshold."""
    one = b is None
    b, size_b = (a, size_a) if one else (b, size_b)
    least = fewest_matches()
    keep_i, keep_j = [], []
    rows = max(1, (1 << 20) // max(1, len(b)))
    for lo in range(0, len(a), rows):
        x = a[lo:lo + rows]
        m = np.zeros((len(x), len(b)), np.uint8)
        for j in range(STEP):
            m += x[:, j, None] == b[None, :, j]
        ok = (m >= least[STEP]) & (np.minimum(size_a[lo:lo + rows, None], size_b[None]) >= THRESHOLD * np.maximum(size_a[lo:lo + rows, None], size_b[None]))
        i, j = np.nonzero(ok)
        if one:
            up = i + lo < j
            i, j = i[up], j[up]
        count = m[i, j].astype(np.int64)
        i = i + lo
        for n in range(2 * STEP, VALUES + 1, STEP):
            if not len(i):
                break
            parts = [(a[i[s:s + 65536], n - STEP:n] == b[j[s:s + 65536], n - STEP:n]).sum(1) for s in range(0, len(i), 65536)]
            count = count + np.concatenate(parts)
            ok = count >= least[n]
            i, j, count = i[ok], j[ok], count[ok]
        keep_i.append(i)
        keep_j.append(j)
    return np.concatenate(keep_i), np.concatenate(keep_j)


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, width: int = 4096) -> np.ndarray:
    """Which of these pairs of sets reach the threshold, exactly: common shingles are counted
    for all sets at once, by products of incidence matrices over stretches of shingles."""
    if not len(i):
        return np.empty(0, bool)
    used = np.unique(np.concatenate([i, j]))
    row = np.full(len(sets), -1)
    row[used] = np.arange(len(used))
    sizes = np.array([len(sets[k]) for k in used])
    common = np.zeros(len(i), np.int64)
    if len(i) <= 4 * len(used):
        for k, (x, y) in enumerate(zip(i, j, strict=True)):
            x, y = sets[x], sets[y]
            at = np.searchsorted(x, y)
            common[k] = np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)
    else:
        flat = np.concatenate([sets[k] for k in used])
        owner = np.repeat(np.arange(len(used)), sizes)
        _, number, often = np.unique(flat, return_inverse=True, return_counts=True)
        shared = often[number] > 1  # a shingle of one set alone is common to no pair
        rank = np.cumsum(often > 1) - 1
        number, owner = rank[number[shared]], owner[shared]
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        total = np.zeros((len(used), len(used)), np.float32)
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            a, z = np.searchsorted(number, [lo, lo + width])
            x = np.zeros((len(used), width), np.float32)
            x[owner[a:z], number[a:z] - lo] = 1
            total += x @ x.T
        common = total[row[i], row[j]].astype(np.int64)
    union = sizes[row[i]] + sizes[row[j]] - common
    # in whole numbers: common / union >= 0.8
    return common * 10 >= union * round(THRESHOLD * 10)


def smallest_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each of n members' components."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def dealt(members: DataFrame, root: str, bins: int, block: int) -> DataFrame:
    """``members`` with the task each row goes to and its side there. Components of at most
    ``block`` rows share ``bins`` tasks; of a larger one each pair of blocks is a task, to
    which its rows go as side 0 or 1; a block with itself is side 2."""
    sizes = members.groupBy(root).agg(F.count(F.lit(1)).alias("_size")).withColumnRenamed(root, "_root")
    sized = members.join(sizes, F.col(root) == F.col("_root")).drop("_root")
    blocks = F.ceil(F.col("_size") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # pairs (x, y) with x <= y that hold this block
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("_mine")).alias("x"), F.greatest(o, F.col("_mine")).alias("y")))
    split = sized.withColumn("_blocks", blocks).withColumn("_mine", mine).withColumn("_pair", F.explode(pairs))
    task = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64(root), F.lit(bins))).otherwise(
        F.xxhash64(root, F.col("_pair.x"), F.col("_pair.y")))
    side = F.when(F.col("_pair.x") == F.col("_pair.y"), 2).when(F.col("_mine") == F.col("_pair.x"), 0).otherwise(1)
    return (split.withColumn("task", F.struct(F.col("_blocks") > 1, task)).withColumn("task", F.xxhash64("task"))
            .withColumn("side", side).drop("_size", "_blocks", "_mine", "_pair"))


def _groups(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of sides 0, 1 and 2 of each component in a task."""
    root, side = rows.column("root").to_numpy(), rows.column("side").to_numpy()
    node = rows.column("node").to_numpy()
    order = np.lexsort((node, side, root))
    starts = np.flatnonzero(firsts(root[order]))
    for a, z in zip(starts, [*starts[1:], len(order)], strict=True):
        g = order[a:z]
        yield g[side[g] == 0], g[side[g] == 1], g[side[g] == 2]


def _sketch_of(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(rows.num_rows, VALUES)


def _survivors(rows: pa.Table, sketch: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs of row numbers, component by component. Two blocks that are one
    component's sides are only compared across: within, each meets itself elsewhere."""
    for x, y, own in _groups(rows):
        if len(x) and len(y):
            i, j = surviving_pairs(sketch[x], sketch[y], size[x], size[y])
            yield x[i], y[j]
        if len(own) > 1:
            i, j = surviving_pairs(sketch[own], None, size[own], None)
            yield own[i], own[j]


def _prune(rows: pa.Table) -> pa.Table:
    node, size = rows.column("node").to_numpy(), rows.column("n").to_numpy()
    sketch = _sketch_of(rows)
    u, v = [], []
    for i, j in _survivors(rows, sketch, size):
        if len(i):
            members, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            root = smallest_linked(len(members), back[:len(i)], back[len(i):])
            u.append(node[members])
            v.append(node[members][root])
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return pa.table([pa.array(cat(u), pa.int64()), pa.array(cat(v), pa.int64())], names=["u", "v"])


def _verify(rows: pa.Table) -> pa.Table:
    node, size, copies = rows.column("node").to_numpy(), rows.column("n").to_numpy(), rows.column("copies").to_numpy()
    sketch = _sketch_of(rows)
    texts = rows.column("text")
    u, v, links = [], [], []
    for i, j in _survivors(rows, sketch, size):
        if not len(i):
            continue
        members, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = back[:len(i)], back[len(i):]
        ok = verified([shingles(texts[int(k)].as_py().encode()) for k in members], a, b)
        a, b = a[ok], b[ok]
        if len(a):
            many = np.bincount(a, copies[members][b], len(members)) + np.bincount(b, copies[members][a], len(members))
            root = smallest_linked(len(members), a, b)
            held = np.flatnonzero(many)
            u.append(node[members][held])
            v.append(node[members][root][held])
            links.append(many[held].astype(np.int64))
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return pa.table([pa.array(cat(u), pa.int64()), pa.array(cat(v), pa.int64()), pa.array(cat(links), pa.int64())], names=["u", "v", "links"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, class_no, class_id, n_copies, n_links of each row of ``docs``.
    ``class_no`` tells classes apart whose ids are null, and is null for a text without
    shingles; the rest is as ``near_duplicates`` has it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = written(hashed.mapInArrow(_prints, "doc_id long, text_hash long, node long, n int, sketch binary, bands array<long>"), "prints")
    # copies are counted by each task before they are shuffled; equal sets have equal
    # sketches, so any of them will do
    sets = (prints.filter(F.col("node").isNotNull()).groupBy("node", "n")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_"), "doc_id", "text_hash")).alias("first"),
                 F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch")))
    known = written(sets.select("node", "n", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "copies", "sketch"), "sets")
    keys = prints.filter(F.col("node").isNotNull()).select("node", F.explode("bands").alias("key")).distinct()
    hubs = (keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m"))
            .filter("m > 1").select(F.col("key").alias("key_"), "hub"))
    suggested = components(keys.join(hubs, F.col("key") == F.col("key_")).select(F.col("node").alias("u"), F.col("hub").alias("v")))

    def members(found: DataFrame, *columns: str) -> DataFrame:
        named = found.select(F.col("node").alias("node_"), "root")
        return known.join(named, F.col("node") == F.col("node_")).select("node", "n", "root", "sketch", *columns)

    bins = buckets_for(spark, 2, 32)
    left = (dealt(members(suggested), "root", bins, block).select("task", "side", "root", "node", "n", "sketch")
            .groupBy("task").applyInArrow(_prune, "u long, v long"))
    finer = components(left)
    chosen = members(finer, "copies", "first_id", "first_hash")
    texts = hashed.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "text")
    # the set's first row, by id and text, so that ids that many rows share, null among them,
    # fetch one text; of repeated rows one stays, as a set must meet each other set once
    with_text = (chosen.join(texts, F.col("first_id").eqNullSafe(F.col("id_")) & (F.col("first_hash") == F.col("hash_")))
                 .drop("id_", "hash_", "first_id", "first_hash"))
    single = _of_set(with_text).dropDuplicates(["node"])
    links = written(dealt(single, "root", bins, block).select("task", "side", "root", "node", "n", "copies", "sketch", "text")
                    .groupBy("task").applyInArrow(_verify, "u long, v long, links long"), "verified")
    classes = components(links.select("u", "v"))
    degree = links.groupBy("u").agg(F.sum("links").alias("links"))
    # the class of a set: the smallest id of any row in its component
    joined = (known.select("node", "first_id", "copies")
              .join(classes.select(F.col("node").alias("c_"), "root"), F.col("node") == F.col("c_"), "left")
              .join(degree, F.col("node") == F.col("u"), "left")
              .select("node", "first_id", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    least = joined.groupBy("root").agg(F.min("first_id").alias("class_id")).withColumnRenamed("root", "r_")
    result = (joined.join(least, F.col("root") == F.col("r_"))
              .select(F.col("node").alias("n_"), F.col("root").alias("class_no"), "class_id", F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.col("links")).alias("n_links")))
    alone: Column = F.col("n_").isNull()
    return (prints.select("doc_id", "text_hash", "node").join(result, F.col("node") == F.col("n_"), "left")
            .select("doc_id", "text_hash", "class_no", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_copies, n_links of each row of ``docs``.

    Documents are linked if the Jaccard similarity of their shingle sets is at least 0.8.
    ``class_id`` is the smallest id that links lead to, ``n_copies`` the rows with the same
    set (this one too), ``n_links`` the other rows it is linked with, copies among them. A
    null id is never the smallest, so a class of null ids alone has a null ``class_id``. A
    null or empty text and one without words has no shingles: it is linked with nothing and
    its own class. Rows that repeat are copies of each other. Other columns of ``docs`` are
    not read.
    """
    return classes(docs, id_col, text_col, block).select("doc_id", "class_id", "n_copies", "n_links")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, single: the document that stands for each class, the one with the
    smallest id (null ids last, then by the hash of the text), and every one without shingles
    (``single`` is false: rows that repeat it are no copies of each other)."""
    found = classes(docs, id_col, text_col, block)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null_"), F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")))
    chosen = found.filter(F.col("class_no").isNotNull()).groupBy("class_no").agg(best.alias("b"))
    alone = found.filter(F.col("class_no").isNull()).select("doc_id", "text_hash").distinct()
    return (chosen.select(F.col("b.id_").alias("doc_id"), F.col("b.hash_").alias("text_hash"), F.lit(True).alias("single"))
            .unionByName(alone.withColumn("single", F.lit(False))))


def _of_set(rows: DataFrame) -> DataFrame:
    """Rows whose text is of the set named."""
    schema = rows.schema
    at_node, at_text = rows.columns.index("node"), rows.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([node_of(shingles(t.as_py().encode())) == n.as_py() for n, t in zip(b.column(at_node), b.column(at_text), strict=True)]))

    return rows.mapInArrow(keep, schema)
