"""SimHash near duplicates by bit-sliced comparison.

A text's fingerprint has 64 bits: bit b is set if more than half of the hashes of its shingles
have it. Fingerprints that differ in at most ``RADIUS`` bits are linked.

1. Equal fingerprints are one from here on, with the smallest id of their documents.
2. The 64 bits are cut into ``parts``; fingerprints within the radius agree in all but RADIUS
   of them, so they meet in one of the groups that share the bits of the other parts. The
   number of parts follows the number of fingerprints: with more parts a group shares more bits.
3. A task stores its fingerprints vertically: plane b holds bit b of 64 fingerprints in each
   word. One fingerprint is compared with 64 at a time: each plane's differences are added to
   carry-save counters, a word each for ones and twos and one that keeps what reached four; a
   word of 64 is abandoned once all of its lanes have.
4. Links become components: a task returns for each fingerprint the smallest one it is linked
   with there, and the components of these give the classes.

A group of more than ``BLOCK`` fingerprints is dealt as pairs of blocks, each pair of blocks to
one task, so that every two fingerprints meet and no task holds more than two blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, small_batches, written
from .components import components
from .near_join import dealt, smallest_linked
from .shards import firsts

SHINGLE, SEED, RADIUS, BITS = 3, 42, 3, 64
BLOCK = 4096
#: Fingerprints that share a group by chance are about so many at most.
BY_CHANCE = 64
PLANES_AT_ONCE = 4
LANES = 64
ONE = np.uint64(1)


def fingerprint(text: bytes, stretch: int = 1 << 16) -> int:
    """The fingerprint of a text as UTF-8, lower-cased in A-Z; 0 where it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(SHINGLE, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[k - 1:].tolist()
    starts = starts[:len(ends)].tolist()
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, len(ends), stretch):
        hashes = [digest(joined[a:z], SEED) for a, z in zip(starts[lo:lo + stretch], ends[lo:lo + stretch], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(ends), bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "node"])


def parts_for(prints: int) -> int:
    """The fewest parts with which about ``BY_CHANCE`` of so many random fingerprints share a
    group."""
    parts = RADIUS + 1
    while parts < 2 * RADIUS + 2 and prints >> (BITS * (parts - RADIUS) // parts) > BY_CHANCE:
        parts += 1
    return parts


def shared_masks(parts: int) -> list[int]:
    """The bits that a group shares, for each choice of all but RADIUS of the parts."""
    cuts = [BITS * i // parts for i in range(parts + 1)]
    whole = [((1 << (z - a)) - 1) << a for a, z in itertools.pairwise(cuts)]
    return [sum(chosen) for chosen in itertools.combinations(whole, parts - RADIUS)]


def planes(prints: np.ndarray) -> np.ndarray:
    """Vertical storage: plane b, word w holds bit b of fingerprints 64 w to 64 w + 63."""
    words = -(-len(prints) // LANES)
    padded = np.zeros(words * LANES, np.uint64)
    padded[:len(prints)] = prints
    out = np.empty((BITS, words), np.uint64)
    for b in range(BITS):
        lanes = ((padded >> np.uint64(b)) & ONE).astype(np.uint8)
        out[b] = np.packbits(lanes, bitorder="little").view("<u8")
    return out


def lanes_between(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The lanes of each word that stand for places from ``low`` to before ``high``."""
    def upto(n):
        n = np.clip(n, 0, LANES)
        return np.where(n == LANES, ~np.uint64(0), (ONE << np.minimum(n, LANES - 1).astype(np.uint64)) - ONE)

    return upto(high - words * LANES) & ~upto(low - words * LANES)


def within_radius(stored: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, order: np.ndarray, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, place) of each query and each stored fingerprint from place ``low`` to before
    ``high`` (of that query) that differ in at most 3 bits. Planes are taken in ``order``."""
    first_word = low // LANES
    n_words = np.where(high > low, (high - 1) // LANES - first_word + 1, 0)
    ends = np.cumsum(n_words)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, at_once):
        pair = np.arange(lo, min(lo + at_once, int(ends[-1])))
        q = np.searchsorted(ends, pair, "right")
        w = first_word[q] + pair - (ends[q] - n_words[q])
        alive = lanes_between(w, low[q], high[q])
        ones, twos = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        mine = queries[q]
        for i, b in enumerate(order):
            # all lanes where the query's bit is set, none else
            own = np.uint64(0) - ((mine >> np.uint64(b)) & ONE)
            differs = stored[b, w] ^ own
            carry = ones & differs
            ones ^= differs
            alive &= ~(twos & carry)
            twos ^= carry
            if i % PLANES_AT_ONCE == PLANES_AT_ONCE - 1:
                left = alive != 0
                if not left.all():
                    q, w, mine, alive, ones, twos = (x[left] for x in (q, w, mine, alive, ones, twos))
                if not len(q):
                    break
        for lane in range(LANES if len(q) else 0):
            hit = np.flatnonzero((alive >> np.uint64(lane)) & ONE)
            if len(hit):
                yield q[hit], w[hit] * LANES + lane


def _linked(rows: pa.Table) -> pa.Table:
    """For each fingerprint of a task that is linked there: the smallest one that its links
    lead to, group by group. Sides 0 and 1 of a group only meet each other, 2 meets itself."""
    root, side = rows.column("root").to_numpy(), rows.column("side").to_numpy()
    node, shared = rows.column("node").to_numpy(), rows.column("shared").to_numpy()
    order = np.lexsort((node, side, root))
    root, side, node, shared = root[order], side[order], node[order], shared[order]
    n = len(node)
    group = np.cumsum(firsts(root)) - 1
    starts = np.flatnonzero(firsts(root))
    end = np.r_[starts[1:], n][group]
    part = np.flatnonzero(firsts(root, side))
    part_end = np.r_[part[1:], n][np.cumsum(firsts(root, side)) - 1]
    # side 0 is compared with side 1, which follows it; side 2 with what follows in itself
    low = np.where(side == 2, np.arange(n) + 1, part_end)
    high = np.where(side == 1, 0, end)
    low = np.minimum(low, n)
    prints = node.view(np.uint64)
    stored = planes(prints)
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for mask in np.unique(shared):
        of_mask = np.flatnonzero(shared == mask)
        # bits that a group shares cannot differ: they are not looked at
        bits = np.array([b for b in range(BITS) if not (int(mask) >> b) & 1])
        for q, place in within_radius(stored, prints[of_mask], low[of_mask], high[of_mask], bits):
            found_i.append(of_mask[q])
            found_j.append(place)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    members, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    to = smallest_linked(len(members), back[:len(i)], back[len(i):])
    return pa.table([pa.array(node[members], pa.int64()), pa.array(node[members][to], pa.int64())], names=["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs``.

    ``component_id`` is the smallest id that links lead to. Words are separated by ASCII white
    space; a null or empty text, or one without words, has fingerprint zero, which is linked
    like any other. Rows that repeat an id or a text each give a row. A null id is never the
    smallest, so a component of null ids alone has a null ``component_id``. Other columns of
    ``docs`` are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    prints = written(rows.mapInArrow(_prints, "doc_id long, node long"), "simhash")
    # copies are combined by each task before the shuffle
    known = written(prints.groupBy("node").agg(F.min("doc_id").alias("least")), "fingerprints")
    masks = shared_masks(parts or parts_for(known.count()))
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    table = F.array(*[F.lit(m) for m in signed])
    members = (known.select("node", F.explode(table).alias("shared"))
               .withColumn("root", F.xxhash64("shared", F.col("node").bitwiseAND(F.col("shared")))))
    often = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("root").alias("_r"))
    meeting = members.join(often, F.col("root") == F.col("_r"), "left_semi")
    linked = (dealt(meeting, "root", buckets_for(spark, 2, 32), block).select("task", "side", "root", "node", "shared")
              .groupBy("task").applyInArrow(_linked, "u long, v long"))
    found = components(linked)
    rooted = known.join(found.withColumnRenamed("node", "c_"), F.col("node") == F.col("c_"), "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r_")
    classes = rooted.join(smallest, F.col("root") == F.col("r_")).select(F.col("node").alias("n_"), "component_id")
    return prints.join(classes, F.col("node") == F.col("n_")).select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
