"""Exact dedup by counting quotient filters.

Each partition builds a counting quotient filter over the 64-bit fingerprints of its
normalised texts: the high bits of a fingerprint are its quotient, the low bits the
remainder kept in the filter, next to a count. Filters are cut into slices by quotient,
equal slices of all partitions merge by sorted remainders without loss, and only the
fingerprints whose merged count is above one go on to byte verification, a group-by on
the normalised text itself.

Texts are read a second time for that, and few leave their task. Each merged slice also gives
a segment of a bit map of fixed size, in which the fingerprints that occur more than once are
marked; tasks drop the texts whose fingerprint is not marked, and combine equal texts before
they send them on, so a group of copies of any size is a row or so per task. The map may mark
others, which an exact join drops afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, buckets_for, small_batches, written
from .shards import mixed

FINGERPRINT_BITS = 64
#: Bits of the map of repeated fingerprints (16 MB), and of a fingerprint that choose its segment.
MAP_BITS, SEGMENT_CHOICE = 1 << 27, 6
#: Text that a task holds before it hands combined rows on.
HELD_BYTES = 32 << 20
SLICE_SCHEMA = "slice long, quotients binary, ends binary, remainders binary, counts binary"


class CountingQuotientFilter:
    """Multiset of 64-bit fingerprints of one slice.

    ``occupied`` has a bit for each quotient that has a run, ``ends`` a bit for each slot
    that ends a run, ``remainders`` the sorted remainders of all runs one after another,
    ``counts`` how often each occurred. Quotient and remainder together are the whole
    fingerprint, so merging and listing lose nothing.
    """

    def __init__(self, quotients: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int):
        self.quotients, self.ends, self.remainders, self.counts, self.bits = quotients, ends, remainders, counts, bits

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """``bits``: of the remainder. ``prints`` may be in any order and repeat."""
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.empty(0, int)
        total = np.add.reduceat(counts, first) if len(first) else counts[:0]
        prints = prints[first]
        quotient = prints >> np.uint64(bits)
        ends = np.r_[quotient[1:] != quotient[:-1], True] if len(prints) else np.empty(0, bool)
        return cls(quotient[ends], np.packbits(ends), prints & np.uint64((1 << bits) - 1), total, bits)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in order, and their counts."""
        n = len(self.remainders)
        ends = np.unpackbits(self.ends, count=n).astype(bool) if n else np.empty(0, bool)
        run = np.cumsum(np.r_[0, ends[:-1]]) if n else np.empty(0, int)
        return (self.quotients[run] << np.uint64(self.bits)) | self.remainders, self.counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        parts = [f.items() for f in filters]
        return cls.of(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]), bits)

    def to_row(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.quotients.astype("<u8").tobytes(), self.ends.tobytes(), self.remainders.astype("<u8").tobytes(), self.counts.astype("<i8").tobytes()

    @classmethod
    def from_row(cls, quotients: bytes, ends: bytes, remainders: bytes, counts: bytes, bits: int) -> CountingQuotientFilter:
        return cls(np.frombuffer(quotients, "<u8"), np.frombuffer(ends, np.uint8), np.frombuffer(remainders, "<u8"), np.frombuffer(counts, "<i8"), bits)


def _build(batches: Iterator[pa.RecordBatch], slices: int, bits: int, flush: int) -> Iterator[pa.RecordBatch]:
    """The slices of one partition's filter; a filter is handed on when ``flush``
    fingerprints have been gathered, so that a partition of any size fits."""
    def cut(prints: list[np.ndarray]) -> pa.RecordBatch:
        allp = np.sort(np.concatenate(prints))
        shift = FINGERPRINT_BITS - (slices.bit_length() - 1)
        keys = (allp >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(allp), np.int64)
        bounds = np.searchsorted(keys, np.arange(slices + 1))
        rows = []
        for s in np.unique(keys):
            part = allp[bounds[s]:bounds[s + 1]]
            rows.append((int(s), *CountingQuotientFilter.of(part, np.ones(len(part), np.int64), bits).to_row()))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
            names=["slice", "quotients", "ends", "remainders", "counts"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += b.num_rows
        if n >= flush:
            yield cut(held)
            held, n = [], 0
    if n:
        yield cut(held)


def _repeated(slices: pd.DataFrame, bits: int) -> pd.DataFrame:
    merged = CountingQuotientFilter.merge(
        [CountingQuotientFilter.from_row(q, e, r, c, bits) for q, e, r, c in zip(slices["quotients"], slices["ends"], slices["remainders"], slices["counts"], strict=True)], bits)
    prints, counts = merged.items()
    return pd.DataFrame({"print": prints[counts > 1].view(np.int64)})


def repeated_fingerprints(prints: DataFrame, remainder_bits: int = 40, flush: int = 1 << 20) -> DataFrame:
    """The distinct values of the one long column of ``prints`` that occur more than once."""
    spark = prints.sparkSession
    slices = buckets_for(spark)
    bits = remainder_bits
    parts = prints.mapInArrow(lambda it: _build(it, slices, bits, flush), SLICE_SCHEMA)
    return parts.groupBy("slice").applyInPandas(lambda pdf: _repeated(pdf, bits), "print long")


class Marks:
    """A bit map in segments; a value's first bits choose the segment, two others in it its
    places."""

    def __init__(self, segments: dict[int, np.ndarray], segment_bits: int):
        self.segments, self.segment_bits = segments, segment_bits

    @staticmethod
    def places(prints: np.ndarray, segment_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment of each fingerprint, and its two places there."""
        mask = np.uint64(segment_bits - 1)
        spread = mixed(prints.view(np.uint64))
        return (prints.view(np.uint64) >> np.uint64(64 - SEGMENT_CHOICE)).astype(np.int64), (spread & mask).astype(np.int64), ((spread >> np.uint64(32)) & mask).astype(np.int64)

    def has(self, prints: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prints), bool)
        which, a, b = self.places(prints, self.segment_bits)
        for s in np.unique(which):
            bits = self.segments.get(int(s))
            if bits is not None:
                at = np.flatnonzero(which == s)
                out[at] = ((bits[a[at] >> 3] >> (a[at] & 7)) & (bits[b[at] >> 3] >> (b[at] & 7)) & 1).astype(bool)
        return out


def marks_of(hot: DataFrame, map_bits: int = MAP_BITS) -> Marks:
    """The map of the fingerprints in ``hot`` (print): its size does not depend on them."""
    segment_bits = map_bits >> SEGMENT_CHOICE

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = pdf["print"].to_numpy()
        which, a, b = Marks.places(prints, segment_bits)
        set_ = np.zeros(segment_bits, bool)
        set_[a] = set_[b] = True
        return pd.DataFrame({"segment": [int(which[0])], "bits": [np.packbits(set_, bitorder="little").tobytes()]})

    segment = F.shiftrightunsigned("print", 64 - SEGMENT_CHOICE)
    rows = hot.groupBy(segment.alias("segment")).applyInPandas(mark, "segment long, bits binary").collect()
    return Marks({r["segment"]: np.frombuffer(r["bits"], np.uint8) for r in rows}, segment_bits)


def _combined(batches: Iterator[pa.RecordBatch], marks: Marks, most_bytes: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows (print, norm, keep_id, group_size) of the texts marked, equal ones combined; what
    is held is handed on beyond ``most_bytes`` of text."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        prints, ids, counts = zip(*held.values(), strict=True)
        out = [pa.array(prints, pa.int64()), pa.array(list(held), pa.string()), pa.array(ids, id_type), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(out, names=["print", "norm", "keep_id", "group_size"])

    for b in batches:
        id_type = b.column(0).type
        at = np.flatnonzero(marks.has(b.column(1).to_numpy(zero_copy_only=False)))
        if not len(at):
            continue
        some = b.take(pa.array(at))
        for i, p, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
            known = held.get(t)
            if known is None:
                held[t] = [p, i, 1]
                size += len(t)
            else:
                known[2] += 1
                if known[1] is None or (i is not None and i > known[1]):
                    known[1] = i
        if size >= most_bytes:
            yield flush()
            held.clear()
            size = 0
    if held:
        yield flush()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and all
    empty texts are one group. Of equal texts the row with the largest id stays. Rows that
    repeat id and text count each in ``group_size`` and share one verdict; a null id is
    smaller than any other. Other columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    norm = ascii_lower(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    slim = base.select("doc_id", F.xxhash64("norm").alias("print"), F.sha2("norm", 256).alias("text_sha256"))
    hot = written(repeated_fingerprints(base.select(F.xxhash64("norm").alias("print"))), "repeated")
    marks = marks_of(hot)
    named = base.select("doc_id", F.xxhash64("norm").alias("print"), "norm")
    schema = named.select("print", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).schema
    combined = named.mapInArrow(lambda it: _combined(it, marks), schema)
    # byte verification: the key is the whole normalised text
    groups = (combined.join(hot, "print", "left_semi").groupBy("print", "norm")
              .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
              .select("print", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    out = slim.join(groups, ["print", "text_sha256"], "left")
    # compare, not coalesce: a group of null ids keeps a null keep_id
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
