"""Meeting of equal fingerprints without gathering their places.

Documents are dealt by a hash of their id into shards of about ``SHARD_BYTES`` of text; one
task holds one shard at a time. A shard sends each fingerprint it holds once, however often
it occurs there, to the fingerprint's bucket; a bucket answers each shard with one bit for
each fingerprint, in the order sent. A shard can make its fingerprints again from its texts,
so neither places nor document ids travel, no bucket ever sees more than one entry for a
shard and fingerprint, and a passage that a third of all documents hold is no larger to a
bucket than one that each shard holds once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

SHARD_BYTES = 4 << 20
#: Stands for a null id inside the operators: smaller than any other.
NULL_ID = -(1 << 63)

MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def sharded(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, doc_id, text (as UTF-8 bytes; null: empty). The number of shards follows the
    measured bytes of text; all rows of one id share a shard."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes), min(64, shuffle_partitions(docs.sparkSession)))
    doc_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    return docs.select(F.pmod(F.xxhash64(doc_id), F.lit(shards)).alias("shard"), doc_id.alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all bits depend on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(values: np.ndarray, width: int, multiplier: np.uint64) -> np.ndarray:
    """Hash of each ``width`` consecutive values, by Horner's rule modulo 2^64."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = values[:n].copy()
    for j in range(1, width):
        out *= multiplier
        out += values[j:j + n]
    return mixed(out)


def by_bucket(prints: np.ndarray, buckets: np.ndarray, *rest: np.ndarray) -> list[np.ndarray]:
    """Everything in the order of bucket, then fingerprint, then ``rest``."""
    order = np.lexsort((*rest[::-1], prints, buckets))
    return [order, prints[order], buckets[order], *(r[order] for r in rest)]


def firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal rows."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def slices(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted buckets."""
    if not len(buckets):
        return []
    starts = np.flatnonzero(firsts(buckets))
    return [(int(buckets[a]), int(a), int(z)) for a, z in zip(starts, [*starts[1:], len(buckets)], strict=True)]


def packed_ids(ids: np.ndarray) -> bytes:
    """64-bit ids of which many are the same: the distinct ones, then an index of each."""
    known, index = np.unique(ids, return_inverse=True)
    kind = "<u2" if len(known) <= 1 << 16 else "<u4"
    return np.int32(len(known)).tobytes() + known.astype("<i8").tobytes() + index.astype(kind).tobytes()


def unpacked_ids(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    known = np.frombuffer(raw, "<i8", n, 4)
    return known[np.frombuffer(raw, "<u2" if n <= 1 << 16 else "<u4", offset=4 + 8 * n)]


def record(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in columns]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, columns, strict=True)], names=[n for n, _ in columns])
