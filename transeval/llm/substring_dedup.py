"""Removal of word passages that an earlier document has, by difference-cover anchors.

A window is ``WINDOW`` (13) consecutive words. {1, 2, 4} is a difference cover modulo 7: for
any two places there is a shift of less than 7 words after which both stand at a covered
place of their document. So two equal windows always share, at the same offset of at most 6,
a run of 7 words that is hashed in both documents, though only 3 of 7 places are hashed.

1. Each shard of documents sends its distinct anchor hashes to buckets, which answer which
   of them occur in more than one document.
2. From a repeated anchor the match is extended to the windows around it: each window of 13
   words that holds one is hashed as a whole, and each shard sends its distinct windows with
   the smallest document id that has them; buckets answer whether another shard has a
   smaller one.
3. Each shard removes the words that such windows cover.

A window is known by two hashes of 64 bits: two different windows are taken for one only if
128 bits agree. The rows of a shard arrive in any order, and in another one each time they are
read; a shard sorts them by id and text first, so that its places mean the same in each step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for
from .shards import MULTIPLIERS, NULL_ID, firsts, packed_ids, record, rolled, sharded, slices, unpacked_ids

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1

ANCHOR_COLUMNS = [("bucket", pa.int64()), ("shard", pa.int64()), ("prints", pa.binary()), ("marks", pa.binary())]
ANSWER_COLUMNS = [("shard", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]


class _Shard:
    """The words of one shard, its documents one after another."""

    def __init__(self, rows: pa.Table, buckets: int):
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.words = [texts[i].split() for i in order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        hashes = np.empty(n, np.uint64)
        for w, a, z in zip(self.words, self.starts, self.sizes, strict=True):
            hashes[a:a + z] = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, z)
        self.hashes, self.n = hashes, n
        self.doc_of = np.repeat(self.ids, self.sizes)
        self.place = (np.arange(n) - np.repeat(self.starts, self.sizes)).astype(np.int32)
        self.left = np.repeat(self.sizes.astype(np.int32), self.sizes) - self.place
        self.shift = np.uint64(64 - (buckets.bit_length() - 1))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors and their hashes."""
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= ANCHOR) & (self.left + self.place >= WINDOW))
        return at, rolled(self.hashes, ANCHOR, MULTIPLIERS[0])[at]

    def distinct(self, at: np.ndarray, *hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted by the hashes and the document: the order, the entry each belongs to, and of
        each entry its bucket (the first bits of its first hash), its hashes, its smallest
        document and whether it has several."""
        d = self.doc_of[at]
        order = np.lexsort((d, *hashes[::-1]))
        h, d = [x[order] for x in hashes], d[order]
        new = firsts(*h)
        entry = np.cumsum(new) - 1
        several = np.zeros(int(new.sum()), bool)
        if len(d):
            several[entry[np.flatnonzero(~new & (np.r_[False, d[1:] != d[:-1]]))]] = True
        return order, entry, h[0][new] >> self.shift, [x[new] for x in h], d[new], several

    def windows(self, repeated: np.ndarray) -> np.ndarray:
        """Places of the windows that hold one of these anchor places."""
        count = np.zeros(self.n + 1, np.int64)
        count[repeated + 1] = 1
        count = np.cumsum(count)
        i = np.arange(self.n)
        return np.flatnonzero((self.left >= WINDOW) & (count[np.minimum(i + PERIOD, self.n)] > count[i]))

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rolled(self.hashes, WINDOW, MULTIPLIERS[1])[at], rolled(self.hashes, WINDOW, MULTIPLIERS[0])[at]


def _shard_no(rows: pa.Table) -> int:
    return rows.column("shard")[0].as_py()


def _send_anchors(rows: pa.Table, buckets: int) -> pa.Table:
    s = _Shard(rows, buckets)
    at, prints = s.anchors()
    _, _, b, (p,), _, several = s.distinct(at, prints)
    return record(ANCHOR_COLUMNS, [(k, _shard_no(rows), p[a:z].tobytes(), np.packbits(several[a:z]).tobytes()) for k, a, z in slices(b)])


def _answer_anchors(sent: pa.Table) -> pa.Table:
    """For each entry of each shard: whether more than one document has the anchor."""
    prints = [np.frombuffer(x.as_py(), "<u8") for x in sent.column("prints")]
    sizes = [len(p) for p in prints]
    several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(sent.column("marks"), sizes, strict=True)]
    _, entry, size = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
    often = (size > 1) | (np.bincount(entry, np.concatenate(several)) > 0)
    bits = np.split(often[entry], np.cumsum(sizes)[:-1])
    return record(ANSWER_COLUMNS, [(s.as_py(), b.as_py(), np.packbits(x).tobytes()) for s, b, x in zip(sent.column("shard"), sent.column("bucket"), bits, strict=True)])


def _bits(answers: pa.Table, entries: np.ndarray) -> np.ndarray:
    """The answer to each entry, given the sorted buckets of the entries."""
    raw = {b.as_py(): x.as_py() for b, x in zip(answers.column("bucket"), answers.column("bits"), strict=True)}
    out = np.zeros(len(entries), bool)
    for k, a, z in slices(entries):
        out[a:z] = np.unpackbits(np.frombuffer(raw[k], np.uint8), count=z - a)
    return out


def _repeated(s: _Shard, answers: pa.Table) -> np.ndarray:
    """Places of the anchors that are answered to occur in several documents."""
    at, prints = s.anchors()
    order, entry, b, _, _, _ = s.distinct(at, prints)
    return np.sort(at[order][_bits(answers, b)[entry]])


def _send_windows(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not rows.num_rows:
        return record(ANCHOR_COLUMNS, [])
    s, no = _Shard(rows, buckets), _shard_no(rows)
    places = s.windows(_repeated(s, answers))
    _, _, b, (p, q), d, _ = s.distinct(places, *s.window_hashes(places))
    out = [(k, no, p[a:z].tobytes() + q[a:z].tobytes(), packed_ids(d[a:z])) for k, a, z in slices(b)]
    # the shard's note to itself: which windows it has asked about
    note = np.zeros(s.n, bool)
    note[places] = True
    return record(ANCHOR_COLUMNS, [*out, (-1 - no, no, b"", np.packbits(note).tobytes())])


def _answer_windows(sent: pa.Table) -> pa.Table:
    """For each entry of each shard: whether another shard has a smaller document with it."""
    bucket = sent.column("bucket")[0].as_py()
    if bucket < 0:
        return record(ANSWER_COLUMNS, [(s.as_py(), bucket, x.as_py()) for s, x in zip(sent.column("shard"), sent.column("marks"), strict=True)])
    prints = [np.frombuffer(x.as_py(), "<u8").reshape(2, -1) for x in sent.column("prints")]
    ids = np.concatenate([unpacked_ids(x.as_py()) for x in sent.column("marks")])
    p, q = np.concatenate(prints, axis=1)
    order = np.lexsort((ids, q, p))
    new = firsts(p[order], q[order])
    least = np.empty(len(ids), np.int64)
    least[order] = ids[order][new][np.cumsum(new) - 1]
    bits = np.split(least < ids, np.cumsum([x.shape[1] for x in prints])[:-1])
    return record(ANSWER_COLUMNS, [(s.as_py(), bucket, np.packbits(x).tobytes()) for s, x in zip(sent.column("shard"), bits, strict=True)])


def _remove(rows: pa.Table, answers: pa.Table, buckets: int, names: list[str]) -> pa.Table:
    columns = [(names[0], pa.int64()), (names[1], pa.int64()), (names[2], pa.int64()), (names[3], pa.string())]
    if not rows.num_rows:
        return record(columns, [])
    s, no = _Shard(rows, buckets), _shard_no(rows)
    note = next(x.as_py() for b, x in zip(answers.column("bucket"), answers.column("bits"), strict=True) if b.as_py() == -1 - no)
    places = np.flatnonzero(np.unpackbits(np.frombuffer(note, np.uint8), count=s.n))
    order, entry, b, _, least, _ = s.distinct(places, *s.window_hashes(places))
    at = places[order]
    gone = at[_bits(answers, b)[entry] | (s.doc_of[at] > least[entry])]
    cover = np.bincount(gone, minlength=s.n + WINDOW).astype(np.int64) - np.bincount(gone + WINDOW, minlength=s.n + WINDOW)[:s.n + WINDOW]
    keep = np.cumsum(cover)[:s.n] == 0
    out = []
    for doc_id, words, a, n in zip(s.ids.tolist(), s.words, s.starts, s.sizes, strict=True):
        k = keep[a:a + n]
        left = words if k.all() else [words[i] for i in np.flatnonzero(k)]
        out.append((None if doc_id == NULL_ID else doc_id, int(n), int(n - k.sum()), hashlib.sha256(b" ".join(left)).hexdigest()))
    return record(columns, out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs``.

    Words are separated by ASCII white space and taken as they are. A word goes if a window
    that covers it also starts in a document with a smaller id; windows are judged on the
    input. Repeats inside one document, and rows that share an id, remove nothing from each
    other. A null id is smaller than any other; null and empty texts have no words. Other
    columns of ``docs`` are not read.
    """
    buckets = buckets_for(docs.sparkSession)
    rows = sharded(docs, id_col, text_col)
    sent = "bucket long, shard long, prints binary, marks binary"
    answer = "shard long, bucket long, bits binary"
    result = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    by_shard = lambda df: df.groupBy("shard")
    first = (by_shard(rows).applyInArrow(lambda t: _send_anchors(t, buckets), sent)
             .groupBy("bucket").applyInArrow(_answer_anchors, answer))
    second = (by_shard(rows).cogroup(by_shard(first)).applyInArrow(lambda t, a: _send_windows(t, a, buckets), sent)
              .groupBy("bucket").applyInArrow(_answer_windows, answer))
    return (by_shard(rows).cogroup(by_shard(second))
            .applyInArrow(lambda t, a: _remove(t, a, buckets, result), "doc_id long, n_words long, n_removed long, kept_sha256 string")
            .select(*[F.col(c) for c in result]))
