"""Removal of byte passages that occur earlier, by suffix arrays of what may repeat.

A window is ``WINDOW`` (100) bytes. Each window belongs to the place of its smallest hash of
``GRAM`` bytes, its anchor, so equal windows have equal anchors at equal offsets. Windows
that follow each other with the same anchor and the same quarter of offsets make a piece; all
windows of a piece contain the same ``CORE`` bytes.

1. Shards send their distinct anchors to buckets, which answer which occur more than once.
2. Shards send their distinct pieces at such anchors, keyed by the core. Buckets answer which
   shard has a piece first, and whether different pieces share the core. A copy of a piece
   is removed wherever it is not the first.
3. For cores with different pieces, the shard that has a piece first sends its text, and the
   bucket sorts the suffixes of all these texts in two stages (see ``suffix_sort``). Adjacent
   suffixes with a common prefix of 100 bytes are the same window; all but the first of each
   are repeats. Cores with very many different pieces are sent as single windows keyed by
   all their bytes, so that no bucket gathers them all.
4. Each shard removes the bytes that repeated windows cover.

Copies meet as 64-bit hashes beside a hash of their core; texts of different pieces meet as
bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for
from .shards import MULTIPLIERS, NULL_ID, by_bucket, firsts, mixed, packed_ids, record, sharded, slices, unpacked_ids
from .suffix_sort import agree, joined, suffix_array

WINDOW, GRAM = 100, 32
REACH = WINDOW - GRAM + 1
QUARTER = 18
CORE = WINDOW - QUARTER + 1
SHARD_BYTES = 2 << 20
#: Different pieces of one core beyond which their windows are dealt one by one.
MANY_PIECES = 2000
#: Bytes of text whose suffixes are sorted together.
SORT_BYTES = 1 << 20

BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[0])

SENT = [("bucket", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("prints", pa.binary()), ("ids", pa.binary())]
ANSWERED = [("shard", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary()), ("more", pa.binary())]


class _Shard:
    """The bytes of one shard, its documents in the order of their ids."""

    def __init__(self, rows: pa.Table, buckets: int):
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.no = rows.column("shard")[0].as_py()
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = b"".join(self.texts)
        self.n = len(self.raw)
        self.shift = np.uint64(64 - (buckets.bit_length() - 1))
        self._spread()

    def _spread(self) -> None:
        """Hashes of all runs of 1, 2, 16, 64 and ``GRAM`` bytes by doubling, and the anchor
        of each window."""
        n = self.n
        self.runs: dict[int, np.ndarray] = {}
        h, width, power = BYTE_VALUES[np.frombuffer(self.raw, np.uint8)], 1, MULTIPLIERS[1]
        while True:
            if width in (1, 2, 16, 64):
                self.runs[width] = h
            if width == GRAM:
                gram = h
            if width == 64 or len(h) <= width:
                break
            h = h[:-width] * power + h[width:]
            with np.errstate(over="ignore"):
                power = power * power
            width *= 2
        count = max(0, n - WINDOW + 1)
        left = np.repeat(self.starts + self.sizes, self.sizes)[:count] - np.arange(count)
        valid = left >= WINDOW
        if not valid.any():
            self.low = self.high = self.anchor = self.quarter = np.empty(0, np.int64)
            return
        # smallest hash first, then leftmost
        key = (mixed(gram) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        step = 1
        while step * 2 <= REACH:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        rest = REACH - step
        key = np.minimum(key[:-rest], key[rest:])[:count]
        anchor = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del key
        quarter = (anchor - np.arange(count)) // QUARTER
        new = firsts(anchor * 4 + quarter, valid) & valid
        self.low = np.flatnonzero(new)
        end = np.r_[new[1:] | ~valid[1:], True] & valid
        self.high = np.flatnonzero(end)
        self.anchor, self.quarter = anchor[self.low], quarter[self.low]
        self.gram = mixed(gram[self.anchor])

    def core_keys(self) -> np.ndarray:
        at = self.anchor - QUARTER * self.quarter
        r = self.runs
        h = r[64][at]
        for width, offset in ((16, 64), (2, 80), (1, 82)):
            h = mixed(h) + r[width][at + offset]
        return mixed(h * MULTIPLIERS[0] + self.quarter.astype(np.uint64))

    def prints(self, low: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Hashes of texts of 100 to 128 bytes, with the place of the anchor in them."""
        h = mixed(self.runs[64][low]) * MULTIPLIERS[0] + self.runs[64][low + size - 64]
        return mixed(mixed(h) + (size * 1024 + offset).astype(np.uint64))

    def doc_ids(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.starts + self.sizes, places, "right")]

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Order of the pieces by anchor, entry of each, and of each entry bucket, hash, and
        whether it has several anchors."""
        order, p, b = by_bucket(self.gram, self.gram >> self.shift)
        new = firsts(b, p)
        entry = np.cumsum(new) - 1
        lo, hi = np.full(int(new.sum()), 1 << 62), np.zeros(int(new.sum()), np.int64)
        np.minimum.at(lo, entry, self.anchor[order])
        np.maximum.at(hi, entry, self.anchor[order])
        return order, entry, b[new], p[new], lo < hi

    def pieces(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the chosen pieces: their order by core, hash and place, the entry of each, and
        of each entry its bucket, core, hash and first piece."""
        low, size = self.low[chosen], self.high[chosen] - self.low[chosen] + WINDOW
        keys = self.core_keys()[chosen]
        prints = self.prints(low, size, self.anchor[chosen] - low)
        buckets = keys >> self.shift
        order = np.lexsort((low, prints, keys, buckets))
        k, p, b = keys[order], prints[order], buckets[order]
        new = firsts(b, k, p)
        return chosen[order], np.cumsum(new) - 1, b[new], k[new], p[new], chosen[order][new]


def _narrow(keys: np.ndarray) -> bytes:
    """The low half of keys: the bucket they are in tells high bits."""
    return keys.astype("<u4").tobytes()


def _send_anchors(rows: pa.Table, buckets: int) -> pa.Table:
    s = _Shard(rows, buckets)
    if not len(s.low):
        return record(SENT, [])
    _, _, b, p, several = s.anchors()
    return record(SENT, [(k, s.no, _narrow(p[a:z]), np.packbits(several[a:z]).tobytes(), b"") for k, a, z in slices(b)])


def _answer_anchors(sent: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x.as_py(), "<u4") for x in sent.column("keys")]
    sizes = [len(k) for k in keys]
    several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(sent.column("prints"), sizes, strict=True)]
    _, entry, size = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    often = (size > 1) | (np.bincount(entry, np.concatenate(several)) > 0)
    parts = np.split(often[entry], np.cumsum(sizes)[:-1])
    return record(ANSWERED, [(s.as_py(), b.as_py(), np.packbits(x).tobytes(), b"") for s, b, x in zip(sent.column("shard"), sent.column("bucket"), parts, strict=True)])


def _bits(answers: pa.Table, column: str, entries: np.ndarray) -> np.ndarray:
    raw = {b.as_py(): x.as_py() for b, x in zip(answers.column("bucket"), answers.column(column), strict=True)}
    out = np.zeros(len(entries), bool)
    for k, a, z in slices(entries):
        out[a:z] = np.unpackbits(np.frombuffer(raw[k], np.uint8), count=z - a)
    return out


def _send_pieces(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not rows.num_rows or not answers.num_rows:
        return record(SENT, [])
    s = _Shard(rows, buckets)
    order, entry, b, _, _ = s.anchors()
    chosen = np.sort(order[_bits(answers, "bits", b)[entry]])
    _, _, b, k, p, first = s.pieces(chosen)
    ids = s.doc_ids(s.low[first])
    out = [(x, s.no, _narrow(k[a:z]), p[a:z].tobytes(), packed_ids(ids[a:z])) for x, a, z in slices(b)]
    note = np.zeros(len(s.low), bool)
    note[chosen] = True
    return record(SENT, [*out, (-1 - s.no, s.no, np.packbits(note).tobytes(), b"", b"")])


def _answer_pieces(sent: pa.Table, many: int = MANY_PIECES) -> pa.Table:
    """For each entry: 1 if another shard has the piece earlier; 2 if not and its core has
    other pieces as well; 3 if these are very many; else 0. Two bits each."""
    bucket = sent.column("bucket")[0].as_py()
    if bucket < 0:
        return record(ANSWERED, [(s.as_py(), bucket, x.as_py(), b"") for s, x in zip(sent.column("shard"), sent.column("keys"), strict=True)])
    keys = [np.frombuffer(x.as_py(), "<u4") for x in sent.column("keys")]
    k = np.concatenate(keys)
    p = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in sent.column("prints")])
    ids = np.concatenate([unpacked_ids(x.as_py()) for x in sent.column("ids")])
    order = np.lexsort((ids, p, k))
    new = firsts(k[order], p[order])
    core = np.cumsum(firsts(k[order])) - 1
    different = np.bincount(core, new)[core]
    state = np.empty(len(k), np.int64)
    state[order] = np.where(~new, 1, np.where(different > many, 3, np.where(different > 1, 2, 0)))
    cut = np.cumsum([len(x) for x in keys])[:-1]
    return record(ANSWERED, [(s.as_py(), bucket, np.packbits((x & 1) > 0).tobytes(), np.packbits(x > 1).tobytes())
                             for s, x in zip(sent.column("shard"), np.split(state, cut), strict=True)])


def _send_texts(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not rows.num_rows or not answers.num_rows:
        return record(SENT, [])
    s = _Shard(rows, buckets)
    own = next(x.as_py() for b, x in zip(answers.column("bucket"), answers.column("bits"), strict=True) if b.as_py() == -1 - s.no)
    chosen = np.flatnonzero(np.unpackbits(np.frombuffer(own, np.uint8), count=len(s.low)))
    piece, entry, b, k, _, first = s.pieces(chosen)
    odd, high = _bits(answers, "bits", b), _bits(answers, "more", b)
    elsewhere, ask, split = odd & ~high, ~odd & high, odd & high
    # windows known to be repeats: all copies but the first in the shard, and those that
    # another shard has earlier
    gone = piece[(piece != first[entry]) | elsewhere[entry]]
    known = np.zeros(s.n + 1, np.int64)
    np.add.at(known, s.low[gone], 1)
    np.add.at(known, s.high[gone] + 1, -1)
    known = np.cumsum(known)[:s.n] > 0
    low, high_, key, where = s.low[first[ask]], s.high[first[ask]], k[ask], b[ask]
    # single windows, keyed by all their bytes
    lone = [np.arange(a, z + 1) for a, z in zip(s.low[first[split]], s.high[first[split]], strict=True)]
    if lone:
        at = np.concatenate(lone)
        h = s.prints(at, np.full(len(at), WINDOW), np.zeros(len(at), np.int64))
        order = np.lexsort((at, h))
        new = firsts(h[order])
        known[at[order][~new]] = True  # equal windows inside the shard: the first asks for all
        at, h = at[order][new], h[order][new]
        low, high_ = np.concatenate([low, at]), np.concatenate([high_, at])
        key, where = np.concatenate([key, h]), np.concatenate([where, h >> s.shift])
    order = np.lexsort((low, key, where))
    low, high_, key, where = low[order], high_[order], key[order], where[order]
    ids = s.doc_ids(low)
    out = []
    for x, a, z in slices(where):
        texts = b"".join([s.raw[i:j + WINDOW] for i, j in zip(low[a:z].tolist(), high_[a:z].tolist(), strict=True)])
        sizes = (high_[a:z] - low[a:z]).astype(np.uint8).tobytes()
        out.append((x, s.no, key[a:z].astype("<u8").tobytes(), sizes + texts, ids[a:z].astype("<i8").tobytes()))
    note = np.stack([where.astype(np.int64), low, high_]).astype("<i8").tobytes()
    return record(SENT, [*out, (-1 - s.no, s.no, np.packbits(known).tobytes(), note, b"")])


def repeated_windows(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """For each text, which of its windows occurs in a text of lower rank (or earlier in the
    same text): windows whose suffixes are neighbours with a long enough common prefix."""
    symbols, starts = joined(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    whole = (starts + sizes)[owner] - np.arange(len(symbols)) >= WINDOW
    places = suffix_array(symbols, WINDOW)
    places = places[whole[places]]
    same = agree(symbols, places, WINDOW)
    group = np.cumsum(np.r_[True, ~same])[:len(places)] - 1
    order = np.lexsort((places, rank[owner[places]], group))
    first = np.zeros(len(places), bool)
    first[order] = firsts(group[order])
    repeat = np.zeros(len(symbols), bool)
    repeat[places[~first]] = True
    return [repeat[a:a + n - WINDOW + 1] for a, n in zip(starts, sizes, strict=True)]


def _answer_texts(sent: pa.Table) -> pa.Table:
    bucket = sent.column("bucket")[0].as_py()
    if bucket < 0:
        return record(ANSWERED, [(s.as_py(), bucket, k.as_py(), p.as_py()) for s, k, p in zip(sent.column("shard"), sent.column("keys"), sent.column("prints"), strict=True)])
    keys, ids, texts, count = [], [], [], []
    for k, p, i in zip(sent.column("keys"), sent.column("prints"), sent.column("ids"), strict=True):
        k, i, raw = np.frombuffer(k.as_py(), "<u8"), np.frombuffer(i.as_py(), "<i8"), p.as_py()
        at = len(k)
        for extra in raw[:len(k)]:
            texts.append(raw[at:at + WINDOW + extra])
            at += WINDOW + extra
        keys.append(k)
        ids.append(i)
        count.append(len(k))
    key, rank = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(key, kind="stable")  # pieces of one core together
    bits: list[np.ndarray] = [np.empty(0, bool)] * len(texts)
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.r_[np.flatnonzero(key[order][1:] != key[order][:-1]) + 1, len(order)]
    a = 0
    done = np.r_[0, np.cumsum(sizes)]
    for z, nxt in zip(ends, [*ends[1:], len(order) + 1], strict=True):
        if nxt <= len(order) and done[nxt] - done[a] <= SORT_BYTES:
            continue
        some = order[a:z]
        for i, r in zip(some, repeated_windows([texts[i] for i in some], rank[some]), strict=True):
            bits[i] = r
        a = z
    out, at = [], 0
    for s, n in zip(sent.column("shard"), count, strict=True):
        out.append((s.as_py(), bucket, np.packbits(np.concatenate(bits[at:at + n])).tobytes(), b""))
        at += n
    return record(ANSWERED, out)


def _remove(rows: pa.Table, answers: pa.Table, names: list[str]) -> pa.Table:
    columns = [(names[0], pa.int64()), *((c, pa.int64()) for c in names[1:4]), (names[4], pa.string())]
    if not rows.num_rows:
        return record(columns, [])
    ids, texts, no = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), rows.column("shard")[0].as_py()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    n = sum(map(len, texts))
    repeat = np.zeros(n + WINDOW, np.int64)
    raw = {b.as_py(): (x.as_py(), y.as_py()) for b, x, y in zip(answers.column("bucket"), answers.column("bits"), answers.column("more"), strict=True)}
    if -1 - no in raw:
        known, asked = raw[-1 - no]
        repeat[:n] = np.unpackbits(np.frombuffer(known, np.uint8), count=n)
        where, low, high = np.frombuffer(asked, "<i8").reshape(3, -1)
        for k, a, z in slices(where):
            size = high[a:z] - low[a:z] + 1
            at = np.repeat(low[a:z] - np.cumsum(size) + size, size) + np.arange(size.sum())
            found = np.unpackbits(np.frombuffer(raw[k][0], np.uint8), count=len(at)).astype(bool)
            repeat[at[found]] = 1
    cover = np.cumsum(repeat)
    cover = (cover[:n] - np.r_[np.zeros(min(n, WINDOW), np.int64), cover[:max(0, n - WINDOW)]]) > 0
    out, at = [], 0
    for i in order:
        gone, size = cover[at:at + len(texts[i])], len(texts[i])
        at += size
        spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if size else 0
        kept = texts[i] if not spans else np.frombuffer(texts[i], np.uint8)[~gone].tobytes()
        out.append((None if ids[i] == NULL_ID else ids[i], size, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return record(columns, out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many_pieces: int = MANY_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``.

    Texts are UTF-8 bytes; null counts as empty. A byte goes if a string of 100 bytes that
    covers it also starts earlier, in a document with a smaller id or further up in the same
    one; overlapping occurrences count, and strings are judged on the input. Rows that share
    an id are taken one after another in the order of their texts. A null id is smaller than
    any other. Other columns of ``docs`` are not read.
    """
    buckets = buckets_for(docs.sparkSession)
    rows = sharded(docs, id_col, text_col, SHARD_BYTES)
    sent = "bucket long, shard long, keys binary, prints binary, ids binary"
    answer = "shard long, bucket long, bits binary, more binary"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    shards = rows.groupBy("shard")
    meet = lambda df, f: df.groupBy("bucket").applyInArrow(f, answer).groupBy("shard")
    anchors = meet(shards.applyInArrow(lambda t: _send_anchors(t, buckets), sent), _answer_anchors)
    pieces = meet(shards.cogroup(anchors).applyInArrow(lambda t, a: _send_pieces(t, a, buckets), sent),
                  lambda t: _answer_pieces(t, many_pieces))
    texts = meet(shards.cogroup(pieces).applyInArrow(lambda t, a: _send_texts(t, a, buckets), sent), _answer_texts)
    return (shards.cogroup(texts).applyInArrow(lambda t, a: _remove(t, a, names), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
            .select(*[F.col(c) for c in names]))
