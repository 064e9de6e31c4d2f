"""The steps of op3 and op8 on several shards whose rows arrive in another order each time they
are read, as they do when blocks come from other executors, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from transeval.llm import substring_dedup, suffix_dedup
from transeval.llm.shards import NULL_ID

BUCKETS = 8


def documents():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choices(words, k=k)) for k in (13, 20, 60, 200, 14)]
    out = []
    for i in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 4))]
        parts += rng.sample(passages, rng.randint(0, 2))
        rng.shuffle(parts)
        out.append((i, "  ".join(parts).encode()))
    # copies, a repeated id, null ids, empty texts
    return [*out, (61, out[3][1]), (62, out[3][1]), (5, out[7][1]), (NULL_ID, out[9][1]), (NULL_ID, b"x y"), (63, b"")]


def shards_of(docs, n):
    return {s: [d for d in docs if d[0] % n == s] for s in range(n)}


class Reader:
    """Reads a shard's rows, permuted anew each time."""

    def __init__(self, docs, n):
        self.shards, self.rng = shards_of(docs, n), random.Random(8)

    def __iter__(self):
        return iter(sorted(self.shards))

    def __getitem__(self, s):
        rows = self.rng.sample(self.shards[s], len(self.shards[s]))
        return pa.table({"shard": pa.array([s] * len(rows), pa.int64()), "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                         "text": pa.array([r[1] for r in rows], pa.binary())})


def grouped(tables, key, rng):
    """Rows by key, in any order inside it."""
    whole = pa.concat_tables(tables)
    whole = whole.take(pa.array(rng.sample(range(whole.num_rows), whole.num_rows), pa.int64()))
    keys = np.array(whole.column(key).to_pylist())
    return {k: whole.take(pa.array(np.flatnonzero(keys == k))) for k in sorted(set(keys.tolist()))}


def met(sent, answer, rng, empty):
    back = grouped([answer(t) for t in grouped(sent, "bucket", rng).values()], "shard", rng)
    return lambda s: back.get(s, empty)


def run_substring(docs, shards):
    m, read, rng = substring_dedup, Reader(docs, shards), random.Random(5)
    empty = m.record(m.ANSWER_COLUMNS, [])
    first = met([m._send_anchors(read[s], BUCKETS) for s in read], m._answer_anchors, rng, empty)
    second = met([m._send_windows(read[s], first(s), BUCKETS) for s in read], m._answer_windows, rng, empty)
    return pa.concat_tables([m._remove(read[s], second(s), BUCKETS, ["doc_id", "n_words", "n_removed", "kept_sha256"]) for s in read])


def run_suffix(docs, shards):
    m, read, rng = suffix_dedup, Reader(docs, shards), random.Random(5)
    empty = m.record(m.ANSWERED, [])
    first = met([m._send_anchors(read[s], BUCKETS) for s in read], m._answer_anchors, rng, empty)
    second = met([m._send_pieces(read[s], first(s), BUCKETS) for s in read], lambda t: m._answer_pieces(t, m.MANY_PIECES), rng, empty)
    third = met([m._send_texts(read[s], second(s), BUCKETS) for s in read], m._answer_texts, rng, empty)
    return pa.concat_tables([m._remove(read[s], third(s), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) for s in read])


def brute_substring(docs):
    first = {}
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = t.split()
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for p in range(k, k + 13)}
        left = [x for p, x in enumerate(w) if p not in gone]
        out.append((None if i == NULL_ID else i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def brute_suffix(docs):
    seen, out = set(), []
    for i, t in sorted(docs):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            if t[k:k + 100] in seen:
                gone[k:k + 100] = True
            seen.add(t[k:k + 100])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((None if i == NULL_ID else i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shards", [1, 3])
@pytest.mark.parametrize(("run", "brute"), [(run_substring, brute_substring), (run_suffix, brute_suffix)])
def test_any_order_of_rows(run, brute, shards):
    docs = documents()
    got = run(docs, shards).to_pylist()
    assert sum(r["n_removed"] for r in got) > 0
    assert sorted((tuple(r.values()) for r in got), key=repr) == sorted(brute(docs), key=repr)
