"""SimHash near duplicates against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from transeval.llm import simhash
from transeval.llm.common import table


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    prints = [brute_print(t) for _, t in rows]
    known = sorted(set(prints))
    root = {p: p for p in known}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for x, p in enumerate(known):
        for q in known[x + 1:]:
            if (p ^ q).bit_count() <= 3:
                root[top(p)] = top(q)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        ids = [x for x in (least.get(top(p)), i) if x is not None]
        least[top(p)] = min(ids) if ids else None
    return sorted(((i, f"{p:016x}", least[top(p)]) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = found(simhash.near_duplicates(docs))
    assert got == brute_classes(rows)
    assert any(i != c for i, _, c in got)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert found(simhash.near_duplicates(odd_docs)) == brute_classes([(r[0], r[1]) for r in odd_rows])
    assert found(simhash.near_duplicates(no_docs)) == []


def test_null_ids_alone(spark):
    df = spark.createDataFrame([(None, "some text of its own"), (3, "an other"), (None, None), (None, "")], "doc_id long, text string")
    assert found(simhash.near_duplicates(df)) == brute_classes([(r[0], r[1]) for r in df.collect()])


def near_prints(n, seed):
    """Fingerprints in clusters, at distances around the radius."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    return sorted(out)


@pytest.mark.parametrize("bits", [list(range(64)), list(range(63, -1, -1))])
def test_bit_slices_count_exactly(bits):
    prints = np.array(near_prints(300, 2), np.uint64)
    low, high = np.arange(len(prints)) + 1, np.full(len(prints), len(prints))
    pairs = set()
    for q, place in simhash.within_radius(simhash.planes(prints), prints, low, high, np.array(bits), at_once=50):
        pairs |= set(zip(q.tolist(), place.tolist(), strict=True))
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3}
    assert pairs == want and want


@pytest.mark.parametrize("parts", [4, 5, 6])
@pytest.mark.parametrize("block", [4096, 16])
def test_groups_and_blocks_lose_no_link(spark, parts, block, monkeypatch):
    # texts whose fingerprints are given
    prints = near_prints(250, parts)
    monkeypatch.setattr(simhash, "_prints", lambda it: (pa.RecordBatch.from_arrays(
        [b.column(0), pa.array(np.array([int(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64))], names=["doc_id", "node"]) for b in it))
    rows = [(i, str(p)) for i, p in enumerate(prints)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, block=block, parts=parts).collect()}
    root = list(range(len(prints)))
    for _ in range(40):
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root))


def test_more_prints_share_more_bits():
    assert [simhash.parts_for(n) for n in (0, 10**6, 10**9, 10**11)] == [4, 4, 5, 6]
    assert len(simhash.shared_masks(6)) == 20 and all(m.bit_count() in (31, 32, 33) for m in simhash.shared_masks(6))
