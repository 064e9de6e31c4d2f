"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from transeval.llm import spelling
from transeval.llm.common import table


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_vocabulary(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def neighbours(vocab):
    """By deleting one code point of each: near words share such a rest, or one is a rest."""
    rests = {}
    for w in vocab:
        for k in range(len(w)):
            rests.setdefault(w[:k] + w[k + 1:], set()).add(w)
    near = {w: set() for w in vocab}
    for rest, group in rests.items():
        group = group | ({rest} if rest in vocab else set())
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    return near


def brute(rows):
    vocab = brute_vocabulary(rows)
    near, form = neighbours(vocab), {}
    for w, c in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * c else None
    out = []
    for w, c in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, c, len(near[w]), vocab.get(form[w])))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = found(spelling.variants(docs))
    assert got == brute(rows)
    assert any(r[4] for r in got)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert found(spelling.variants(odd_docs)) == brute([(r[0], r[1]) for r in odd_rows])
    assert found(spelling.variants(no_docs)) == []


def words_of(seed, n=300, letters="abé"):
    rng = random.Random(seed)
    out = {"a" * k for k in range(7, 40)} | {"ab" * k for k in range(4, 9)} | {"b" * 3000, "b" * 2999 + "a", "b" * 2999}
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 9)))
        out.add(w)
        k = rng.randrange(len(w))
        v = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])
        if len(v) >= 7:
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_composition_accepts_the_near_pairs(seed):
    words = words_of(seed, letters="ab" if seed % 2 else "abé😀")
    m = spelling.minimised(words, np.zeros(len(words), np.int64))
    no, u, v = spelling.composed(m, m.initial, m.initial)
    got = [tuple(sorted((words[i], words[j]))) for i, j in zip(u, v, strict=True)]
    want = {(a, b) for k, a in enumerate(words) for b in words[k + 1:] if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
    # fewer states than the tree of the words has
    assert len(m.final) < len({w[:k] for w in words for k in range(len(w) + 1)})


def test_two_acceptors_composed():
    words = words_of(9)
    sides = np.array([k % 2 for k in range(len(words))])
    order = np.lexsort((np.arange(len(words)), sides))
    m = spelling.minimised([words[k] for k in order], sides[order])
    _, u, v = spelling.composed(m, m.initial[:1], m.initial[1:])
    left, right = [w for w, s in zip(words, sides, strict=True) if s == 0], [w for w, s in zip(words, sides, strict=True) if s == 1]
    got = [(left[i], right[j]) for i, j in zip(u, v, strict=True)]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in left for b in right if one_edit(a, b)}


@pytest.mark.parametrize("block", [1 << 13, 8])
def test_initial_states_and_blocks_lose_no_pair(spark, block):
    words = words_of(4, 600)
    rng = random.Random(2)
    counts = {w: rng.choice([2, 3, 30, 400, 5000]) for w in words}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r.near_of: (r.n_near, -r.best.less, r.best.word) for r in spelling.near_words(vocab, len(words), block).collect()}
    near = neighbours(set(words))
    want = {w: (len(x), *min((-counts[y], y) for y in x)) for w, x in near.items() if x}
    assert got == {w: (n, -c, y) for w, (n, c, y) in want.items()}


def test_chains_of_forms(spark):
    steps = [(f"word{i}", f"word{i + 1}") for i in range(18)]
    ends = {r.word: r.root for r in spelling.roots(spark.createDataFrame(steps, "word string, form string")).collect()}
    assert ends == {w: "word18" for w, _ in steps}
