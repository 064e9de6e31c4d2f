"""Exact and proximity matches of benchmark phrases against brute force."""

import random
import re

import pytest

from transeval.llm import decontamination as dc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def windows(t):
    w = words(t)
    return {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12))} if w else set()


def near(doc, phrase, slop):
    """From some start each term stands at most ``slop`` words behind its place."""
    at = {}
    for p, w in enumerate(doc):
        at.setdefault(w, set()).add(p)
    return any(all(any(s + o + j in at.get(t, ()) for j in range(slop + 1)) for o, t in enumerate(phrase)) for s in range(-slop, len(doc)))


def cases(seed):
    rng = random.Random(seed)
    known = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(known, k=rng.choice([1, 2, 5, 13, 15, 20])))) for i in range(8)] + [(90, ""), (91, None), (92, "absent words here")]
    docs = [(i, " ".join(rng.choices(known, k=rng.randint(0, 60)))) for i in range(12)]
    for k, (i, t) in enumerate(items[:8]):
        w = t.split()
        gained = [x for y in w for x in ([y] if rng.random() < 0.85 else [y, "zz"])]
        lost = [y for y in w if rng.random() < 0.9]
        turned = w[:]
        for j in range(0, len(w) - 1, 4):
            turned[j], turned[j + 1] = turned[j + 1], turned[j]
        for m, v in enumerate((w, gained, lost, turned, [*w[:6], "zz", "zz", "zz", *w[6:]])):
            docs.append((100 + 10 * k + m, " ".join([*rng.choices(known, k=rng.randint(0, 9)), *v, *rng.choices(known, k=rng.randint(0, 9))])))
    docs += [(500, items[4][1].upper()), (None, items[4][1]), (501, None), (502, ""), (503, items[4][1]), (503, "an other text")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contamination_equals_brute_force(spark, seed):
    docs, items = cases(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated, r.n_near) for r in dc.contamination(df, bench).collect()), key=repr)
    forms = {i: windows(t) for i, t in items}
    want = []
    for d, t in docs:
        w, hit, exact, close = words(t), set(), set(), set()
        for i, phrases in forms.items():
            for p in phrases:
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k:k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        exact.add(i)
                if near(w, p, dc.SLOP):
                    close.add(i)
        want.append((d, len(w), len(hit), len(exact), bool(hit) and 20 * len(hit) >= len(w), len(close)))
    assert got == sorted(want, key=repr)
    assert any(x[5] > x[3] for x in want) and any(x[3] for x in want)


def test_only_rarest_terms_are_stored(spark):
    docs, items = cases(5)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found, _ = dc.phrases(dc.with_words(bench, "item_id", "text", "item_id").select("item_id", "words"))
    terms = found.selectExpr("explode(terms) as term").distinct()
    counts = dc.term_counts(df, terms)
    n = {r.term: r.n for r in counts.collect()}
    all_words = [w for _, t in docs for w in words(t)]
    assert n == {t: all_words.count(t) for t in {x.term for x in terms.collect()} if t in all_words}
    rare = dc.rarest_terms(found, counts).collect()
    by_phrase = {}
    for r in rare:
        by_phrase.setdefault(r.phrase_id, []).append(r.term)
    assert max(map(len, by_phrase.values())) == dc.RAREST
    index = dc.build_index(df, spark.createDataFrame([(t,) for t in {r.term for r in rare}], "term string"))
    assert {r.term for r in index.filter("term is not null").collect()} == {r.term for r in rare} & set(all_words)


def test_broadcasts_are_measured(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id", "repeat('x', 100) as s")
    plan = lambda: spark.range(10).join(dc.bounded(df), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 50_000)
    assert "strategy=broadcast" not in plan()
