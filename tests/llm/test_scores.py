"""Scores of the language field and of the quality classifier against plain versions that take
each formula word by word."""

import math
import random

import numpy as np
import pytest

from transeval.llm import language_id, quality
from transeval.llm.common import table


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, "/root/testdata/sf0.001", "documents")


@pytest.fixture(scope="module")
def field(docs):
    return language_id.train(docs)


def plain_posteriors(crf, nodes):
    """Forward and backward sums of a linear chain, in logarithms, one node after another."""
    k = len(crf.labels)
    emit = [crf.emit[crf.features(w)].astype(np.float32).sum(0).astype(np.float64) for w in nodes]

    def log_sum(values):
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    ahead = [[crf.start[y] + emit[0][y] for y in range(k)]]
    for e in emit[1:]:
        ahead.append([e[y] + log_sum([ahead[-1][x] + crf.move[x, y] for x in range(k)]) for y in range(k)])
    back = [[0.0] * k]
    for e in emit[:0:-1]:
        back.append([log_sum([crf.move[y, x] + e[x] + back[-1][x] for x in range(k)]) for y in range(k)])
    out = []
    for a, b in zip(ahead, back[::-1], strict=True):
        z = log_sum([x + y for x, y in zip(a, b, strict=True)])
        out.append([math.exp(x + y - z) for x, y in zip(a, b, strict=True)])
    return np.array(out)


def plain_language(crf, text):
    words = language_id.words_of(text or "")
    if not words:
        return "und", 0.0
    p = plain_posteriors(crf, language_id.nodes_of(words))
    share = p.mean(0)
    return crf.labels[int(share.argmax())], float(share.max())


def test_language_and_score_of_each_text(spark, docs, field):
    rows = docs.orderBy("doc_id").limit(70).collect()
    mixed = " ".join(w for r in rows[:12] for w in (r.text or "").split()[:15])
    more = spark.createDataFrame([(10**6, mixed), (10**6 + 1, None), (10**6 + 2, "12 34"), (10**6 + 3, "x"), (10**6 + 4, "ab" * 300)], "doc_id long, text string")
    some = docs.filter(docs.doc_id.isin([r.doc_id for r in rows])).select("doc_id", "text").unionByName(more)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(some, field).collect()}
    for r in some.collect():
        label, share = plain_language(field, r.text)
        assert got[r.doc_id][0] == label and abs(got[r.doc_id][1] - share) < 1e-4, r.doc_id


def test_quality_is_the_softmax_of_the_mean_vector(spark, docs):
    model = quality.train(docs, table(spark, "/root/testdata/sf0.001", "labels"))
    more = spark.createDataFrame([(10**6, ""), (10**6 + 1, None), (10**6 + 2, "one"), (10**6 + 3, "é😀 " * 40), (10**6 + 4, "z" * 5000)], "doc_id long, text string")
    some = docs.select("doc_id", "text").limit(60).unionByName(more)
    got = {r.doc_id: r for r in quality.score(some, model).collect()}
    vectors, layer, bias = (x.astype(np.float64) for x in (model.vectors, model.layer, model.bias))
    for r in some.collect():
        words = (r.text or "").split()
        feats = [f for w in words for f in quality.word_features(w)] + [quality.REPEAT] * quality.repeats(words)
        hidden = vectors[feats].mean(0) if feats else np.zeros(vectors.shape[1])
        z = hidden @ layer + bias
        p = math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1]))
        assert abs(got[r.doc_id].score - p) < 1e-6 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_language_features_side_by_side():
    """Emission scores found for many words at once are those of one word at a time."""
    rnd = random.Random(4)
    crf = language_id.LanguageCrf(["a", "b", "c"], {"ab": (0, 2), "é": (1,), "x" * 64: (2,)})
    crf.emit[:] = np.random.default_rng(1).normal(size=crf.emit.shape)
    words = sorted({"".join(rnd.choice("abcxyzéßñ日本\U00020000") for _ in range(rnd.choice([1, 2, 3, 5, 9, 64]))) for _ in range(500)} | {"ab", "é", "x" * 64})
    memory = language_id._Emissions(crf)
    memory.learn([words[:10], [], words])
    assert len(memory) == len(words)
    for w in words:
        assert memory.table[memory[w]].tolist() == crf.emit[crf.features(w)].sum(0).tolist()


def test_quality_features_side_by_side():
    """Scores of words found together are those of one word at a time; long words are not kept."""
    rnd = random.Random(5)
    projection = np.random.default_rng(2).normal(size=quality.BUCKETS)
    words = sorted({"".join(rnd.choice("abcxyzéß日\U00020000<>") for _ in range(rnd.choice([1, 2, 3, 9, 64, 70, 300]))) for _ in range(400)})
    memory, single = quality._WordScores(projection), quality._WordScores(projection)
    memory.learn([words, words[:5], []])
    assert set(memory) == {w for w in words if len(w) <= quality.KEPT_WORD}
    for w in words:
        assert memory[w].imag == single[w].imag and abs(memory[w].real - single[w].real) < 1e-9
