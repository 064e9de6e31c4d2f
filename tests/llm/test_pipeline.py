"""The pipeline against a plain version of each stage on its own input."""

import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from transeval.llm import language_id
from transeval.llm.common import table, written
from transeval.llm.queries import tokenizer_path

from test_scores import plain_posteriors


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in P.STAGES:
        df = written(stage(spark, docs, sf), name)
        out.append((name, docs, df))
        docs = df
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def test_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_language(spark, steps):
    _, before, after = steps[0]
    field, kept = language_id.train(before), set()
    for d, t in texts(before).items():
        found = language_id.words_of(t or "")
        if found and plain_posteriors(field, language_id.nodes_of(found)).max(1).mean() >= P.CLEAR:
            kept.add(d)
    assert set(texts(after)) == kept


def test_texts_that_mix_languages_stay(spark, sf):
    docs = table(spark, sf, "documents").filter("lang is not null and length(text) > 400")
    by_lang = {r.lang: r.text for r in docs.collect()}
    parts = [" ".join(t.split()[:60]) for _, t in sorted(by_lang.items())]
    assert len(parts) >= 3
    mixed = [(10**6 + k, " ".join(parts[:k])) for k in range(1, len(parts) + 1)] + [(10**7, "12 - 34 !"), (10**7 + 1, None)]
    rows = table(spark, sf, "documents").unionByName(
        spark.createDataFrame(mixed, "doc_id long, text string"), allowMissingColumns=True)
    left = {r.doc_id for r in P.language(spark, rows, sf).collect()}
    assert {d for d, _ in mixed if d < 10**7} <= left and not {10**7, 10**7 + 1} & left


def test_exact(steps):
    _, before, after = steps[1]
    best = {}
    for d, t in texts(before).items():
        k = re.sub("[A-Z]", lambda m: m.group().lower(), t)
        best[k] = max(d, best.get(k, -1))
    assert set(texts(after)) == set(best.values())


def test_near(steps):
    _, before, after = steps[2]
    rows = sorted(texts(before).items())
    sets = {d: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for d, t in rows if (w := words(t))}
    root = {d: d for d, _ in rows}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert set(texts(after)) == {d for d, r in root.items() if d == r}


def test_decontaminate(spark, sf, steps):
    _, before, after = steps[3]
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    lengths = {len(x) for x in windows}
    kept = set()
    for d, t in texts(before).items():
        w, hit = words(t), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.add(d)
    assert set(texts(after)) == kept


def test_tokens(steps):
    _, before, after = steps[4]
    lib, want = Tokenizer.from_file(tokenizer_path()), texts(before)
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == set(want)
    for d, t in list(want.items())[:50]:
        assert got[d].token_ids == lib.encode(t, add_special_tokens=False).ids and got[d].n_tokens == len(got[d].token_ids)


def test_run_on_odd_rows(spark, odd_docs, tmp_path, sf):
    d = str(tmp_path)
    odd_docs.write.parquet(f"{d}/documents.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{d}/benchmark.parquet")
    got = [r.doc_id for r in P.run(spark, d).collect()]
    assert len(got) == len(set(got)) and {5, 17} <= set(got) and not {1, 2, 3, 8, 14, None} & set(got)


def test_run_on_no_rows(spark, no_docs, tmp_path, sf):
    d = str(tmp_path)
    no_docs.write.parquet(f"{d}/documents.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{d}/benchmark.parquet")
    assert P.run(spark, d).collect() == []


def test_ids_that_rows_share(spark, tmp_path, sf):
    """Null ids and ids with two texts: only the row that is a copy, or contaminated, goes."""
    bench = next(r.text for r in table(spark, sf, "benchmark").collect() if len(words(r.text)) >= 13)
    base = [f"word{i} next{i * 7 % 13}" for i in range(60)]
    a, near_a = " ".join(base), " ".join([*base[:-1], "another end"])
    b, near_b = " ".join(base[::-1]), " ".join([*base[::-1][:-1], "another end"])
    rows = [(None, a), (None, near_a), (None, "a text of its own, far from all others here"), (3, b), (None, near_b), (3, "an other text of three"),
            (5, "one more text without a copy"), (5, bench), (None, bench + " "), (None, None), (None, ""), (7, "!!"), (7, "!!")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def left(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    got = left(P.near(spark, docs, sf))
    # one of the two null ids that are near to each other stays, and of the others all
    gone = [r for r in rows if r not in got]
    assert (None, near_b) in gone and len(got) == len(rows) - 3 and ((None, a) in gone) != ((None, near_a) in gone)
    assert {(5, bench), (None, bench + " ")} & set(gone) == {(None, bench + " ")}
    assert left(P.decontaminate(spark, docs, sf)) == sorted([r for r in rows if bench not in (r[1] or "")], key=repr)
