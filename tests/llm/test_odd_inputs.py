"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib

import pytest

from transeval.llm import bpe, decontamination, exact_dedup, language_id, license_scan, near_join, pii, quality, substring_dedup, suffix_dedup
from transeval.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word0 other0 word1 other7 word2 other14 word3 other21 word4 other28 word5 other4 word6 other11"), (2, None), (3, ""), (4, "one"), (4, "one")],
                                 "item_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def operators(bench):
    labels = bench.sparkSession.createDataFrame([(i, i % 2) for i in range(1, 19)] + [(4, None)], "doc_id long, quality int")
    return {
        "language": lambda d: language_id.identify(d, language_id.train(d)),
        "bpe": lambda d: bpe.digests(d, tokenizer_path()),
        "suffix": suffix_dedup.remove_repeats,
        "exact": exact_dedup.exact_duplicates,
        "license": license_scan.scan,
        "decontamination": lambda d: decontamination.contamination(d, bench),
        "pii": lambda d: pii.find(d, pii.train(d)),
        "substring": substring_dedup.remove_repeats,
        "near": near_join.near_duplicates,
        "quality": lambda d: quality.score(d, quality.train(d, labels)),
    }


NAMES = ["language", "bpe", "suffix", "exact", "license", "decontamination", "pii", "substring", "near", "quality"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(no_docs, bench, name):
    assert operators(bench)[name](no_docs).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_give_a_row_each(odd_docs, odd_rows, bench, name):
    got = rows(operators(bench)[name](odd_docs))
    # two operators take rows that repeat id and text as one document
    once = name in ("license", "decontamination")
    assert len(got) == len(odd_rows) - (1 if once else 0)
    assert {r[0] for r in got} == {r[0] for r in odd_rows}
    assert rows(operators(bench)[name](odd_docs)) == got


def test_exact_ties_and_null(odd_docs):
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(odd_docs).collect() if r.doc_id != 10}
    assert got[4].keep_id == got[5].keep_id == got[None].keep_id == 5 and got[4].group_size == 4
    assert got[5].kept and not got[4].kept and not got[None].kept
    assert got[1].keep_id == 2 and got[2].kept and got[1].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[12].keep_id == 12 and got[12].group_size == 2


def test_language_of_no_letters(odd_docs):
    got = {r.doc_id: r for r in language_id.identify(odd_docs, language_id.train(odd_docs)).collect() if r.doc_id != 10}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 8, 14))
    assert got[6].lang_pred == "en" and 0 <= got[6].score <= 1


def test_near_classes(odd_docs):
    got = {r.doc_id: r for r in near_join.near_duplicates(odd_docs).collect() if r.doc_id not in (10, None)}
    assert got[11].class_id == 10 and got[12].class_id == 10
    assert got[1].class_id == 1 and got[2].class_id == 2 and got[1].n_links == 0
    assert got[6].class_id == got[7].class_id == 6 and got[7].n_copies == 2 and got[7].n_links == 1


def test_contamination(odd_docs, bench):
    got = {r.doc_id: r for r in decontamination.contamination(odd_docs, bench).collect() if r.doc_id != 10}
    assert got[11].n_hit == 14 and got[11].n_items == 1 and got[11].contaminated
    assert got[15].contaminated and got[15].items_sha256 == hashlib.sha256(b"4").hexdigest()
    assert not got[1].contaminated and got[1].n_words == 0 and got[1].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_licenses(odd_docs):
    got = {r.doc_id: r for r in license_scan.scan(odd_docs).collect() if r.doc_id != 10}
    assert got[17].n_base == 3 and got[17].base_labels == "apache,gpl,mit" and (got[17].first_word, got[17].last_word) == (3, 9)
    assert got[4].n_base == 0 and got[4].first_word is None and got[4].labels == ""


def test_substring_same_id_removes_nothing(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text + " x " + text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(-1, 30, 0), (1, 30, 30), (1, 61, 60), (2, 30, 30)]


def test_no_labels_and_empty_text_score(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(odd_docs, quality.train(odd_docs, none)).collect()} == {0.5}
