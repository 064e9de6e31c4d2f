"""What the field finds beside the patterns: mentions written as patterns miss them, in texts it
was not fitted on."""

import re
import zlib

import pytest

from transeval.llm import pii
from transeval.llm.common import table


@pytest.fixture(scope="module")
def texts(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("text").collect()
    return [r.text for r in docs if r.text and pii.HINT.search(r.text)]


@pytest.fixture(scope="module")
def fitted(texts):
    return pii.SkipChainCrf().fit([t for t in texts if zlib.crc32(t.encode()) % 2])


@pytest.fixture(scope="module")
def held_out(texts):
    return [t for t in texts if not zlib.crc32(t.encode()) % 2]


def test_mentions_in_another_form_are_recovered(fitted, held_out):
    changed = [pii.rewritten(t) for t in held_out]
    out = fitted.added_spans([t for t, _ in changed], [pii.base_spans(t) for t, _ in changed])
    found, all_ = 0, 0
    for (t, spans), got in zip(changed, out, strict=True):
        for k, a, z in spans:
            if any(j == k and s < z and a < e for j, s, e in pii.base_spans(t)):
                continue  # still a pattern's
            all_ += 1
            found += any(j == k and s < z and a < e for j, s, e in got)
    assert all_ > 20 and found >= 0.9 * all_


def test_texts_without_a_mention_are_left_alone(fitted, held_out):
    plain = [t for t in held_out if not pii.evidence(t) and not any(pii.looks_like(x) for x in t.split())]
    out = fitted.added_spans(plain, [[] for _ in plain])
    assert len(plain) > 10 and sum(map(bool, out)) <= 0.02 * len(plain)


@pytest.mark.parametrize(("kind", "mention", "forms"), [
    (0, "a.b@c.de", {"a.b(at)c.de", "a.b[at]c.de", "a.b@@c.de"}), (1, "10.0.0.1", {"10[.]0[.]0[.]1", "300.0.0.1"}),
    (3, "+1 (555) 123-4567", {"1 (555) 123-4567", "001 (555) 123-4567", "1.555.123.4567"}), (4, "abc", {"abc"})])
def test_other_forms(kind, mention, forms):
    assert pii.other_form(kind, mention) in forms
    text, spans = pii.rewritten(f"é {mention}, and token: {'0a' * 9}")
    assert {text[a:z] for k, a, z in spans if k == kind} <= {*forms, "0a" * 9}


def test_another_check_digit():
    new = pii.other_form(2, "4111 1111 1111 1111")
    assert not pii.luhn(re.sub(r"\D", "", new)) and len(re.sub(r"\D", "", new)) == 16


def test_secrets_are_found_and_base_digests_stay(spark, texts):
    docs = spark.createDataFrame([(1, 'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" there'), (2, "nothing in 2024 or 17 of these"), (3, None)], "doc_id long, text string")
    field = pii.SkipChainCrf().fit(texts)
    got = {r.doc_id: r for r in pii.find(docs, field).collect()}
    assert got[1].spans == "secret:13:53" and got[1].n_added == 1 and got[1].n_email == got[1].n_card == 0
    assert got[2].spans == got[3].spans == "" and got[1].base_sha256 == got[3].base_sha256


def test_ordinary_numbers_are_left_alone(fitted):
    plain = ["It was in 2024, or 17 of them; at 10:45 on 2023-05-11 about 3,500 people (12 %) paid $4.50 for v1.2.3 of A4 and C++ 17.",
             "Chapter 3 has 120 pages, 45 more than the 1998 edition, and costs 19.99 or 25 with 7% tax."]
    assert fitted.added_spans(plain, [[], []]) == [[], []]
    text = pii.with_numbers("some words and more words of a text that goes on and on " * 20)
    assert len([w for w in text.split() if pii.HINT.search(w)]) > 10 and not pii.evidence(text)


def test_hidden_mentions_have_context_alone():
    some, none = pii.node_features("10.0.0.1", ("x", "from:", "ok")), pii.node_features("10.0.0.1", ("x", "from:", "ok"), hidden=True)
    assert len(some) == len(none) == 16 and set(none) - {pii.BUCKETS} < set(some) and none.count(pii.BUCKETS) == 12
