"""The operators' inner methods against brute-force versions and the tokenizer library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from transeval.llm import bpe, exact_dedup, language_id, license_scan, near_join, pii, quality, suffix_dedup, suffix_sort
from transeval.llm.common import table
from transeval.llm.queries import tokenizer_path


def test_bpe_equals_library(spark, sf):
    path = tokenizer_path()
    lib, own = Tokenizer.from_file(path), bpe.load(path)
    random.seed(4)
    texts = [r.text for r in table(spark, sf, "documents").select("text").limit(60).collect()]
    texts += ["", "Σας ΟΔΟΣ", "a<|endoftext|>b <|startoftext|>", "don't I'LL we've", "½²Ⅷ٣", "日本語😀🏽", "x" * 700, "ᲊ Ᲊ꟎"]
    texts += ["".join(random.choice("abcdefghij '.!01éßñÉ ") for _ in range(random.randint(1, 30))) for _ in range(2000)]
    texts += ["".join(chr(random.choice([random.randint(1, 0x2FFF), random.randint(0xE000, 0x1FFFF)])) for _ in range(5)) for _ in range(500)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        ids = own.encode(t)
        assert ids.tolist() == want, t
        assert own.decode(ids).decode() == lib.decode(want, skip_special_tokens=False), t
        assert own.decimal(ids).decode() == " ".join(map(str, want))


def test_bpe_columns_round_trip(odd_docs):
    path = tokenizer_path()
    back = bpe.decode(bpe.encode(odd_docs, path), path)
    lib = Tokenizer.from_file(path)
    for r in back.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 63, n, np.uint64) % np.uint64(m) for n, m in ((500, 100), (0, 1), (300, 1 << 60), (700, 90))]
    filters = [exact_dedup.CountingQuotientFilter.of(p, np.ones(len(p), np.int64), 40) for p in parts]
    again = [exact_dedup.CountingQuotientFilter.from_row(*f.to_row(), 40) for f in filters]
    prints, counts = exact_dedup.CountingQuotientFilter.merge(again, 40).items()
    want = dict(zip(*np.unique(np.concatenate(parts), return_counts=True), strict=True))
    assert dict(zip(prints, counts, strict=True)) == want


def test_suffixes_in_order():
    random.seed(5)
    for n in range(200):
        strings = [bytes(random.choice(b"ab\x00\xffc" if n % 4 else b"a") for _ in range(random.randint(0, 25))) for _ in range(random.randint(1, 7))]
        symbols, _ = suffix_sort.joined(strings)
        order = suffix_sort.suffix_array(symbols, 100)
        ends = np.flatnonzero(symbols == 0)
        found = [tuple(symbols[i:ends[np.searchsorted(ends, i)]]) for i in order]
        assert sorted(order) == list(range(len(symbols))) and found == sorted(found)


def brute_bytes(docs):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0], x[1].encode())):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i:i + 100]
            gone[i:i + 100] |= w in seen
            seen.add(w)
        runs = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(b) else 0
        out[d] = (d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("many", [2000, 1])
def test_suffix_dedup_equals_brute_force(spark, many):
    """Also where each core with several pieces counts as one of very many."""
    random.seed(2)
    line = "x" * 99 + "y" * 100
    docs = [(i, random.choice(["a" * random.randint(90, 400), "ab" * random.randint(40, 200), line + str(i), "", "é" * random.randint(0, 90) + line[20:150] + str(i) * 9])) for i in range(60)]
    words = [f"w{i}" for i in range(60)]
    docs += [(100 + i, " ".join(random.choice(words[:4 + i % 5]) for _ in range(120))) for i in range(30)]
    got = {r[0]: tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), many_pieces=many).collect()}
    assert got == brute_bytes(docs)


def test_pii_base_equals_plain_patterns():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    checks = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")),
              lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    random.seed(3)
    for _ in range(20000):
        t = "".join(random.choice("a1.@+- 9(4%é") for _ in range(random.randint(1, 28)))
        want = [(k, *m.span()) for k, p in enumerate(patterns) for m in re.finditer(p, t) if checks[k](m.group())]
        assert pii.base_spans(t) == want, t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_skip_edges_carry_labels():
    """A token whose own features say little takes the label of its twin far away."""
    crf = pii.SkipChainCrf()
    crf.skip[3, 3] = crf.skip[0, 0] = 3.0
    feats = np.array([[1], [2]])
    crf.unary[1, 3], crf.unary[2, 0] = 6.0, 1.0
    none = np.empty((0, 2), np.int64)
    alone = crf.marginals(feats, none, none)
    tied = crf.marginals(feats, none, np.array([[0, 1]]))
    assert alone[1].argmax() == 0 and tied[1].argmax() == 3
    # on a tree message passing is exact
    joint = crf.unary[feats].sum(1)[0][:, None] + crf.skip + crf.unary[feats].sum(1)[1][None]
    p = np.exp(joint) / np.exp(joint).sum()
    assert np.allclose(tied[1], p.sum(0), atol=1e-3)


def test_one_mention_labels_all_others():
    """Fifty mentions of which the first alone has evidence; what else is in its document or
    in its batch changes nothing."""
    crf = pii.SkipChainCrf()
    crf.skip += 3 * np.eye(pii.K)
    text = "tel: 55x1234" + (" word" * 12 + " 55x1234") * 49
    crf.unary[zlib.crc32(b"left x:") % pii.BUCKETS, 4] = 12
    want = [(3, m.start(), m.end()) for m in re.finditer("55x1234", text)]
    assert crf.added_spans([text], [[]]) == [want]
    for n in (pii.GRAPH_NODES - 25, pii.GRAPH_NODES + 25):
        assert crf.added_spans(["1 " * n, text], [[], []])[1] == want
        first, rest = text[:12], text[12:]
        moved = [(k, a + 2 * n + 1, z + 2 * n + 1) if a else (k, a, z) for k, a, z in [(3, 0, 0), *want[1:]]][1:]
        assert crf.added_spans([first + " " + "1 " * n + rest], [[]])[0] == [want[0], *moved]


def test_messages_of_a_graph_with_loops_come_to_rest():
    """Also with potentials that make them swing, and whatever graphs are beside it."""
    rng = np.random.default_rng(8)
    crf = pii.SkipChainCrf()
    crf.unary[:8], crf.chain = rng.normal(size=(8, pii.K)), -4 * np.eye(pii.K)
    crf.skip = -4 * np.eye(pii.K)
    feats, chain = rng.integers(0, 8, (12, 2)), np.array([(i, i + 1) for i in range(11)])
    skip = np.array([(i, j) for i in range(12) for j in range(i + 2, 12)])
    alone = crf.marginals(feats, chain, skip)
    assert np.allclose(alone.sum(1), 1)
    both = crf.marginals(np.r_[feats, feats[:3]], np.r_[chain, [[12, 13]]], np.r_[skip, [[13, 14]]], np.r_[np.zeros(12, int), np.ones(3, int)])
    assert np.allclose(both[:12], alone)


def test_chain_posteriors_equal_enumeration():
    rng = np.random.default_rng(3)
    crf = language_id.LanguageCrf(["a", "b", "c"], {})
    crf.move, crf.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    e = rng.normal(size=(11, 3))
    first = np.zeros(11, bool)
    first[[0, 4, 5]] = True
    got = crf.posteriors(e, first)
    for a, z in ((0, 4), (4, 5), (5, 11)):
        total = np.zeros((z - a, 3))
        for path in np.ndindex(*[3] * (z - a)):
            s = crf.start[path[0]] + sum(e[a + t, y] for t, y in enumerate(path)) + sum(crf.move[x, y] for x, y in zip(path, path[1:], strict=False))
            for t, y in enumerate(path):
                total[t, y] += np.exp(s)
        assert np.allclose(got[a:z], total / total.sum(1, keepdims=True))


def test_all_letters_of_a_long_run_count():
    """A run of letters that begins and ends in one language and is in another between."""
    crf = language_id.LanguageCrf(["a", "b"], {})
    for i, gram in enumerate((b"aa", b"bb")):
        crf.emit[zlib.crc32(gram) % language_id.BUCKETS, i] = 1
    for n in (640, 1_000_000):
        text = "a" * 64 + "b" * n + "a" * 64
        [(lang, score, n_words, n_switches)] = language_id.label_texts(crf, [text], language_id._Emissions(crf))
        assert (lang, n_words, n_switches) == ("b", 1, 2) and score > 0.8
    pieces = language_id.nodes_of(["x" * 64, "abc" * 50, "y"])
    assert "".join(pieces) == "x" * 64 + "abc" * 50 + "y" and max(map(len, pieces)) == 64


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_quality_takes_all_of_a_long_token():
    rng = random.Random(6)
    for n, alphabet in ((201, "ab"), (700, "aé中😀"), (quality.BLOCK + 1, "abc"), (2 * quality.BLOCK - 3, "a中"), (quality.BLOCK - 2, "xyz")):
        word = "".join(rng.choices(alphabet, k=n))
        assert sorted(np.concatenate(list(quality.feature_blocks(word)))) == sorted(quality.word_features(word))
    # what lies in the middle of a token decides its score
    good, bad = "ab" * 150, "xy" * 150
    model = quality.SubwordClassifier().fit([good, bad] * 40, [1, 0] * 40)
    memory = quality._WordScores(model.projection()[0])
    mean = lambda w: memory[w].real / memory[w].imag
    outside = "ab" * 60
    assert mean(outside + "xy" * 3000 + outside) < 0 < mean(outside + "ab" * 3000 + outside)
    ids, share = quality.SubwordClassifier.bag(good, {})
    assert set(ids) == set(quality.word_features(good)) and np.isclose(share.sum(), 1)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.95


def test_pruning_never_drops_clear_pairs_and_verifies_exactly():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 62, 200, np.uint64) for _ in range(20)]
    sets = []
    for b in base:
        for share in (0, 4, 12, 30, 60):
            sets.append(np.unique(np.r_[b[share:], rng.integers(0, 1 << 62, share // 2, np.uint64)]))
    size = np.array(list(map(len, sets)))
    i, j = near_join.surviving_pairs(near_join.sketches(sets), None, size, None)
    jac = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if jac(sets[a], sets[b]) >= 0.8}
    assert want <= set(zip(i.tolist(), j.tolist(), strict=True))
    for ii, jj in ((i, j), np.triu_indices(len(sets), 1)):
        assert near_join.verified(sets, ii, jj).tolist() == [jac(sets[a], sets[b]) >= 0.8 for a, b in zip(ii, jj, strict=True)]


def test_near_join_with_blocks(spark):
    """A component of more sets than a block holds: links across blocks are all found."""
    random.seed(9)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        w = list(words)
        for k in range(i % 7):
            w[random.randrange(300)] = f"z{i}x{k}"
        docs.append((i, " ".join(w)))
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t in docs]
    linked = [[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=8).collect())
    root = list(range(60))
    for _ in range(60):
        root = [min(root[j] for j in range(60) if linked[i][j]) for i in range(60)]
    assert got == [(i, root[i], sum(linked[i]) - 1) for i in range(60)]


def test_near_join_of_repeated_rows_with_a_near_partner(spark):
    """The row of a set's smallest id is repeated, as it is or with an other text of the same
    set, and has a near, not equal, partner."""
    words = [f"w{i}" for i in range(100)]
    n, m = " ".join(words), " ".join([*words[:99], "other"])
    for again in (n, n.upper()):
        docs = spark.createDataFrame([(5, n), (5, again), (7, m), (9, "far from all of these texts")], "doc_id long, text string")
        got = sorted(tuple(r) for r in near_join.near_duplicates(docs).collect())
        assert got == [(5, 5, 2, 2), (5, 5, 2, 2), (7, 5, 1, 2), (9, 9, 1, 0)]
    # null ids all meet each other in the join
    docs = spark.createDataFrame([(None, n), (None, n), (None, m)], "doc_id long, text string")
    assert sorted(tuple(r)[2:] for r in near_join.near_duplicates(docs).collect()) == [(1, 2), (2, 2), (2, 2)]


def test_words_that_change_a_license(spark):
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    names = {"": "cc-by", "-NonCommercial": "cc-by-nc", "-ShareAlike": "cc-by-sa", "-NoDerivatives": "cc-by-nd", "-NonCommercial-ShareAlike": "cc-by-nc-sa",
             "-NonCommercial-NoDerivatives": "cc-by-nc-nd", "-NonCommercial-Other": "cc-by-nc", "-Non-Commercial": ""}
    texts = [(cc.format(x), label) for x, label in names.items()]
    texts += [("Licensed under CC BY-NC 4.0", "cc-by-nc"), ("Licensed under CC BY-NC-SA 4.0", ""), ("Sharealike is a word. " + cc.format("") + " and nc", "cc-by")]
    docs = spark.createDataFrame([(i if i else None, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id or 0: r for r in license_scan.scan(docs).collect()}
    assert [got[i].labels for i in range(len(texts))] == [label for _, label in texts]
    assert got[0].score == 1 and got[7].score < license_scan.ENOUGH


def test_marks_miss_no_fingerprint(spark):
    rng = np.random.default_rng(4)
    prints = rng.integers(-(1 << 63), 1 << 63, 3000, np.int64)
    marks = exact_dedup.marks_of(spark.createDataFrame([(int(p),) for p in prints], "print long"), 1 << 20)
    assert marks.has(prints).all() and sum(map(len, marks.segments.values())) == 1 << 17
    assert marks.has(rng.integers(-(1 << 63), 1 << 63, 3000, np.int64)).mean() < 0.01
    assert not exact_dedup.marks_of(spark.createDataFrame([], "print long")).has(prints).any()


def test_copies_are_combined_before_they_leave_a_task(spark):
    import pyarrow as pa
    rows = [(i if i % 7 else None, 5, "a copy" if i % 3 else "an other") for i in range(90)] + [(1, 6, "alone")]
    marks = exact_dedup.marks_of(spark.createDataFrame([(5,)], "print long"))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("doc_id", "print", "norm"), r)) for r in rows[a:a + 20]]) for a in range(0, len(rows), 20)]
    out = [r for b in exact_dedup._combined(iter(batches), marks) for r in b.to_pylist()]
    assert [(r["norm"], r["keep_id"], r["group_size"]) for r in out] == [("an other", 87, 30), ("a copy", 89, 60)]
    # where little is held, a text goes on in several rows
    small = [r for b in exact_dedup._combined(iter(batches), marks, 1) for r in b.to_pylist()]
    assert len(small) > 2 and sum(r["group_size"] for r in small) == 90 and max(r["keep_id"] for r in small) == 89
    assert {r.group_size for r in exact_dedup.exact_duplicates(spark.createDataFrame([(str(i), "same") for i in range(12)], "doc_id string, text string").repartition(5)).collect()} == {12}
