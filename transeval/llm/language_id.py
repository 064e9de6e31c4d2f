"""Language identification of code-switched text by a linear-chain conditional random field.

Each word of a text is a node labelled with a language. A word is a run of letters; one of
more than ``PIECE`` letters, as scripts without spaces have, is cut into consecutive pieces
that cover it, each a node of its own, so that every letter counts. A node's emission scores
are sums of learned weights of affix, character n-gram and lexicon features; neighbouring
nodes share a learned transition. Forward-backward gives each node's label probabilities; a
document's language is the label with the largest mean probability over its nodes.

Training uses a bounded sample of rows with a known language: a row's words carry its
language, and training chains are stitched from spans of several rows, so that transitions
between languages are seen and learned.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import category_ranges, fold, reach, small_batches, training_sample
from .crc import Joined

FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Bounds of the training sample: rows and characters of text in all.
TRAIN_ROWS, TRAIN_CHARS = 2000, 6_000_000
BUCKETS = 1 << 16
LEXICON_WORDS = 2000
CHAIN, BATCH, STEPS, RATE = 32, 192, 220, 0.25
#: Texts of more words are labelled as several chains.
LONGEST_CHAIN = 1 << 16
#: Letters of one node at most.
PIECE = 64
CACHE_WORDS = 250_000
#: Words whose emission scores are found together.
LEARNED = 1 << 13
AFFIXES, GRAMS = (1, 2, 3), (2, 3)


@functools.cache
def letters(limit: int) -> re.Pattern:
    """Runs of letters of texts whose code points reach up to ``limit``."""
    return re.compile(f"[{category_ranges('L', limit)}]+")


def words_of(text: str) -> list[str]:
    low = text.lower()
    return letters(reach(low)).findall(low)


def nodes_of(words: list[str]) -> list[str]:
    """The words, those of more than ``PIECE`` letters in pieces."""
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i:i + PIECE] for w in words for i in range(0, len(w), PIECE)]


class LanguageCrf:
    """``labels``: sorted languages; ``emit``: weights by feature bucket and label;
    ``move``: transition scores; ``start``: scores of a chain's first label; ``lexicon``:
    word -> the labels among whose most frequent training words it is."""

    def __init__(self, labels: list[str], lexicon: dict[str, tuple[int, ...]]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.emit, self.move, self.start = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k)

    def features(self, word: str) -> list[int]:
        marked = f"^{word}$"
        names = [f"p{n}{word[:n]}" for n in AFFIXES] + [f"s{n}{word[-n:]}" for n in AFFIXES]
        names += [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
        names += [f"lex{label}" for label in self.lexicon.get(word, ())]
        return [crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Sums of the weights of each word's ``features``, found side by side and added in
        their order."""
        joined = Joined(words, "^", "$")
        inner, end = joined.first + 1, joined.first + joined.size - 1
        found = [joined.crc(inner, np.minimum(inner + n, end), crc32(b"p%d" % n)) for n in AFFIXES]
        found += [joined.crc(np.maximum(end - n, inner), end, crc32(b"s%d" % n)) for n in AFFIXES]
        of_word, nth = [np.arange(len(words))] * len(found), [np.full(len(words), i) for i in range(len(found))]
        many = np.full(len(words), len(found))
        for n in GRAMS:
            word, i, at = joined.grams(n)
            found.append(joined.crc(at, at + n))
            of_word.append(word)
            nth.append(many[word] + i)
            many += np.maximum(joined.size - n + 1, 0)
        listed = [(i, many[i] + j, crc32(f"lex{label}".encode())) for i, w in enumerate(words) for j, label in enumerate(self.lexicon.get(w, ()))]
        if listed:
            for x, more in zip((of_word, nth, found), np.array(listed, np.int64).T, strict=True):
                x.append(more)
        # the words of the most features first, so those with an n-th feature are the first ones
        of_word, nth, found = np.concatenate(of_word), np.concatenate(nth), np.concatenate(found).astype(np.int64) % BUCKETS
        size = np.bincount(of_word, minlength=len(words))
        by_size = np.argsort(-size, kind="stable")
        rank = np.empty_like(by_size)
        rank[by_size] = np.arange(len(words))
        having = np.bincount(nth)
        start = np.cumsum(having) - having
        laid = np.empty_like(found)
        laid[start[nth] + rank[of_word]] = found
        total = np.zeros((len(words), self.emit.shape[1]), self.emit.dtype)
        for at, n in zip(start, having, strict=True):
            total[:n] += self.emit[laid[at:at + n]]
        return total[rank]

    def fit(self, rows: list[tuple[str, str]], seed: int = 11) -> LanguageCrf:
        """``rows``: (text, language)."""
        rng = np.random.default_rng(seed)
        number = {label: i for i, label in enumerate(self.labels)}
        known: dict[str, int] = {}
        docs, owner = [], []
        for text, label in rows:
            ids = np.array([known.setdefault(w, len(known)) for w in nodes_of(words_of(text))], np.int64)
            if len(ids):
                docs.append(ids)
                owner.append(number[label])
        feats = [self.features(w) for w in known]
        size = np.array([len(f) for f in feats])
        offset = np.concatenate([[0], np.cumsum(size)])
        flat = np.array([x for f in feats for x in f], np.int64)
        k = len(self.labels)
        of_label = defaultdict(list)
        for i, y in enumerate(owner):
            of_label[y].append(i)
        known_labels = sorted(of_label)
        grad_e, grad_t, grad_s = np.full((BUCKETS, k), 1e-2, np.float32), np.full((k, k), 1e-2), np.full(k, 1e-2)
        for _ in range(STEPS):
            # chains of spans: each has one to three spans of rows whose label is drawn evenly
            w, y = np.empty((BATCH, CHAIN), np.int64), np.empty((BATCH, CHAIN), np.int64)
            for b in range(BATCH):
                cuts = [0, *sorted(rng.choice(np.arange(1, CHAIN), rng.integers(0, 3), replace=False)), CHAIN]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    label = known_labels[rng.integers(len(known_labels))]
                    d = docs[of_label[label][rng.integers(len(of_label[label]))]]
                    at = rng.integers(max(1, len(d) - (z - a) + 1))
                    span = d[at:at + z - a]
                    w[b, a:z] = np.resize(span, z - a)
                    y[b, a:z] = label
            types, where = np.unique(w, return_inverse=True)
            n = size[types]
            cols = flat[np.repeat(offset[types] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            first = np.cumsum(n) - n
            score = np.add.reduceat(self.emit[cols], first, axis=0).astype(np.float64)
            e = score[where.reshape(-1)].reshape(BATCH, CHAIN, k)
            unary, pair = self._expected(e)
            hot = np.eye(k)[y]
            diff = (unary - hot).reshape(-1, k)
            per_type = np.zeros((len(types), k))
            for j in range(k):
                per_type[:, j] = np.bincount(where.reshape(-1), diff[:, j], len(types))
            spread = np.repeat(per_type, n, axis=0)
            g = np.stack([np.bincount(cols, spread[:, j], BUCKETS) for j in range(k)], 1).astype(np.float32) / BATCH
            seen = np.einsum("bti,btj->ij", hot[:, :-1], hot[:, 1:])
            gt, gs = (pair - seen) / BATCH, (unary[:, 0] - hot[:, 0]).sum(0) / BATCH
            for value, grad, total in ((self.emit, g, grad_e), (self.move, gt, grad_t), (self.start, gs, grad_s)):
                total += grad * grad
                value -= RATE * grad / np.sqrt(total)
        return self

    def _expected(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each node, and expected label pairs of all neighbours."""
        move, start = np.exp(self.move), np.exp(self.start)
        x = np.exp(e - e.max(2, keepdims=True))
        n = e.shape[1]
        a, b = np.empty_like(x), np.ones_like(x)
        a[:, 0] = x[:, 0] * start
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for t in range(1, n):
            a[:, t] = (a[:, t - 1] @ move) * x[:, t]
            a[:, t] /= a[:, t].sum(1, keepdims=True)
        pair = np.zeros_like(self.move)
        for t in range(n - 2, -1, -1):
            back = x[:, t + 1] * b[:, t + 1]
            joint = a[:, t, :, None] * move * back[:, None, :]
            pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b[:, t] = back @ move.T
            b[:, t] /= b[:, t].sum(1, keepdims=True)
        p = a * b
        return p / p.sum(2, keepdims=True), pair

    def posteriors(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Exact label probabilities of the words of many chains laid end to end. ``first``
        marks the first word of each chain. The words are cut into blocks whose products of
        transition matrices are made side by side; the blocks are then linked in order, and
        each block runs forward and backward from its known ends."""
        n, k = e.shape
        width = max(1, int(np.sqrt(n)))
        count = -(-n // width)
        pad = count * width - n
        x = np.exp(e - e.max(1, keepdims=True)).astype(np.float64)
        x = np.concatenate([x, np.ones((pad, k))]).reshape(count, width, k)
        f = np.concatenate([first, np.ones(pad, bool)]).reshape(count, width)
        move, start = np.exp(self.move), np.exp(self.start)

        def ahead(rows: np.ndarray, t: int) -> np.ndarray:
            """Rows of label weights carried over the step to column t."""
            out = rows @ move
            new = f[:, t]
            if new.any():
                out[new] = rows[new].sum(-1, keepdims=True) * start
            return out * (x[:, t, None, :] if rows.ndim == 3 else x[:, t])

        product = np.broadcast_to(np.eye(k), (count, k, k)).copy()
        for t in range(width):
            product = ahead(product, t)
            product /= product.sum((1, 2), keepdims=True)
        enter, leave = np.empty((count, k)), np.empty((count, k))
        v = np.full(k, 1 / k)
        for c in range(count):
            enter[c] = v
            v = v @ product[c]
            v /= v.sum()
        v = np.ones(k)
        for c in range(count - 1, -1, -1):
            leave[c] = v
            v = product[c] @ v
            v /= v.sum()
        out = np.empty((count, width, k))
        v = enter
        for t in range(width):
            v = ahead(v, t)
            v /= v.sum(1, keepdims=True)
            out[:, t] = v
        v = leave
        for t in range(width - 1, -1, -1):
            out[:, t] *= v
            back = x[:, t] * v
            new = f[:, t]
            v = back @ move.T
            if new.any():
                v[new] = 1.0
            v /= v.sum(1, keepdims=True)
        out = out.reshape(-1, k)[:n]
        return out / out.sum(1, keepdims=True)


class _Emissions(dict):
    """word -> row in a growing table of emission scores."""

    def __init__(self, crf: LanguageCrf):
        super().__init__()
        self._crf, self.table = crf, np.zeros((1024, len(crf.labels)), np.float32)

    def learn(self, texts: list[list[str]]) -> None:
        """Adds all words of ``texts`` that are not there yet."""
        new = list(set().union(*texts).difference(self))
        while len(self) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for i in range(0, len(new), LEARNED):
            some, at = new[i:i + LEARNED], len(self)
            self.table[at:at + len(some)] = self._crf.emissions(some)
            self.update(zip(some, range(at, at + len(some)), strict=True))


def label_texts(crf: LanguageCrf, texts: list[str], memory: _Emissions) -> list[tuple[str, float, int, int]]:
    """(language, mean probability, words, changes of language from node to node) of each
    text."""
    return [x[:4] for x in judged_texts(crf, texts, memory)]


def judged_texts(crf: LanguageCrf, texts: list[str], memory: _Emissions) -> list[tuple[str, float, int, int, float]]:
    """(language, mean probability, words, changes of language from node to node, mean
    probability of each node's own best language) of each text."""
    out: list[tuple[str, float, int, int, float]] = []
    held: list[list[str]] = []
    counts: list[int] = []

    def flush() -> None:
        sizes = np.array([len(h) for h in held])
        if sizes.sum():
            if len(memory) >= CACHE_WORDS:
                memory.clear()
            memory.learn(held)
            ids = np.fromiter(map(memory.__getitem__, chain.from_iterable(held)), np.int64, sizes.sum())
            e = memory.table[ids]
            first = np.zeros(len(ids), bool)
            start = np.cumsum(sizes) - sizes
            for s, n in zip(start, sizes, strict=True):
                first[s:s + n:LONGEST_CHAIN] = True
            p = np.concatenate([crf.posteriors(e[a:z], first[a:z]) for a, z in _cuts(first)])
            best = p.argmax(1)
        for s, n, many in zip(np.cumsum(sizes) - sizes, sizes, counts, strict=True):
            if not n:
                out.append((UNKNOWN, 0.0, 0, 0, 0.0))
                continue
            share = p[s:s + n].mean(0)
            i = int(share.argmax())
            out.append((crf.labels[i], float(min(1.0, share[i])), many, int((best[s + 1:s + n] != best[s:s + n - 1]).sum()),
                        float(min(1.0, p[s:s + n].max(1).mean()))))
        held.clear()
        counts.clear()

    total = 0
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        w = nodes_of(w)
        held.append(w)
        total += len(w)
        if total >= LONGEST_CHAIN:
            flush()
            total = 0
    flush()
    return out


def _cuts(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of whole chains of about LONGEST_CHAIN words."""
    starts = np.flatnonzero(first)
    a = 0
    for s, z in zip(starts, [*starts[1:], len(first)], strict=True):
        if z - a >= LONGEST_CHAIN:
            yield a, int(z)
            a = int(z)
    if a < len(first):
        yield a, len(first)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_rows: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS) -> LanguageCrf | None:
    """Fitted on a hash-ordered sample of at most ``max_rows`` rows with text and language
    outside the held-out fold; None where there is none."""
    rows = (docs.filter((fold(F.col(id_col), FOLDS) != HELD_OUT) & F.col(lang_col).isNotNull())
            .select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")))
    sample = [(r["_text"], r["_lang"]) for r in training_sample(rows, "_text", ["_id", "_lang"], max_rows, max_chars)]
    sample = [r for r in sample if words_of(r[0])]
    if not sample:
        return None
    labels = sorted({label for _, label in sample})
    frequent: dict[str, list[int]] = defaultdict(list)
    for i, label in enumerate(labels):
        counts = Counter(w for text, y in sample if y == label for w in nodes_of(words_of(text)))
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            frequent[w].append(i)
    return LanguageCrf(labels, {w: tuple(v) for w, v in frequent.items()}).fit(sample)


def with_language(docs: DataFrame, crf: LanguageCrf | None, lang: str, score: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the language of each text, as in ``identify``, and how sure the field is of
    its words as further columns, whose names it does not have yet. The latter is the mean
    probability of each word's own best language, so it is high for a text that mixes
    languages evenly as well, and low where words look like none."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = docs.withColumn(lang, F.lit("")).withColumn(score, F.lit(0.0)).schema
    at = docs.columns.index(text_col)
    shared = spark.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memory = _Emissions(model) if model else None
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            found = judged_texts(model, texts, memory) if model else [(UNKNOWN, 0.0, 0, 0, 0.0)] * len(texts)
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[4] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, crf: LanguageCrf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches of each row of ``docs``.

    A null text and one without letters are ``und`` with score 0; ties go to the language
    that sorts first; without a model every text is ``und``. ``n_words`` counts runs of
    letters, ``n_switches`` also sees a change inside a long one. Other columns of ``docs`` are
    not read; repeated rows come out as often."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
                         F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_switches")).schema
    shared = spark.sparkContext.broadcast(crf)  # fixed size, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memory = _Emissions(model) if model else None
        for b in batches:
            texts = b.column(2).to_pylist()
            found = label_texts(model, texts, memory) if model else [(UNKNOWN, 0.0, 0, 0)] * len(texts)
            cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                names=schema.names)

    return rows.mapInArrow(run, schema)
