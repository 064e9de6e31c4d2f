"""Quality classifier: supervised subword embeddings.

Each word of a text gives a hashed word feature and hashed character n-gram features; a word
bigram that repeats its word gives one feature for all such words. Each feature has a learned
vector. The mean of a document's feature vectors goes through a linear layer
with softmax; vectors and layer are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows. As the layer is linear, scoring a text only needs, for
each of its words, the sum of its features' projections and their number; both are kept for
words seen before.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, training_sample
from .crc import Joined, spans_crc

FOLDS = 5
#: Bounds of the training sample: rows and characters of text in all.
TRAIN_ROWS, TRAIN_CHARS = 3000, 10_000_000
BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 16, 6, 0.5
NGRAMS = (2, 3, 4)
#: N-grams of longer words are hashed by numpy, so many characters at a time.
LONG_WORD, BLOCK = 200, 1 << 16
CACHE_WORDS = 300_000
#: Words of more characters are not kept.
KEPT_WORD = 64
#: Words of texts that are scored together, and of these whose features are found together.
TOGETHER, LEARNED = 1 << 16, 1 << 13
THRESHOLD = 0.3


#: The feature of a word bigram whose second word is the first one again.
REPEAT = crc32(b"= =") % BUCKETS


def repeats(words: list[str]) -> int:
    """How many words are the same as the one before."""
    return sum(map(operator.eq, words[1:], words))


def word_features(word: str) -> list[int]:
    """Buckets of a word: the whole word, then its character n-grams between marks."""
    raw = word.encode("utf-8", "surrogatepass")
    out = [crc32(raw) % BUCKETS]
    marked = f"<{word}>"
    for n in NGRAMS:
        out += [crc32(marked[i:i + n].encode("utf-8", "surrogatepass"), n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def feature_blocks(word: str) -> Iterator[np.ndarray]:
    """The same as ``word_features``, in any order and in arrays of bounded size."""
    yield np.array([crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS])
    marked = f"<{word}>"
    for lo in range(0, len(marked), BLOCK):
        raw = np.frombuffer(marked[lo:lo + BLOCK + max(NGRAMS) - 1].encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters start, and the end
        for n in NGRAMS:
            count = min(BLOCK, len(ends) - n)
            if count <= 0:
                continue
            yield spans_crc(raw, ends[:count], ends[n:n + count], n).astype(np.int64) % BUCKETS


class SubwordClassifier:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.layer = np.zeros((DIM, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    @staticmethod
    def bag(text: str, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of a text and the share of each."""
        words = text.split()
        feats = [REPEAT] * repeats(words)
        long = np.zeros(BUCKETS, np.int64)
        for w in words:
            if len(w) > LONG_WORD:
                for f in feature_blocks(w):
                    long += np.bincount(f, minlength=BUCKETS)
                continue
            f = known.get(w)
            if f is None:
                f = known[w] = word_features(w)
            feats += f
        if long.any():
            long += np.bincount(np.array(feats, np.int64), minlength=BUCKETS)
            ids = np.flatnonzero(long)
            n = long[ids]
        else:
            ids, n = np.unique(np.array(feats, np.int64), return_counts=True)
        return ids, (n / max(1, n.sum())).astype(np.float32)

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> SubwordClassifier:
        known: dict[str, list[int]] = {}
        bags = [self.bag(t, known) for t in texts]
        del known
        rng = np.random.default_rng(seed)
        steps, done = epochs * len(bags), 0
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                ids, share = bags[i]
                lr = rate * (1 - done / steps)
                done += 1
                rows = self.vectors[ids]
                hidden = share @ rows
                z = hidden @ self.layer + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.layer @ p
                self.layer -= lr * np.outer(hidden, p)
                self.bias -= 0.1 * lr * p
                # a feature's vector is moved by its share, scaled up so that rare
                # features of long texts are learned as well
                self.vectors[ids] = rows - (lr * np.minimum(share * 50, 1.0))[:, None] * back
        return self

    def projection(self) -> tuple[np.ndarray, float]:
        """For each feature what it adds to the log odds of label 1, and the bias."""
        w = self.layer[:, 1] - self.layer[:, 0]
        return self.vectors.astype(np.float64) @ w.astype(np.float64), float(self.bias[1] - self.bias[0])


class _WordScores(dict):
    """word -> sum of its features' projections (real) and their number (imaginary)."""

    def __init__(self, projection: np.ndarray):
        super().__init__()
        self._projection = projection

    def __missing__(self, word: str) -> complex:
        if len(word) > LONG_WORD:
            return sum((complex(self._projection[f].sum(), len(f)) for f in feature_blocks(word)), 0j)
        f = word_features(word)
        v = complex(self._projection[f].sum(), len(f))
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= KEPT_WORD:
            self[word] = v
        return v

    def learn(self, texts: list[list[str]]) -> None:
        """Finds the features of all words of ``texts`` not seen before side by side."""
        if len(self) >= CACHE_WORDS:
            self.clear()
        new = [w for w in set().union(*texts).difference(self) if len(w) <= KEPT_WORD]
        for i in range(0, len(new), LEARNED):
            some = new[i:i + LEARNED]
            joined = Joined(some, "<", ">")
            whole = np.array([crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in some])
            total, many = self._projection[whole], np.ones(len(some))
            for n in NGRAMS:
                word, _, at = joined.grams(n)
                f = joined.crc(at, at + n, n) % BUCKETS
                total = total + np.bincount(word, self._projection[f], len(some))
                many += np.bincount(word, minlength=len(some))
            self.update(zip(some, (total + 1j * many).tolist(), strict=True))


def together(texts: pa.Array) -> Iterator[list[list[str]]]:
    """The words of each text, of consecutive texts of about ``TOGETHER`` words at a time."""
    some, total = [], 0
    for t in texts:
        some.append(t.as_py().split())
        total += len(some[-1])
        if total >= TOGETHER:
            yield some
            some, total = [], 0
    if some:
        yield some


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS) -> SubwordClassifier | None:
    """Fitted on a hash-ordered sample of at most ``max_rows`` labelled rows outside the
    held-out fold; None without any. Rows labelled more than once take the majority (1 on a
    tie); null labels are no labels."""
    spark = docs.sparkSession
    seen = (labels.filter((fold(F.col(id_col), FOLDS) != 0) & F.col("quality").isNotNull())
            .groupBy(id_col).agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
            .select(F.col(id_col).alias("_id"), "_label")
            .orderBy(F.xxhash64("_id"), "_id").limit(max_rows).collect())
    if not seen:
        return None
    ids = F.broadcast(spark.createDataFrame([(r["_id"], r["_label"]) for r in seen], "_id long, _label int"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id")
    sample = training_sample(rows, "_text", ["_id", "_label"], max_rows, max_chars)
    if not sample:
        return None
    return SubwordClassifier().fit([r["_text"] for r in sample], [r["_label"] for r in sample])


def score(docs: DataFrame, model: SubwordClassifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``. A null or empty text has
    no features and gets the score of the bias alone; without a model all scores are 0.5.
    Other columns of ``docs`` are not read; repeated rows come out as often."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), FOLDS) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    projection, bias = model.projection() if model else (np.zeros(BUCKETS), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(projection)  # fixed size, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, repeat = _WordScores(shared.value), float(shared.value[REPEAT])
        for b in batches:
            out = []
            for texts in together(b.column(2)):
                words.learn(texts)
                for tokens in texts:
                    again = repeats(tokens)
                    total = sum(map(words.__getitem__, tokens), complex(again * repeat, again))
                    out.append(bias + (total.real / total.imag if total.imag else 0.0))
            s = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)
