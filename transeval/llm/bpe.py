"""BPE encoding by backtracking over longest matches, decoding by an offset table.

An Aho-Corasick automaton over all tokens lists, for each place of a word, the longest
token that starts there. The encoder walks the word with these matches; a token may follow
another only if the two are compatible, that is, if merging by rank would keep a token
border between them. Where no token fits it steps to the next shorter one, and where none
is left it goes back a token and marks the place as dead, so each place is given up at most
once and the work stays linear. The result is exactly that of merging by rank.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ALL, LATIN, category_ranges, reach, small_batches

#: Fixed values of the tokenizer format: the mark of a word's last piece, and the word
#: rule (contractions, letter runs, single numerals, runs of anything else).
END = "</w>"
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
         (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

#: What a worker remembers: words with their ids, and token pairs known to be compatible or not.
CACHE_WORDS, CACHE_PAIRS = 300_000, 300_000


@functools.cache
def word_pattern(limit: int = ALL) -> re.Pattern:
    """For texts of code points up to ``limit``."""
    letters, numbers = category_ranges("L", limit), category_ranges("N", limit)
    white = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in WHITE if b <= limit)
    return re.compile(f"{'|'.join(CONTRACTIONS)}|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+")


@functools.cache
def unassigned_pattern(limit: int) -> re.Pattern:
    return re.compile(f"[{category_ranges('Cn', limit)}]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand
    for themselves, the rest follow from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class BacktrackingBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._path, self._library = path, None
        alphabet = byte_alphabet()
        self._byte_of = {c: b for b, c in enumerate(alphabet)}
        # the last symbol of a word is a symbol of its own: moved to a private plane
        self._inner = alphabet
        self._last = [chr(0xF0000 + b) for b in range(256)]
        # tokens in rank order: the 512 single symbols, then one for each merge
        names = [*alphabet, *(c + END for c in alphabet)]
        keys = [*alphabet, *self._last]
        rank = {n: i for i, n in enumerate(names)}
        self.split = [(i, i) for i in range(512)]
        self.pairs: dict[int, int] = {}
        for m in merges:
            a, b = m if isinstance(m, list) else m.split(" ")
            ia, ib = rank[a], rank[b]
            if (a + b) in rank:
                raise ValueError(f"token {a + b!r} is made by two merges")
            rank[a + b] = i = len(names)
            names.append(a + b)
            keys.append(keys[ia] + keys[ib])
            self.split.append((ia, ib))
            self.pairs[ia << 32 | ib] = i
        self.ids = np.array([vocab[n] for n in names], np.int32)
        self.length = [len(k) for k in keys]
        by_key = {k: i for i, k in enumerate(keys)}
        self.prefix = [-1] * len(keys)
        automaton = ahocorasick.Automaton()
        for i, k in enumerate(keys):
            automaton.add_word(k, i)
            for n in range(len(k) - 1, 0, -1):
                if (p := by_key.get(k[:n])) is not None:
                    self.prefix[i] = p
                    break
        automaton.make_automaton()
        self._automaton = automaton
        self._compatible: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        # decoding: the bytes of all token strings, each with the blank that joins it to
        # the next, and where each id's bytes begin
        strings = {int(v): k.encode() for k, v in [*vocab.items(), *self.special.items()]}
        self._text = self._table([strings.get(i, b"") for i in range(max(strings) + 1)])
        self._decimal = self._table([str(i).encode() for i in range(max(strings) + 1)])

    @staticmethod
    def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        blob = np.frombuffer(b"".join(s + b" " for s in strings), np.uint8)
        return blob, np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])]).astype(np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` is what merging by rank gives: undo the
        later of the two merges step by step; no pair that meets at the border on the way
        may have a merge that would have come before the one undone."""
        key = left << 32 | right
        known = self._compatible.get(key)
        if known is not None:
            return known
        pairs, split, limit, ok = self.pairs, self.split, 1 << 31, None
        while ok is None:
            if pairs.get(left << 32 | right, limit) < limit:
                ok = False
            elif left > right:
                limit, left = left, split[left][1]
                if left == limit:
                    limit, right = right + 1, split[right][0]
                    if right + 1 == limit:
                        ok = True
            else:
                limit, right = right + 1, split[right][0]
                if right + 1 == limit:
                    limit, left = left, split[left][1]
                    if left == limit:
                        ok = True
        if len(self._compatible) >= CACHE_PAIRS:
            self._compatible.clear()
        self._compatible[key] = ok
        return ok

    def encode_word(self, raw: bytes) -> list[int]:
        """Ids of one word of the word rule, given as UTF-8."""
        text = "".join([self._inner[b] for b in raw[:-1]]) + self._last[raw[-1]]
        n = len(text)
        longest = [-1] * n
        lengths, prefix = self.length, self.prefix
        for end, token in self._automaton.iter(text):
            longest[end - lengths[token] + 1] = token  # matches come by their end, so the longest comes last
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else -1
            while True:
                end = pos + lengths[token]
                if alive[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    pos = end
                    token = longest[pos] if pos < n else -1
                    break
                if prefix[token] >= 0:
                    token = prefix[token]
                    continue
                alive[pos] = 0
                out.pop()
                pos -= lengths[last]
                token = last
                break
        return self.ids[out].tolist()

    def _split_by_library(self, text: str, out: list[bytes]) -> None:
        """For texts that normalisation changes, or with characters that Python's Unicode
        tables do not know: the tokenizer file's own normaliser and word rule, whose tables
        are of another Unicode version."""
        if self._library is None:
            self._library = Tokenizer.from_file(self._path)
        split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        for word, _ in split:
            out.append(np.array(self.encode_word(bytes(self._byte_of[c] for c in word)), np.int32).tobytes())

    def _plain(self, text: str, out: list[bytes]) -> None:
        limit = reach(text)
        if limit > LATIN and (not unicodedata.is_normalized("NFC", text) or unassigned_pattern(limit).search(text)):
            return self._split_by_library(text, out)
        # lower-casing goes character by character, without the rule for a final sigma
        text = text.replace("Σ", "σ").lower()
        words = self._words
        for w in word_pattern(reach(text)).findall(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= CACHE_WORDS:
                    words.clear()
                ids = np.array(self.encode_word(w.encode()), np.int32).tobytes()
                if len(w) <= 64:
                    words[w] = ids
            out.append(ids)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without special tokens of its own; special tokens written
        in the text keep their ids."""
        out: list[bytes] = []
        at = 0
        if self._special_re is not None and "<|" in text:
            for m in self._special_re.finditer(text):
                self._plain(text[at:m.start()], out)
                out.append(np.int32(self.special[m.group()]).tobytes())
                at = m.end()
        self._plain(text[at:], out)
        return np.frombuffer(b"".join(out), np.int32)

    @staticmethod
    def _join(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
        blob, offsets = table
        if not len(ids):
            return b""
        start = offsets[ids]
        size = offsets[ids.astype(np.int64) + 1] - start
        done = np.cumsum(size)
        return blob[np.repeat(start - done + size, size) + np.arange(done[-1])][:-1].tobytes()

    def decode(self, ids: np.ndarray, block: int = 1 << 16) -> bytes:
        """UTF-8 bytes of the token strings joined by blanks, special tokens included."""
        return b" ".join(self._join(self._text, ids[i:i + block]) for i in range(0, len(ids), block))

    def decimal(self, ids: np.ndarray, block: int = 1 << 16) -> bytes:
        return b" ".join(self._join(self._decimal, ids[i:i + block]) for i in range(0, len(ids), block))


@functools.lru_cache(maxsize=2)
def load(path: str) -> BacktrackingBpe:
    """One encoder for each Python worker and tokenizer file."""
    return BacktrackingBpe(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each whole text as an array column (null: no ids); a column
    of that name is replaced."""
    small_batches(docs.sparkSession)
    rest = docs.drop(ids_col)
    at = rest.columns.index(text_col)
    schema = rest.withColumn(ids_col, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = pa.array([bpe.encode(t or "") for t in b.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=schema.names)

    return rest.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of an id column (null: empty)."""
    rest = docs.drop(text_col)
    at = rest.columns.index(ids_col)
    schema = rest.withColumn(text_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            text = [bpe.decode(np.array(ids or [], np.int32)).decode("utf-8", "replace") for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=schema.names)

    return rest.mapInArrow(run, schema)


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, token_ids (if asked for), ids_sha256, decoded_sha256 of each row: each
    whole text is encoded and its ids decoded again in one pass. Null and empty texts have no
    tokens; rows that repeat come out as often. Other columns of ``docs`` are not read."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    empty = {"n_tokens": F.lit(0).cast("long"), "token_ids": F.array().cast("array<int>"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}
    if not with_ids:
        del empty["token_ids"]
    schema = rows.select("doc_id", *[v.alias(k) for k, v in empty.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            all_ids, written, decoded = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py())
                all_ids.append(ids)
                written.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            cols = [b.column(0), pa.array(list(map(len, all_ids)), pa.int64())]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(written, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``coded`` without the ids themselves."""
    return coded(docs, path, id_col, text_col, with_ids=False)
