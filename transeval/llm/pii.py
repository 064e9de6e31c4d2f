"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns of ``base_spans`` are always reported. The field adds spans, of their kinds and
of one more, ``secret``: its nodes are the tokens that hold a digit, an at sign (or one in
brackets) or a plus sign (all other tokens are known to be outside). Neighbouring nodes share a chain potential; nodes of one document whose tokens are
the same, or the same up to punctuation and case, share a skip potential with one hidden
node for all of them, so that any two are two steps apart and a label found for one is
carried to the others. Loopy message passing over both kinds of edges gives the label
probabilities; it goes on in each document until its messages stop changing, and a
document's edges are never cut.

The weights are learned here by gradient steps on the pseudo-likelihood, from a bounded sample
of texts whose pattern matches, and values assigned to a name such as ``token``, serve as
labels (distant supervision). Not to learn the patterns themselves, which are known,

* the evidence of a share of the mentions is hidden: their own features are left out, so that
  context, neighbours and other mentions must carry the label;
* each text is taken a second time with its mentions written another way, as patterns miss
  them: another check digit, no plus sign, points in brackets, an at sign spelt out;
* tokens that look like a mention but match no pattern are neither examples nor counterexamples;
* ordinary numbers (years, amounts, times, versions) are put between words as counterexamples.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, training_sample

#: Fixed values of the contract: the kinds in the order they are listed, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
#: All kinds of spans: those, and the one that the field alone finds.
SPAN_KINDS = [*KINDS, "secret"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@+]|[(\[]at[)\]]")
TOKEN = re.compile(r"\S+")
#: A value assigned to a name that tells it is secret.
SECRET = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[:=]\s*[\"']?([^\s\"',;]{8,})")

OUTSIDE = 0
K = 1 + len(SPAN_KINDS)
BUCKETS = 1 << 13
TRAIN_ROWS, TRAIN_CHARS = 2000, 6_000_000
EPOCHS, RATE, PENALTY = 60, 0.5, 1e-4
#: One mention in so many is trained on without its own features.
HIDDEN = 3
#: A token of so many digits that matches nothing is no counterexample.
NUMBER = 9
CERTAIN = 0.5
#: Messages move by this share of their change in a round, and have stopped when none moves
#: by STILL. Where the largest change has not fallen by a tenth in PATIENCE rounds, messages
#: swing around a loop: the share is lowered by SLOWER, so that each graph comes to rest.
STEP, STILL, PATIENCE, SLOWER = 0.7, 1e-5, 50, 0.7
#: Whole documents of about so many nodes in all are handled together; a longer one alone.
GRAPH_NODES = 1 << 15


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards so that long runs without one
    cost nothing: the part before it is the whole run of local characters there."""
    done, at = 0, text.find("@")
    local = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in local:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Each maximal dotted run of numbers is cut into matches of four from its left."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        start, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the contract's patterns, by kind and start."""
    if not HINT.search(text):
        return []
    out = [(0, a, z) for a, z in _emails(text)] if "@" in text else []
    out += [(1, a, z) for a, z in _ips(text)]
    for m in DIGIT_GROUPS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{SPAN_KINDS[k]}:{a}:{z}" for k, a, z in spans)


class Nodes:
    """The nodes of a text (their ends), with the tokens around each."""

    def __init__(self, text: str):
        self.spans: list[tuple[int, int]] = []
        self.around: list[tuple[str, str, str]] = []
        if not HINT.search(text):
            return
        tokens = TOKEN.findall(text)
        for i, m in enumerate(TOKEN.finditer(text)):
            if HINT.search(tokens[i]):
                self.spans.append(m.span())
                self.around.append((tokens[i - 2] if i > 1 else "", tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else ""))


def evidence(text: str) -> list[tuple[int, int, int]]:
    """The spans that training takes as mentions: base spans, and values assigned to a name
    that tells they are secret."""
    return base_spans(text) + [(4, *m.span(1)) for m in SECRET.finditer(text)]


def looks_like(token: str) -> bool:
    """Whether a token that matches nothing may be a mention all the same."""
    return sum(c.isdigit() for c in token) >= NUMBER or "@" in token or token.count(".") >= 3 or bool(re.search(r"[(\[]at[)\]]", token))


def other_form(kind: int, mention: str) -> str:
    """A mention as its pattern does not take it; which way follows from the mention."""
    way = crc32(mention.encode("utf-8", "surrogatepass"))
    if kind == 0:
        return mention.replace("@", ("(at)", "[at]", "@@")[way % 3])
    if kind == 1:
        return mention.replace(".", "[.]") if way % 2 else "300" + mention[mention.index("."):]
    if kind == 2:
        changed = mention[:-1] + str((int(mention[-1]) + 1 + way % 8) % 10)
        return re.sub("[ -]", (".", "_", " ")[way % 3], changed)
    if kind == 3:
        bare = mention[1:]
        return (bare, "00" + bare, re.sub("[ ()-]+", ".", bare).strip("."))[way % 3]
    return mention


def with_numbers(text: str, every: int = 12) -> str:
    """The text with an ordinary number after each so many words, between words that have no
    digit; which one follows from the word."""
    words = text.split(" ")
    out = []
    for i, w in enumerate(words):
        out.append(w)
        if i % every == every - 1 and not HINT.search(w) and not (i + 1 < len(words) and HINT.search(words[i + 1])):
            n = crc32(f"{w} {i}".encode("utf-8", "surrogatepass"))
            a, b = n % 97, n // 97 % 59
            forms = [str(a), str(1900 + a), f"{a}.{b}", f"{a % 24}:{b:02d}", f"{a}%", f"20{b:02d}-{a % 12 + 1:02d}-{b % 28 + 1:02d}", f"v{a % 10}.{b}.{a % 7}",
                     f"{a},{b:02d}0", f"({b})", f"{a}x", f"+{a}", f"${a}.{b:02d}", f"{a}{b:02d}{a % 10}", f"{1000 + n % 9000} {b}", f"A{b}", f"{a}/{b}"]
            out.append(forms[n // 5723 % len(forms)])
    return " ".join(out)


def rewritten(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with all its mentions in another form, and where these stand."""
    out, spans, done, size = [], [], 0, 0
    for kind, a, z in sorted(evidence(text), key=lambda x: (x[1], x[2])):
        if a < done:
            continue
        new = other_form(kind, text[a:z])
        out += [text[done:a], new]
        size += a - done
        spans.append((kind, size, size + len(new)))
        size += len(new)
        done = z
    return "".join([*out, text[done:]]), spans


def key_of(token: str) -> str:
    """Tokens with the same key are the same or similar: letters, digits and the at sign
    of the token in lower case; tokens with fewer than four of them have none."""
    key = re.sub(r"[^0-9a-z@]", "", token.lower())
    return key if len(key) >= 4 else ""


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "x", re.sub(r"[0-9]", "d", token)))


def node_features(token: str, around: tuple[str, str, str], hidden: bool = False) -> list[int]:
    """Numbers of a node's features; those of the token itself are ``BUCKETS``, which weighs
    nothing, where they are hidden."""
    before, left, right = around
    bare = token.strip(".,;:!?()[]{}<>\"'|*#$%&")
    digits = sum(c.isdigit() for c in token)
    word = re.sub(r"\W", "", left.lower()) or re.sub(r"\W", "", before.lower())
    own = [] if hidden else [
        f"shape {_shape(token)}", f"bare {_shape(bare)}", f"digits {min(digits, 24)}", f"length {min(len(bare), 40)}",
        f"at {token.count('@') > 0}", f"dots {min(bare.count('.'), 5)}", f"plus {bare[:1] == '+'}",
        f"first {bare[:2]}", f"last {_shape(bare[-3:])}", f"pair {_shape(left)} {_shape(bare)}", f"next {_shape(bare)} {_shape(right)}",
        f"long {min(len(bare) // 8, 8)} {min(digits // 4, 8)}"]
    names = [*own, f"left {_shape(left)}", f"right {_shape(right)}", f"word {word}", "bias"]
    return [BUCKETS] * (16 - len(names)) + [crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names]


def edges_of(keys: list[str], spans: list[tuple[int, int]], near: int = 40) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbouring nodes at most ``near`` characters apart, and skip
    edges from each node to the next one with its key, on which the skip potential is
    learned."""
    chain = [(i - 1, i) for i in range(1, len(spans)) if spans[i][0] - spans[i - 1][1] <= near]
    last: dict[str, int] = {}
    skip = []
    for i, key in enumerate(keys):
        if key:
            if key in last:
                skip.append((last[key], i))
            last[key] = i
    return chain, skip


def hubs_of(keys: list[str]) -> list[tuple[int, int]]:
    """Edges from a hidden node for each key of several nodes, numbered from 0, to these."""
    often = Counter(filter(None, keys))
    number = {key: h for h, key in enumerate(key for key, m in often.items() if m > 1)}
    return [(number[key], i) for i, key in enumerate(keys) if key in number]


class SkipChainCrf:
    def __init__(self) -> None:
        self.unary = np.zeros((BUCKETS + 1, K))  # the last row stays zero
        self.chain = np.zeros((K, K))
        self.skip = np.zeros((K, K))

    @staticmethod
    def graph(texts: list[str], parsed: list[Nodes], hubs: bool = False, hidden: set[tuple[int, int]] = frozenset()
              ) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes (text number, start, end), their features, the text of each node, and the
        chain and skip edges of many texts together. With ``hubs`` skip edges start at the
        hidden nodes of the keys, which are numbered after all others. The own features of
        the nodes (text number, start) in ``hidden`` are left out."""
        nodes, feats, chain, skip, owner, above = [], [], [], [], [], []
        for i, (t, found) in enumerate(zip(texts, parsed, strict=True)):
            spans = found.spans
            keys = [key_of(t[a:z]) for a, z in spans]
            c, s = edges_of(keys, spans)
            n, h = len(nodes), len(above)
            chain += [(a + n, z + n) for a, z in c]
            if hubs:
                s = hubs_of(keys)
                above += [i] * (max((a for a, _ in s), default=-1) + 1)
            skip += [(a + (h if hubs else n), z + n) for a, z in s]
            nodes += [(i, a, z) for a, z in spans]
            owner += [i] * len(spans)
            feats += [node_features(t[a:z], near, (i, a) in hidden) for (a, z), near in zip(spans, found.around, strict=True)]
        e = lambda x: np.array(x, np.int64).reshape(-1, 2)
        first = np.array([len(nodes) if hubs else 0, 0])
        return nodes, np.array(feats, np.int64), np.array(owner + above, np.int64), e(chain), e(skip) + first

    def fit(self, texts: list[str]) -> SkipChainCrf:
        texts = [with_numbers(t) for t in texts]
        known = [evidence(t) for t in texts]
        again = [rewritten(t) for t, spans in zip(texts, known, strict=True) if spans]
        texts, known = texts + [t for t, _ in again], known + [spans for _, spans in again]
        parsed = [Nodes(t) for t in texts]
        label: dict[tuple[int, int], int] = {}
        unsure, hidden = set(), set()
        for i, (t, found, spans) in enumerate(zip(texts, parsed, known, strict=True)):
            for a, z in found.spans:
                kind = next((k for k, s, e in spans if s < z and a < e), None)
                if kind is not None:
                    label[i, a] = kind + 1
                    if crc32(f"{t[a:z]} {a}".encode("utf-8", "surrogatepass")) % HIDDEN == 0:
                        hidden.add((i, a))
                elif looks_like(t[a:z]):
                    unsure.add((i, a))
        nodes, feats, _, chain, skip = self.graph(texts, parsed, hidden=hidden)
        if not nodes:
            return self
        y = np.array([label.get((i, a), OUTSIDE) for i, a, _ in nodes], np.int64)
        sure = np.array([(i, a) not in unsure for i, a, _ in nodes])
        # what is not sure tells its neighbours nothing
        chain, skip = (e[sure[e].all(1)] for e in (chain, skip))
        hot = np.eye(K)[y]
        # mentions are rarer than other nodes: a kind weighs as much as half of these at least
        often = np.bincount(y, sure, K)
        weight = sure * np.maximum(1, often[OUTSIDE] / 2 / often.clip(1))[y]
        weight /= weight.sum().clip(1)
        sums = [np.full_like(m, 1e-2) for m in (self.unary, self.chain, self.skip)]
        for _ in range(EPOCHS):
            z = self.unary[feats].sum(1)
            for edges, m in ((chain, self.chain), (skip, self.skip)):
                np.add.at(z, edges[:, 1], m[y[edges[:, 0]]])
                np.add.at(z, edges[:, 0], m.T[y[edges[:, 1]]])
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            d = (p - hot) * weight[:, None]
            gu = np.stack([np.bincount(feats.reshape(-1), np.repeat(d[:, k], feats.shape[1]), BUCKETS + 1) for k in range(K)], 1)
            gu[BUCKETS] = 0
            grads = [gu]
            for edges in (chain, skip):
                grads.append(hot[edges[:, 0]].T @ d[edges[:, 1]] + (hot[edges[:, 1]].T @ d[edges[:, 0]]).T)
            grads[2] = (grads[2] + grads[2].T) / 2  # mentions have no order
            for m, g, total in zip((self.unary, self.chain, self.skip), grads, sums, strict=True):
                g += PENALTY / len(nodes) * m
                total += g * g
                m -= RATE * g / np.sqrt(total)
        return self

    def marginals(self, feats: np.ndarray, chain: np.ndarray, skip: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities by damped sum-product messages along both kinds of edges, until
        the messages of each graph stop changing. ``owner`` numbers the graph of each node
        (None: all are one); what one graph gets does not depend on the others. Edges may
        name nodes beyond ``feats``, which are hidden ones without features."""
        n = max([len(feats), *(int(e.max()) + 1 for e in (chain, skip) if len(e))])
        u = np.concatenate([self.unary[feats].sum(1), np.zeros((n - len(feats), K))])
        src = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        dst = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        c, s = len(chain), len(skip)
        back = np.concatenate([np.arange(c, 2 * c), np.arange(c), np.arange(2 * c + s, 2 * c + 2 * s), np.arange(2 * c, 2 * c + s)])
        message = np.zeros((len(src), K))
        ends = np.array([0, c, 2 * c, 2 * c + s, 2 * c + 2 * s])
        weights = [np.exp(w - w.max()) for w in (self.chain, self.chain.T, self.skip, self.skip.T)]
        graph = (np.zeros(n, np.int64) if owner is None else owner)[src]
        count = int(graph.max()) + 1 if len(graph) else 0
        step, best, waited = np.full(count, STEP), np.full(count, np.inf), np.zeros(count, np.int64)
        live = np.arange(len(src))  # the edges of graphs whose messages still change
        while len(live):
            d, g = dst[live], graph[live]
            belief = u + np.stack([np.bincount(d, message[live, k], n) for k in range(K)], 1)
            out = belief[src[live]] - message[back[live]]
            out = np.exp(out - out.max(1, keepdims=True))
            cuts = np.searchsorted(live, ends)
            new = np.log(np.concatenate([out[a:z] @ w for a, z, w in zip(cuts, cuts[1:], weights, strict=False)]))
            new -= new.max(1, keepdims=True)
            new -= message[live]
            change = np.zeros(count)
            np.maximum.at(change, g, np.abs(new).max(1))
            message[live] += step[g, None] * new
            fell = change < 0.9 * best
            best, waited = np.where(fell, change, best), np.where(fell, 0, waited + 1)
            late = waited >= PATIENCE
            step, waited = np.where(late, step * SLOWER, step), np.where(late, 0, waited)
            live = live[(change * step >= STILL)[g]]
        belief = u + np.stack([np.bincount(dst, message[:, k], n) for k in range(K)], 1) if len(src) else u
        p = np.exp(belief - belief.max(1, keepdims=True))
        return (p / p.sum(1, keepdims=True))[:len(feats)]

    def added_spans(self, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """What the field finds beside the base spans of each text: nodes it labels, without
        the punctuation around them, that touch no base span; neighbouring phone nodes with
        only blanks, brackets, points or dashes between them make one span."""
        out: list[list[tuple[int, int, int]]] = []
        parsed = [Nodes(t) for t in texts]
        lo, held = 0, 0
        for i, found in enumerate(parsed):
            n = len(found.spans)
            if held and held + n > GRAPH_NODES:
                out += self._added(texts[lo:i], parsed[lo:i], bases[lo:i])
                lo, held = i, 0
            held += n
        return out + self._added(texts[lo:], parsed[lo:], bases[lo:])

    def _added(self, texts: list[str], parsed: list[Nodes], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        nodes, feats, owner, chain, skip = self.graph(texts, parsed, hubs=True)
        if not nodes:
            return out
        p = self.marginals(feats, chain, skip, owner)
        best = p.argmax(1)
        for j in np.flatnonzero((best != OUTSIDE) & (p.max(1) >= CERTAIN)):
            i, a, z = nodes[j]
            t, kind = texts[i], int(best[j]) - 1
            while a < z and not (t[a].isalnum() or t[a] in "+("):
                a += 1
            while z > a and not t[z - 1].isalnum():
                z -= 1
            if a == z or any(s < z and a < e for _, s, e in bases[i]):
                continue
            if kind == 3 and out[i] and out[i][-1][0] == 3 and t[out[i][-1][2]:a].strip(" ().-") == "":
                out[i][-1] = (3, out[i][-1][1], z)
            else:
                out[i].append((kind, a, z))
        return out


def train(docs: DataFrame, text_col: str = "text", max_rows: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS) -> SkipChainCrf:
    """Fitted on a hash-ordered sample of at most ``max_rows`` texts that hold a node; without
    any, all nodes stay outside."""
    rows = docs.select(F.col(text_col).alias("_text")).filter(F.col("_text").rlike(HINT.pattern))
    sample = training_sample(rows, "_text", [], max_rows, max_chars)
    return SkipChainCrf().fit([r["_text"] for r in sample])


def find(docs: DataFrame, crf: SkipChainCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, all
    spans as text, and how many the field added, for each row of ``docs``. Offsets are code
    points. Null and empty texts have no spans; other columns are not read; repeated rows
    come out as often."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    zero = F.lit(0).cast("long")
    schema = rows.select("doc_id", *[zero.alias(f"n_{k}") for k in KINDS], F.lit("").alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_added")).schema
    shared = spark.sparkContext.broadcast(crf)  # fixed size, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            bases = [base_spans(t) for t in texts]
            added = model.added_spans(texts, bases)
            counts = [pa.array([sum(s[0] == k for s in base) for base in bases], pa.int64()) for k in range(len(KINDS))]
            digest = [hashlib.sha256(render(base).encode()).hexdigest() for base in bases]
            spans = [render(sorted(base + more)) for base, more in zip(bases, added, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(list(map(len, added)), pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
