"""Spelling variants by finite-state composition.

Words are near if they differ by one inserted, deleted or replaced code point. The pairs of
near words are what the composition vocabulary acceptor, one-edit transducer, vocabulary
acceptor accepts.

1. The words of all texts are counted.
2. The composition is cut at its initial states. Either the first ``HEAD`` code points of two
   near words agree, or, with the edit among these, the last ``TAIL`` do. So each word goes to
   the state that its first code points lead to, and, read backwards, to the one that its last
   code points lead to; all near pairs share one of these initial states.
3. A task builds the minimised acceptor of the rest of its words: a tree by levels, whose
   states are merged from the leaves up where they accept the same. It composes this acceptor
   with the transducer and itself, level by level: a state of the composition is a pair of
   acceptor states and whether the edit has been made, and the edit is made where the two words
   differ first, so each pair is accepted by one path. The number of words accepted before an
   arc gives the word's own number, without spelling it out.
4. Pairs are summed up for each word before they leave the task.

Words of an initial state beyond ``BLOCK`` are dealt as pairs of blocks; a task then composes
the acceptor of one block with the transducer and the acceptor of the other.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, shuffle_partitions, written
from .near_join import dealt
from .shards import firsts

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: Of two near words of LEAST_LENGTH or more, the first HEAD or the last TAIL code points agree.
HEAD = LEAST_LENGTH // 2
TAIL = LEAST_LENGTH - HEAD
#: A form occurs at least so many times as often as its variant.
FORM_FACTOR = 10
#: One run in so many loses a code point.
DAMAGED = 31
BLOCK = 1 << 13
#: Words of the groups that share a task, about.
TASK_WORDS = 1 << 14
#: Counts are below 2^63 and each form occurs ten times as often, so no chain has more than 18
#: steps: five doublings lead to its end.
DOUBLINGS = 5


class Acceptor(NamedTuple):
    """A minimised acceptor with several initial states. Arcs are sorted by state and symbol;
    ``skipped`` counts the words of the state that come before the arc's."""
    initial: np.ndarray
    final: np.ndarray
    shortest: np.ndarray
    arcs_from: np.ndarray
    symbol: np.ndarray
    to: np.ndarray
    skipped: np.ndarray
    keys: np.ndarray
    symbols: int

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those given that have such an arc, and the arcs."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        want = states * self.symbols + symbols
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        ok = np.flatnonzero(self.keys[at] == want)
        return ok, at[ok]

    def arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of the states: place of the state, arc."""
        low, n = self.arcs_from[states], self.arcs_from[states + 1] - self.arcs_from[states]
        return repeated(low, n)


def repeated(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers low[i] to low[i] + n[i] - 1, beside i."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]


def minimised(words: list[str], group: np.ndarray) -> Acceptor:
    """The acceptor of sorted distinct words of each group (groups in ascending order), one
    initial state for each group. Words of a group are numbered in their order."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    known, flat = np.unique(flat, return_inverse=True)
    symbols = max(1, len(known))
    starts = np.cumsum(sizes) - sizes
    # the tree, level by level: words that share a node are next to each other
    node = group.astype(np.int64).copy()
    n_nodes = int(group.max()) + 1 if len(group) else 0
    parents, labels, firsts_of_level = [], [], [0]
    alive, depth = np.arange(len(words)), 0
    ends = [np.empty(0, np.int64)]
    while len(alive):
        done = sizes[alive] == depth
        ends.append(node[alive[done]])
        alive = alive[~done]
        if not len(alive):
            break
        c = flat[starts[alive] + depth]
        new = firsts(node[alive], c)
        firsts_of_level.append(n_nodes)
        parents.append(node[alive][new])
        labels.append(c[new])
        node[alive] = n_nodes + np.cumsum(new) - 1
        n_nodes += int(new.sum())
        depth += 1
    roots = firsts_of_level[1] if len(firsts_of_level) > 1 else n_nodes
    parent = np.concatenate([np.full(roots, -1), *parents]) if n_nodes else np.empty(0, np.int64)
    label = np.concatenate([np.zeros(roots, np.int64), *labels]) if n_nodes else np.empty(0, np.int64)
    ended = np.zeros(n_nodes, bool)
    ended[np.concatenate(ends)] = True
    # arcs in the order of their parents are the nodes below the roots in theirs
    bounds = [*firsts_of_level, n_nodes]
    height, accepted = np.zeros(n_nodes, np.int64), ended.astype(np.int64)
    for a, z in zip(bounds[-2:0:-1], bounds[:1:-1], strict=True):
        np.maximum.at(height, parent[a:z], height[a:z] + 1)
        np.add.at(accepted, parent[a:z], accepted[a:z])
    degree = np.bincount(parent[roots:], minlength=n_nodes) if n_nodes > roots else np.zeros(n_nodes, np.int64)
    child_from = np.cumsum(degree) - degree + roots
    # states from the leaves up: nodes of a height are one state if they end alike and their
    # arcs lead to the same states
    state = np.full(n_nodes, -1)
    register: dict[bytes, int] = {}
    sample: list[int] = []
    by_height = np.argsort(height, kind="stable")
    cuts = np.searchsorted(height[by_height], np.arange(int(height.max(initial=0)) + 2))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        nodes = by_height[a:z]
        i, child = repeated(child_from[nodes], degree[nodes])
        raw = np.stack([label[child], state[child]], 1).astype("<i8").tobytes()
        at = (np.r_[0, np.cumsum(degree[nodes])] * 16).tolist()
        for k, (x, end) in enumerate(zip(nodes.tolist(), ended[nodes].tolist(), strict=True)):
            key = (b"+" if end else b"-") + raw[at[k]:at[k + 1]]
            found = register.setdefault(key, len(sample))
            if found == len(sample):
                sample.append(x)
            state[x] = found
    of = np.array(sample, np.int64)
    n_arcs = degree[of] if len(of) else np.empty(0, np.int64)
    arcs_from = np.r_[0, np.cumsum(n_arcs)].astype(np.int64)
    i, child = repeated(child_from[of], n_arcs) if len(of) else (np.empty(0, np.int64), np.empty(0, np.int64))
    words_below = accepted[child]
    before = np.cumsum(words_below) - words_below
    skipped = before - before[np.minimum(arcs_from[i], max(len(before) - 1, 0))] + ended[of][i] if len(i) else np.empty(0, np.int64)
    shortest = np.zeros(len(of), np.int64)
    for s in range(len(of)):  # children come first
        a, z = arcs_from[s], arcs_from[s + 1]
        if not ended[of[s]]:
            shortest[s] = 1 + shortest[state[child[a:z]]].min()
    return Acceptor(state[:roots], ended[of], shortest, arcs_from, label[child], state[child], skipped, i * symbols + label[child], symbols)


def composed(m: Acceptor, left: np.ndarray, right: np.ndarray, edit_before: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Accepted pairs of the composition from each pair of initial states: the number of the
    pair of states, and the word's number in each. Where both states are one, each pair of
    words is given once. With ``edit_before``, only pairs whose common rest after the edit is
    shorter than that are looked for."""
    out = []
    one = left == right
    no = np.arange(len(left))
    p, q, u, v = left, right, np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    # after the edit
    p1 = q1 = u1 = v1 = no1 = np.empty(0, np.int64)

    def ended(who, a, b):
        out.append((who, a, b))

    while len(p) or len(p1):
        grown: list[tuple[np.ndarray, ...]] = []
        # the edit has been made: both read the same symbols
        if len(p1):
            both = m.final[p1] & m.final[q1]
            ended(no1[both], u1[both], v1[both])
            i, a = m.arcs(p1)
            ok, b = m.step(q1[i], m.symbol[a])
            i, a = i[ok], a[ok]
            grown.append((no1[i], m.to[a], m.to[b], u1[i] + m.skipped[a], v1[i] + m.skipped[b]))
        nxt = None
        if len(p):
            same = one[no]
            i, a = m.arcs(p)
            # one word ends where the other has one symbol more
            j, b = m.arcs(q)
            more = m.final[p][j] & m.final[m.to[b]]
            ended(no[j[more]], u[j[more]], v[j[more]] + m.skipped[b[more]])
            less = m.final[q][i] & m.final[m.to[a]] & ~same[i]
            ended(no[i[less]], u[i[less]] + m.skipped[a[less]], v[i[less]])
            ok, b = m.step(q[i], m.symbol[a])
            nxt = (no[i[ok]], m.to[a[ok]], m.to[b], u[i[ok]] + m.skipped[a[ok]], v[i[ok]] + m.skipped[b])
            # they read different symbols: every arc of one beside every arc of the other
            n_b = m.arcs_from[q + 1] - m.arcs_from[q]
            k, b = repeated(m.arcs_from[q][i], n_b[i])
            a, i = a[k], i[k]
            differ = m.symbol[a] != m.symbol[b]
            a, b, i = a[differ], b[differ], i[differ]
            pa_, qb, ua, vb, who = m.to[a], m.to[b], u[i] + m.skipped[a], v[i] + m.skipped[b], no[i]
            once = same[i]
            r = ~once | (m.symbol[a] < m.symbol[b])
            grown.append((who[r], pa_[r], qb[r], ua[r], vb[r]))
            # inserted into the first: the second reads the first's symbol next
            ok, c = m.step(qb, m.symbol[a])
            grown.append((who[ok], pa_[ok], m.to[c], ua[ok], vb[ok] + m.skipped[c]))
            # and the other way round, where the two acceptors are not one
            far = np.flatnonzero(~once)
            ok, c = m.step(pa_[far], m.symbol[b[far]])
            far = far[ok]
            grown.append((who[far], m.to[c], qb[far], ua[far] + m.skipped[c], vb[far]))
        no1, p1, q1, u1, v1 = (np.concatenate(x) for x in zip(*grown, strict=True)) if grown else (no1[:0],) * 5
        if edit_before is not None and len(p1):
            near = (m.shortest[p1] < edit_before) & (m.shortest[q1] < edit_before)
            no1, p1, q1, u1, v1 = (x[near] for x in (no1, p1, q1, u1, v1))
        if nxt is None or not len(nxt[0]):
            p = q = u = v = no = np.empty(0, np.int64)
        else:
            no, p, q, u, v = nxt
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def near_pairs(words: list[str], root: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of near words that share an initial state: the words of side 2 of a root
    among each other, those of side 0 with those of side 1. Positive roots lead forwards from
    the first HEAD code points, negative ones backwards from the last TAIL; of the latter, pairs
    whose first HEAD agree are left to the former."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for ahead in (True, False):
        at = np.flatnonzero((root >= 0) == ahead)
        if not len(at):
            continue
        rest = [words[i][HEAD:] if ahead else words[i][-TAIL - 1::-1] for i in at]
        order = sorted(range(len(at)), key=lambda k: (root[at[k]], side[at[k]], rest[k]))
        at = at[order]
        r, s = root[at], side[at]
        new = firsts(r, s)
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        m = minimised([rest[k] for k in order], group)
        r, s = r[begin], s[begin]
        own = np.flatnonzero(s == 2)
        cross = np.flatnonzero((s[:-1] == 0) & (s[1:] == 1) & (r[:-1] == r[1:]))
        for left, right in ((own, own), (cross, cross + 1)):
            if not len(left):
                continue
            no, u, v = composed_groups(m, left, right, None if ahead else HEAD + 1)
            i, j = at[begin[left[no]] + u], at[begin[right[no]] + v]
            if not ahead:
                heads = np.unique([w[:HEAD] for w in words], return_inverse=True)[1]
                apart = heads[i] != heads[j]
                i, j = i[apart], j[apart]
            found.append((i, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def composed_groups(m: Acceptor, left: np.ndarray, right: np.ndarray, edit_before: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return composed(m, m.initial[left], m.initial[right], edit_before)


NEAR = [("near_of", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("word", pa.string())]))]


def _summed(rows: pa.Table) -> pa.Table:
    """For each word of a task that has near words there: how many, and the first of them by
    count and spelling."""
    words, count = rows.column("node").to_pylist(), rows.column("n").to_numpy()
    i, j = near_pairs(words, rows.column("root").to_numpy(), rows.column("side").to_numpy())
    # a word stands in a task as often as it has groups there
    known, place = np.unique(np.array(words, object), return_inverse=True) if len(words) else (np.empty(0, object), np.empty(0, np.int64))
    n = np.zeros(len(known), np.int64)
    n[place] = count
    x, y = place[np.r_[i, j]], place[np.r_[j, i]]
    order = np.lexsort((y, -n[y], x))
    x, y = x[order], y[order]
    new = firsts(x)
    many = np.diff(np.r_[np.flatnonzero(new), len(x)])
    x, y = x[new], y[new]
    best = pa.StructArray.from_arrays([pa.array(-n[y], pa.int64()), pa.array(known[y].tolist(), pa.string())], names=["less", "word"])
    return pa.table([pa.array(known[x].tolist(), pa.string()), pa.array(many, pa.int64()), best], names=[n for n, _ in NEAR])


def damaged(word: Column, doc_id: Column) -> Column:
    """The word, for one in ``DAMAGED`` without the code point that its hash tells."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    k = (h % F.length(word)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(word, F.lit(1), k), F.substring(word, k + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of at least LEAST_LENGTH code points that occur LEAST_COUNT times."""
    # a shorter run gives no word, with or without a code point less
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    found = docs.select(F.col(id_col).alias("_doc"), F.explode(runs).alias("_run"))
    lower = F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", UPPER, LOWER)).otherwise(F.col("_run"))
    words = found.select("_doc", lower.alias("_run")).select(damaged(F.col("_run"), F.col("_doc")).alias("word"))
    return (words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= LEAST_COUNT))


def near_words(vocab: DataFrame, words: int, block: int = BLOCK) -> DataFrame:
    """near_of, n_near, best (less: minus its count, word): of each word that has near words
    how many there are, and the first of them by count and spelling."""
    spark = vocab.sparkSession
    # the sign of the number of an initial state tells its direction
    state = F.xxhash64("side_", "text_").bitwiseAND(F.lit((1 << 62) - 1))
    entries = F.array(F.struct(F.lit(0).alias("side_"), F.substring("word", 1, HEAD).alias("text_")),
                      F.struct(F.lit(1).alias("side_"), F.substring("word", -TAIL, TAIL).alias("text_")))
    members = (vocab.select(F.col("word").alias("node"), "n", F.explode(entries).alias("e")).select("node", "n", "e.*")
               .select("node", "n", F.when(F.col("side_") == 0, state).otherwise(-1 - state).alias("root")))
    bins = max(2 * words // TASK_WORDS, min(shuffle_partitions(spark), words // 256), 1)
    tasks = dealt(members, "root", bins, block).select("task", "side", "root", "node", "n")
    # the work does not show in the bytes, so tasks are as many as the groups they are dealt to
    return (tasks.repartition(max(1, min(bins, 20_000)), "task").groupBy("task")
            .applyInArrow(_summed, "near_of string, n_near long, best struct<less:long,word:string>")
            .groupBy("near_of").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of a word (word, form) lead in the end."""
    step = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        further = step.select(F.col("word").alias("w_"), F.col("root").alias("r_"))
        step = step.join(further, F.col("root") == F.col("w_"), "left").select("word", F.coalesce("r_", "root").alias("root"))
    return step


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``docs``.

    Words are the runs of letters of all texts, lower-cased in A-Z, one in 31 of them without
    a code point, that are at least 7 code points long and occur at least twice. A word's form
    is its near word of the largest ``n`` (ties: the smallest), if that is at least 10 times
    its own; ``root`` is where forms lead. Null and empty texts have no words; a null id counts
    as empty text in the hash that damages a run; rows that repeat are counted again. Other
    columns of ``docs`` are not read.
    """
    vocab = written(vocabulary(docs, id_col, text_col), "vocabulary")
    near = near_words(vocab, vocab.count(), block)
    is_form = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    formed = written(vocab.join(near, F.col("word") == F.col("near_of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.filter(F.col("form").isNotNull()).select("word", "form")).withColumnRenamed("word", "w_")
    return formed.join(ends, F.col("word") == F.col("w_"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
