"""Suffix sorting in two stages, on arrays.

A suffix is small if it is less than the suffix that starts one place later. Only small
suffixes are sorted directly; each other suffix is placed by one scan over the buckets of
first symbols in ascending order: whenever a suffix has been placed, the suffix that starts
one place earlier, if not small, takes the next free place at the front of its own bucket.
Every step of the scan handles a whole bucket, or the part of it that its own suffixes have
brought in, at once.

The text is several strings, each ended by the symbol 0; strings are never compared beyond
their ends, and ends are in the order of their places.
"""

from __future__ import annotations

import numpy as np

#: Symbols packed into one 64-bit sort key, of nine bits each (256 bytes and the end).
PACK, SYMBOL_BITS = 7, 9


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the strings (bytes plus one), each followed by 0, and where each starts."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    starts = np.cumsum(sizes) - sizes
    symbols = np.zeros(int(sizes.sum()), np.int16)
    inside = np.ones(len(symbols), bool)
    inside[starts + sizes - 1] = False
    symbols[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    return symbols, starts


def small_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Marks suffixes less than their successors. In a run of one symbol all suffixes are
    like the last, which the symbol after the run decides. Ends are not marked."""
    n = len(symbols)
    nxt = np.append(symbols[1:], -1)
    last = symbols != nxt
    at = np.flatnonzero(last)
    small = symbols[at] < nxt[at]
    out = small[np.searchsorted(at, np.arange(n))]
    return out & (symbols > 0)


def _sort_directly(symbols: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the suffixes there, compared over ``depth`` symbols or to
    their ends: groups of equal prefixes are split by the next packed symbols until no group
    is left or the depth is reached. Equal ones stay in the order given."""
    padded = np.concatenate([symbols, np.zeros(PACK, symbols.dtype)])
    keys = np.zeros(len(symbols), np.int64)
    for j in range(PACK):
        keys = (keys << SYMBOL_BITS) | padded[j:j + len(symbols)]
    # nothing after an end counts
    ended = symbols == 0
    until = np.full(len(symbols), PACK, np.int64)
    ends = np.flatnonzero(ended)
    gap = ends[np.minimum(np.searchsorted(ends, np.arange(len(symbols))), len(ends) - 1)] - np.arange(len(symbols))
    until = np.minimum(until, np.maximum(gap, 0))
    keys >>= SYMBOL_BITS * (PACK - until)
    keys <<= SYMBOL_BITS * (PACK - until)
    order = places[np.argsort(keys[places], kind="stable")]
    first = keys[order]
    lo = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(order) else np.empty(0, np.int64)
    group = np.repeat(lo, np.diff(np.r_[lo, len(order)]))
    done = PACK
    live = np.arange(len(order))
    while done < depth and len(live):
        size = np.bincount(group[live], minlength=len(order))
        at = order[live] + done
        # a group is open while it has several members that reach beyond what was compared
        open_ = (size[group[live]] > 1) & (gap[order[live]] >= done)
        live, at = live[open_], at[open_]
        if not len(live):
            break
        k = keys[np.minimum(at, len(symbols) - 1)]
        g = group[live]
        by = np.lexsort((k, g))
        order[live] = order[live][by]
        k, g = k[by], g[by]
        new = np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])]
        starts = np.flatnonzero(new)
        group[live] = live[starts][np.cumsum(new) - 1]
        done += PACK
    return order


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All places in the order of their suffixes as far as the first ``depth`` symbols tell;
    suffixes that agree so far are neighbours in some order."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    small = small_suffixes(symbols)
    direct = _sort_directly(symbols, np.flatnonzero(small), depth)
    alphabet = int(symbols.max()) + 1
    cut = np.searchsorted(symbols[direct], np.arange(alphabet + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    out = []

    def bring(found: np.ndarray, bucket: int) -> np.ndarray:
        """Hand the predecessors of ``found`` that are not small to their buckets; those
        of this very bucket are returned."""
        before = found[found > 0] - 1
        before = before[~small[before] & (symbols[before] >= max(bucket, 1))]
        mark = symbols[before]
        order = np.argsort(mark, kind="stable")
        mark, before = mark[order], before[order]
        here = before[:0]
        if not len(mark):
            return here
        starts = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
        for a, z in zip(starts, [*starts[1:], len(mark)], strict=True):
            if mark[a] == bucket:
                here = before[a:z]
            else:
                induced[mark[a]].append(before[a:z])
        return here

    for c in range(alphabet):
        if c == 0:
            ends = np.flatnonzero(symbols == 0)
            out.append(ends)
            bring(ends, 0)
            continue
        found = np.concatenate(induced[c]) if induced[c] else direct[:0]
        while len(found):
            out.append(found)
            found = bring(found, c)
        found = direct[cut[c]:cut[c + 1]]
        if len(found):
            out.append(found)
            bring(found, c)
        induced[c] = []
    return np.concatenate(out)


def agree(symbols: np.ndarray, places: np.ndarray, length: int, block: int = 1 << 15) -> np.ndarray:
    """For each place but the first: whether it has a common prefix of at least ``length``
    with the place before it. Each place has that many symbols before its string's end."""
    out = np.empty(max(0, len(places) - 1), bool)
    view = np.lib.stride_tricks.sliding_window_view(symbols, length) if len(symbols) >= length else None
    for a in range(0, len(out), block):
        z = min(len(out), a + block)
        rows = view[places[a:z + 1]]
        out[a:z] = (rows[1:] == rows[:-1]).all(1)
    return out
