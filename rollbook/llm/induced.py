"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are smaller (S) or larger (L) than the one behind them.  An S suffix behind an L one is a
leftmost-smaller one (LMS).  LMS substrings are sorted by one round of inducing and named, the string of their
names is sorted recursively where names repeat, and from the order of LMS suffixes that of all others is induced:
L suffixes in a pass from the left, S suffixes in one from the right.  Both passes touch every suffix once.

Strings over few symbols are induced a bucket at a time in numpy; names, of which there
are many, in lists.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
FEW = 512


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of ``s`` (symbols from 0 on) in order; the end counts as smaller than any symbol."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = _types(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    ends = np.cumsum(np.bincount(s))
    induce = _by_bucket if len(ends) <= FEW else _by_symbol
    if len(lms) > 1:
        order = induce(s, small, ends, lms[np.argsort(s[lms], kind="stable")])
        order = order[is_lms[order]]
        names = _names(s, lms, order)
        if names.max() + 1 == len(lms):
            lms = order
        else:
            lms = lms[suffix_array(names)]
    return induce(s, small, ends, lms)


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; equal symbols are of the type of what follows them, the last suffix is L."""
    n = len(s)
    rises = np.zeros(n, bool)
    rises[:-1] = s[:-1] < s[1:]
    differs = np.full(n, n - 1)
    differs[:-1] = np.where(s[:-1] != s[1:], np.arange(n - 1), n - 1)
    return rises[np.minimum.accumulate(differs[::-1])[::-1]]


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, in text order; equal ones share a rank."""
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    one, two = order[:-1], order[1:]
    same = (length[one] == length[two]) & (length[one] > 0) & (length[two] > 0)
    pairs, step = np.flatnonzero(same), 0
    while len(pairs):
        equal = s[one[pairs] + step] == s[two[pairs] + step]
        same[pairs[~equal]] = False
        step += 1
        pairs = pairs[equal & (length[one[pairs]] > step)]
    names = np.empty(len(s), np.int64)
    names[order] = np.concatenate(([0], np.cumsum(~same)))
    return names[lms]


def _by_bucket(s: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n, k = len(s), len(ends)
    starts = np.concatenate(([0], ends[:-1]))
    out = np.empty(n, np.int64)
    held = np.bincount(s[lms], minlength=k)
    behind = np.concatenate(([0], np.cumsum(held)))  # of each bucket, where its LMS suffixes begin

    def spread(found: np.ndarray, free: np.ndarray, sign: int) -> None:
        """Put suffixes into their buckets in the order found, forwards or backwards from what is free."""
        symbols = s[found]
        at = np.argsort(symbols, kind="stable")
        counts = np.bincount(symbols, minlength=k)
        rank = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
        symbols = symbols[at]
        out[free[symbols] + rank if sign > 0 else free[symbols] - 1 - rank] = found[at]
        free += sign * counts

    free = starts.copy()
    spread(np.array([n - 1]), free, 1)
    for c in range(k):
        done = starts[c]
        while done < free[c]:
            before = out[done : free[c]] - 1
            done = free[c]
            before = before[before >= 0]
            spread(before[~small[before]], free, 1)
        if held[c]:
            spread(lms[behind[c] : behind[c + 1]] - 1, free, 1)
    filled = free
    free = ends.copy()
    for c in range(k - 1, -1, -1):
        done = ends[c]
        while done > free[c]:
            before = out[free[c] : done][::-1] - 1
            done = free[c]
            before = before[before >= 0]
            spread(before[small[before]], free, -1)
        before = out[starts[c] : filled[c]][::-1] - 1
        before = before[before >= 0]
        spread(before[small[before]], free, -1)
    return out


def _by_symbol(s: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(s)
    text, smaller = s.tolist(), small.tolist()
    free = np.concatenate(([0], ends[:-1])).tolist()
    out = [-1] * n
    top = ends.tolist()
    for i in reversed(lms.tolist()):
        top[text[i]] -= 1
        out[top[text[i]]] = i
    # The LMS suffixes are read where the pass from the left meets them, and induced anew by the other one.
    out[free[text[n - 1]]] = n - 1
    free[text[n - 1]] += 1
    for r in range(n):
        i = out[r] - 1
        if i >= 0 and not smaller[i]:
            c = text[i]
            out[free[c]] = i
            free[c] += 1
    top = ends.tolist()
    for r in range(n - 1, -1, -1):
        i = out[r] - 1
        if i >= 0 and smaller[i]:
            c = text[i]
            top[c] -= 1
            out[top[c]] = i
    return np.array(out)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of every suffix, by its start, the length it shares with the one before it in ``order`` (0 for the first).

    A suffix shares at most one symbol less than the one that starts a symbol earlier.  It shares
    just that where the symbols in front of both are equal, so only the others are compared.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = -1
    starts = np.flatnonzero(before >= 0)
    other = before[starts]
    inherits = (starts > 0) & (other > 0) & (s[starts - 1] == s[other - 1])
    first = np.ones(n, bool)
    first[starts[inherits]] = False
    shared = np.zeros(n, np.int64)
    i = np.flatnonzero(first & (before >= 0))
    j = before[i]
    while len(i):
        at, to = i + shared[i], j + shared[i]
        go = (at < n) & (to < n)
        go[go] = s[at[go]] == s[to[go]]
        i, j = i[go], j[go]
        shared[i] += 1
    last = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return np.maximum(shared[last] - (np.arange(n) - last), 0)
