"""Suffix arrays of byte strings by induced sorting, whole buckets at a time."""

from __future__ import annotations

import numpy as np

from ._text import BYTE_VALUE, prefix_hash, span_hash


def kinds(s: np.ndarray) -> np.ndarray:
    """Whether each suffix of s is smaller than the next one; the last, the sentinel, is."""
    n = len(s)
    up = np.empty(n, bool)
    up[-1] = True
    if n > 1:
        up[:-1] = s[:-1] < s[1:]
        same = np.flatnonzero(s[:-1] == s[1:])
        if len(same):
            # A suffix that begins with a run is of the kind of the run's last letter.
            fixed = np.append(s[:-1] != s[1:], True)
            at = np.where(fixed, np.arange(n), n)
            at = np.minimum.accumulate(at[::-1])[::-1]
            up = up[at]
    return up


def _deal(queue: list[list[np.ndarray]], at: np.ndarray, letters: np.ndarray) -> None:
    if not len(at):
        return
    if len(at) < 64:
        for d in np.unique(letters).tolist():
            queue[d].append(at[letters == d])
        return
    order = np.argsort(letters, kind="stable")
    at, counts = at[order], np.bincount(letters, minlength=len(queue))
    ends = np.cumsum(counts)
    for d in np.flatnonzero(counts).tolist():
        queue[d].append(at[ends[d] - counts[d] : ends[d]])


def induce(s: np.ndarray, up: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost smaller ones in order.

    A pass over the buckets from the least letter appends the larger kind to the fronts
    of later buckets, one back appends the smaller kind to the ends of earlier ones. A
    bucket's suffixes are extended to the left together; only runs of one letter need
    further turns in the same bucket."""
    letters = int(s.max()) + 1
    none = np.zeros(0, np.int64)
    first: list[list[np.ndarray]] = [[] for _ in range(letters)]
    by_letter = s[seeds]
    order = np.argsort(by_letter, kind="stable")
    ends = np.cumsum(np.bincount(by_letter, minlength=letters))
    seeds = seeds[order]
    larger: list[np.ndarray] = []
    for c in range(letters):
        front = np.concatenate(first[c]) if first[c] else none
        got = [front]
        while len(front):
            p = front - 1
            p = p[p >= 0]
            p = p[~up[p]]
            d = s[p]
            _deal(first, p[d > c], d[d > c])
            front = p[d == c]
            got.append(front)
        larger.append(np.concatenate(got))
        mine = seeds[ends[c - 1] if c else 0 : ends[c]] - 1
        mine = mine[mine >= 0]
        _deal(first, mine, s[mine])
        first[c] = []
    last: list[list[np.ndarray]] = [[] for _ in range(letters)]
    out: list[np.ndarray] = []
    for c in range(letters - 1, -1, -1):
        front = np.concatenate(last[c]) if last[c] else none
        got = [front]
        while len(front):
            p = front - 1
            p = p[p >= 0]
            p = p[up[p]]
            d = s[p]
            _deal(last, p[d < c], d[d < c])
            front = p[d == c]
            got.append(front)
        back = larger[c][::-1] - 1
        back = back[back >= 0]
        back = back[up[back]]
        _deal(last, back, s[back])
        last[c] = []
        out.append(np.concatenate([larger[c], np.concatenate(got)[::-1]]))
    out[-1] = np.array([len(s) - 1])  # the sentinel's bucket
    return np.concatenate(out[::-1])


def _order(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Ranks of the suffixes of a string of integers. Names are doubled in length until all
    differ, or until they span `depth` letters."""
    rank, n, reach = names, len(names), 1
    while True:
        shifted = np.zeros(n, np.int64)
        if reach < n:
            shifted[: n - reach] = rank[reach:] + 1
        key = rank * np.int64(n + 1) + shifted
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        reach *= 2
        if fresh[-1] == n - 1 or reach >= n or (depth and reach >= depth):
            return order


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes of `data` (bytes) in order; with depth, in the order of at
    least their first `depth` bytes.

    Suffixes are classed; the leftmost smaller substrings are sorted by one induction
    and named; where names repeat, the string of names, a third as long at most or so,
    is ordered in turn; a second induction gives the array."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    s = np.empty(n + 1, np.int64)
    s[:-1] = data
    s[:-1] += 1
    s[-1] = 0
    letters = np.unique(s)
    if len(letters) < 200:
        table = np.zeros(257, np.int64)
        table[letters] = np.arange(len(letters))
        s = table[s]
    s = s.astype(np.int16)
    up = kinds(s)
    leftmost = up.copy()
    leftmost[1:] &= ~up[:-1]
    leftmost[0] = False
    at = np.flatnonzero(leftmost)
    if len(at) > 1:
        rough = induce(s, up, at)
        rough = rough[leftmost[rough]]
        stop = np.zeros(n + 1, np.int64)
        stop[at[:-1]] = at[1:] + 1
        stop[at[-1]] = n + 1
        prefix = prefix_hash(np.append(data, np.uint8(0)), BYTE_VALUE)
        value = span_hash(prefix, rough, np.minimum(stop[rough], n + 1))
        size = stop[rough] - rough
        new = np.ones(len(rough), bool)
        new[1:] = (value[1:] != value[:-1]) | (size[1:] != size[:-1])
        name = np.empty(n + 1, np.int64)
        name[rough] = np.cumsum(new) - 1
        names = name[at]
        if new.all():
            seeds = rough
        else:
            seeds = at[_order(names, depth and depth // 2 + 1)]
    else:
        seeds = at
    return induce(s, up, seeds)[1:]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix start in `order` but the first, the length it shares with the one
    before, up to `most`. Held by text position and searched by doubling steps over
    prefix hashes."""
    prefix = prefix_hash(data, BYTE_VALUE)
    a, b = order[1:], order[:-1]
    n = len(data)
    got = np.zeros(len(a), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        ok = np.flatnonzero(np.maximum(a, b) + got + step <= n)
        x, y = a[ok] + got[ok], b[ok] + got[ok]
        hit = ok[span_hash(prefix, x, x + step) == span_hash(prefix, y, y + step)]
        got[hit] += step
        step >>= 1
    return np.minimum(got, most)
