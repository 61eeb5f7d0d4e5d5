"""Suffix arrays by induced sorting, and permuted common prefixes, vectorised.

Induction scans the array in order; every entry that is already in place can be handled together, so a scan is a
few array operations for each stretch of entries that do not wait for one another.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last character is the unique smallest (S)."""
    n = len(t)
    s = np.zeros(n, bool)
    s[-1] = True
    if n == 1:
        return s
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # next position whose successor differs
    up = np.append(step, 1)
    s[:-1] = up[nxt] > 0
    return s


def _stable_order(c: np.ndarray) -> np.ndarray:
    """Stable argsort of small whole numbers, 16 bits at a time (a radix sort)."""
    order = np.argsort((c & 0xFFFF).astype(np.uint16), kind="stable")
    high = c >> 16
    if len(c) and high.max():
        order = order[np.argsort(high[order].astype(np.uint16), kind="stable")]
    return order


def _grouped_ranks(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable rank of each item among equal values; the distinct values and their counts."""
    order = _stable_order(c)
    sorted_c = c[order]
    first = np.flatnonzero(np.append(True, sorted_c[1:] != sorted_c[:-1]))
    counts = np.diff(np.append(first, len(c)))
    rank = np.empty(len(c), np.int64)
    rank[order] = np.arange(len(c)) - np.repeat(first, counts)
    return rank, sorted_c[first], counts


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The array induced from leftmost-smaller suffixes in the given order."""
    n, sigma = len(t), len(counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    n_large = np.bincount(t[~s], minlength=sigma)
    sa = np.full(n, -1, np.int64)
    # leftmost-smaller suffixes stand at the ends of their buckets
    rank, _, _ = _grouped_ranks(t[lms][::-1])
    sa[ends[t[lms]] - 1 - rank[::-1]] = lms
    lms_slot = sa >= 0
    # larger suffixes, left to right: an empty slot of theirs stops the stretch
    head = starts.copy()
    waits = np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n_large, -1)
    waits = np.cumsum(edge[:-1]) > 0
    i, chunk = 0, 4096
    while i < n:
        part = sa[i : i + chunk]
        open_ = np.flatnonzero((part < 0) & waits[i : i + chunk])
        stop = int(open_[0]) if len(open_) else len(part)
        chunk = min(1 << 20, chunk * 2) if not len(open_) else max(256, stop * 2)
        got = part[:stop]
        before = got[got > 0] - 1
        before = before[~s[before]]
        if len(before):
            c = t[before]
            rank, values, many = _grouped_ranks(c)
            sa[head[c] + rank] = before
            head[values] += many
        if stop == 0:
            raise AssertionError("induction stalled")
        i += stop
    # smaller suffixes, right to left, in place of the leftmost-smaller ones
    sa[lms_slot] = -1
    sa[0] = n - 1
    tail = ends.copy()
    tail[t[n - 1]] -= 1
    waits = ~waits
    i, chunk = n, 4096
    while i > 0:
        lo = max(0, i - chunk)
        part = sa[lo:i]
        open_ = np.flatnonzero((part < 0) & waits[lo:i])
        stop = len(part) - 1 - int(open_[-1]) if len(open_) else len(part)
        chunk = min(1 << 20, chunk * 2) if not len(open_) else max(256, stop * 2)
        got = part[len(part) - stop :][::-1]
        before = got[got > 0] - 1
        before = before[s[before]]
        if len(before):
            c = t[before]
            rank, values, many = _grouped_ranks(c)
            sa[tail[c] - 1 - rank] = before
            tail[values] -= many
        if stop == 0:
            raise AssertionError("induction stalled")
        i -= stop
    return sa


def _same_substrings(t: np.ndarray, s: np.ndarray, is_lms: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the leftmost-smaller substrings at a and b are equal."""
    n = len(t)
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    k = 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        equal = inside & (t[x] == t[y]) & (s[x] == s[y])
        same[live[~equal]] = False
        ended = equal & (k > 0) & (is_lms[x] | is_lms[y])
        bad = ended & (is_lms[x] != is_lms[y])
        same[live[bad]] = False
        live = live[equal & ~ended]
        k += 1
    return same


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of positive whole numbers (without a final sentinel)."""
    if not len(t):
        return np.zeros(0, np.int64)
    t = np.append(np.asarray(t, np.int64), 0)
    return _sais(t)[1:]


def _sais(t: np.ndarray) -> np.ndarray:
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    counts = np.bincount(t)
    s = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(is_lms)
    first = _induce(t, s, lms, counts)
    order = first[is_lms[first]]
    if len(order) > 1:
        differs = ~_same_substrings(t, s, is_lms, order[:-1], order[1:])
        names_sorted = np.append(0, np.cumsum(differs))
    else:
        names_sorted = np.zeros(len(order), np.int64)
    if names_sorted[-1] + 1 < len(order):
        names = np.zeros(n, np.int64)
        names[order] = names_sorted
        order = lms[_sais(names[lms])]
    return _induce(t, s, order, counts)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the suffix before it in the array (-1 for the first) and their common prefix length.

    Only positions whose preceding characters differ are compared; for the others the length is one less than
    that of the position before.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    here = np.arange(n)
    reducible = (here > 0) & (phi > 0) & (t[np.maximum(here - 1, 0)] == t[np.maximum(phi - 1, 0)])
    at = np.flatnonzero(~reducible)
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero(phi[at] >= 0)
    while len(live):
        x = at[live] + length[live]
        y = phi[at[live]] + length[live]
        ok = (x < n) & (y < n)
        ok &= t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)]
        live = live[ok]
        length[live] += 1
    reach = np.zeros(n, np.int64)
    reach[at] = length + at
    reach = np.maximum.accumulate(reach)
    plcp = np.maximum(reach - here, 0)
    plcp[at] = length
    plcp[phi < 0] = 0
    return phi, plcp
