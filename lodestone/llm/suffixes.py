"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost-smaller (LMS) substrings
are sorted by one round of induction and named; if names repeat, the string of names is sorted recursively; a second
round induces the whole array from the sorted LMS suffixes. Both rounds are linear. A small alphabet is induced bucket by
bucket in numpy, in waves (a bucket's entries put their predecessors of the same symbol into the bucket's next wave);
names, of which there may be as many as symbols, are induced in blocks of the array.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced in numpy.
SMALL = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)


def classify(s: np.ndarray) -> np.ndarray:
    """True for the S suffixes of s, whose last symbol is a unique least one."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    # A run of equal symbols is of the type of the next change.
    at = np.where(step != 0, np.arange(n - 1), n)
    change = np.minimum.accumulate(at[::-1])[::-1]
    kind = np.ones(n, bool)
    kind[:-1] = np.append(step, -1)[np.minimum(change, n - 1)] > 0
    return kind


def _append(sa: np.ndarray, s: np.ndarray, at: np.ndarray, place: np.ndarray, down: bool) -> None:
    """Puts suffixes, in their order, at the heads (or tails) of their buckets and moves these on."""
    chars = s[at]
    order = np.argsort(chars, kind="stable")
    chars, at = chars[order], at[order]
    first = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
    sizes = np.diff(np.r_[first, len(chars)])
    rank = np.arange(len(chars)) - np.repeat(first, sizes)
    heads = chars[first]
    if down:
        sa[np.repeat(place[heads], sizes) - 1 - rank] = at
        place[heads] -= sizes
    else:
        sa[np.repeat(place[heads], sizes) + rank] = at
        place[heads] += sizes


def _induce(s: np.ndarray, kind: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The order that the LMS suffixes, given in order, induce; one bucket at a time."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    tails = ends.copy()
    _append(sa, s, lms[::-1], tails, down=True)
    heads = starts.copy()
    for c in np.flatnonzero(counts):
        at = starts[c]
        while at < heads[c]:
            wave = sa[at : heads[c]]
            at = heads[c]
            before = wave[wave > 0] - 1
            before = before[~kind[before]]
            if len(before):
                _append(sa, s, before, heads, down=False)
        wave = sa[tails[c] : ends[c]]
        before = wave[wave > 0] - 1
        before = before[~kind[before]]
        if len(before):
            _append(sa, s, before, heads, down=False)
    tails = ends.copy()
    for c in np.flatnonzero(counts)[::-1]:
        at = ends[c]
        while at > tails[c]:
            wave = sa[tails[c] : at][::-1]
            at = tails[c]
            before = wave[wave > 0] - 1
            before = before[kind[before]]
            if len(before):
                _append(sa, s, before, tails, down=True)
        wave = sa[starts[c] : heads[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[kind[before]]
        if len(before):
            _append(sa, s, before, tails, down=True)
    sa[0] = n - 1
    return sa


def _scan(s: np.ndarray, sa: np.ndarray, take: np.ndarray, place: np.ndarray, down: bool) -> None:
    """One pass of induction over sa, in blocks that end where an entry of the block would be put into the block itself."""
    n, k, width = len(s), 0, 64
    sign = -1 if down else 1
    scanned = sa[::-1] if down else sa
    while k < n:
        end = min(n, k + width)
        wave = scanned[k:end]
        at = np.flatnonzero(wave > 0)
        before = wave[at] - 1
        fit = take[before]
        at, before = at[fit] + k, before[fit]
        width *= 2
        if len(before):
            chars = s[before]
            order = np.argsort(chars, kind="stable")
            sorted_ = chars[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            to = np.empty(len(order), np.int64)
            to[order] = place[sorted_] + sign * rank
            least = int((n - 1 - to).min() if down else to.min())
            if least < end:
                end = least
                count = int(np.searchsorted(at, end))
                to, before, chars = to[:count], before[:count], chars[:count]
                width = max(16, (end - k) * 2)
            sa[to] = before
            place[chars] = to + sign
        k = end


def _induce_long(s: np.ndarray, kind: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """As _induce, for alphabets of many symbols: block by block, as the entries of a block seldom meet in it."""
    n = len(s)
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    sa = np.full(n, -1, np.int64)
    _append(sa, s, lms[::-1], ends.copy(), down=True)
    _scan(s, sa, ~kind, ends - counts, down=False)
    _scan(s, sa, kind, ends - 1, down=True)
    sa[0] = n - 1
    return sa


def _suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    kind = classify(s)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    induce = _induce if size <= SMALL else _induce_long
    sa = induce(s, kind, lms, size)
    if len(lms) <= 1:
        return sa
    # Names of the LMS substrings: they end with the next LMS symbol, so equal symbols mean equal types.
    sums = np.zeros(n + 1, np.uint64)
    up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, MIX | np.uint64(1), np.uint64)], dtype=np.uint64)
    inverse = np.uint64(pow(int(MIX) | 1, -1, 1 << 64))
    down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)], dtype=np.uint64)
    symbol = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    symbol ^= symbol >> np.uint64(32)
    np.cumsum(symbol * up, dtype=np.uint64, out=sums[1:])
    ends = np.r_[lms[1:] + 1, n]
    sizes = ends - lms
    prints = (sums[ends] - sums[lms]) * down[lms]
    number = np.full(n, -1, np.int64)
    number[lms] = np.arange(len(lms))
    order = number[sa]
    order = order[order >= 0]
    new = (prints[order[1:]] != prints[order[:-1]]) | (sizes[order[1:]] != sizes[order[:-1]])
    names = np.zeros(len(lms), np.int64)
    names[order] = np.r_[0, np.cumsum(new)]
    count = int(names.max()) + 1
    if count < len(lms):
        order = _suffix_array(names, count)
    return induce(s, kind, lms[order], size)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of s, symbols of at least 1 (a least one is appended and taken off)."""
    if not len(s):
        return np.zeros(0, np.int64)
    return _suffix_array(np.append(s, 0).astype(np.int64), int(s.max()) + 1)[1:]


def common_prefixes(s: np.ndarray, sa: np.ndarray, exact: np.ndarray, most: int) -> np.ndarray:
    """PLCP: for each place, the common prefix of its suffix and the one sorted before it, or ``most`` if more.

    Where the symbols before both suffixes are equal, the value is one less than that of the place before; only the
    other places, and those in ``exact``, are compared. Values are right up to most - (distance to the place compared).
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    compared = np.ones(n, bool)
    i = np.arange(1, n)
    has = (phi[1:] > 0) & (phi[:-1] >= 0)
    # The suffix before place i's is the successor of the one before place i - 1's, if both go on alike.
    compared[1:] = ~(has & (s[i - 1] == s[np.maximum(phi[1:] - 1, 0)]))
    compared[exact] = True
    at = np.flatnonzero(compared)
    value = np.zeros(len(at), np.int64)
    padded = np.r_[s, np.zeros(16, s.dtype)]
    live = np.flatnonzero(phi[at] >= 0)
    a, b = at[live].copy(), phi[at[live]].copy()
    while len(live):
        room = np.minimum(n - a, n - b)
        same = np.ones(len(live), bool)
        gained = np.zeros(len(live), np.int64)
        for k in range(16):
            same &= (k < room) & (padded[np.minimum(a + k, n)] == padded[np.minimum(b + k, n)])
            gained += same
            if not same.any():
                break
        value[live] += gained
        go = same & (value[live] < most)
        live, a, b = live[go], a[go] + 16, b[go] + 16
    value = np.minimum(value, most)
    last = np.maximum.accumulate(np.where(compared, np.arange(n), 0))
    whole = np.zeros(n, np.int64)
    whole[at] = value
    return np.maximum(0, whole[last] - (np.arange(n) - last))


def shared_starts(pieces: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """For each piece (bytes, starts that count, weight): which of its first starts begin a string of ``length`` bytes
    that, weights added, begins at two places or more."""
    sizes = np.array([len(p) + 1 for p, _, _ in pieces])
    firsts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"\0".join(p for p, _, _ in pieces) + b"\0", np.uint8).astype(np.int64) + 2
    raw[np.cumsum(sizes) - 1] = 1
    sa = suffix_array(raw)
    prefix = common_prefixes(raw, sa, firsts, 4 * length)
    group = np.empty(len(raw), np.int64)
    group[sa] = np.cumsum(prefix[sa] < length)
    starts = np.concatenate([f + np.arange(c) for f, (_, c, _) in zip(firsts, pieces)])
    weights = np.repeat([w for _, _, w in pieces], [c for _, c, _ in pieces])
    total = np.bincount(group[starts], weights, len(raw) + 1)
    shared = total[group[starts]] >= 2
    return np.split(shared, np.cumsum([c for _, c, _ in pieces])[:-1])
