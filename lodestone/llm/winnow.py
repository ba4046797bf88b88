"""Winnowing: segments of a byte string such that equal windows of a given length lie in segments of equal key."""

from __future__ import annotations

import numpy as np

GRAM = 16
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xBF58476D1CE4E5B9)
_FIRST = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64)
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        inverse = pow(BASE, -1, 1 << 64)
        _POWERS = tuple(
            np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, inverse)
        )
    return _POWERS[0][:n], _POWERS[1][:n]


def sums_of(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which substring_hashes() tells the hash of any run of bytes."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_FIRST[raw] * _powers(len(raw))[0], dtype=np.uint64, out=sums[1:])
    return sums


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def substring_hashes(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes first..end: the same for the same bytes wherever they stand."""
    return mixed((sums[end] - sums[first]) * _powers(len(sums))[1][first])


def gram_hashes(raw: np.ndarray, gram: int = GRAM, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes: the same for the same bytes wherever they stand."""
    sums = sums_of(raw) if sums is None else sums
    h = sums[gram:] - sums[:-gram]
    h *= _powers(len(raw))[1][: len(h)]
    return mixed(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(h)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(raw: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, first, last: runs of window starts first..last whose windows of ``length`` bytes have the same last place of
    the least gram hash, which is the key.

    Each window start is in one run. Equal windows have the same key, wherever they stand, and two equal windows never
    share a run.
    """
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    h, width = gram_hashes(raw, gram), length - gram + 1
    least = window_minima(h, width)
    first = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
    last = np.r_[first[1:], len(least)] - 1
    keys = least[first]
    for k, (i, j, key) in enumerate(zip(first.tolist(), last.tolist(), keys)):
        if np.count_nonzero(h[i : j + width] == key) > 1:
            return _split(h, width, keys, first, last, k)
    return keys, first, last


def _split(h: np.ndarray, width: int, keys: np.ndarray, first: np.ndarray, last: np.ndarray, k: int):
    """Cuts runs, the first k of which need it not, where the last place of the key in the window changes."""
    out_keys, out_first, out_last = [keys[:k]], [first[:k]], [last[:k]]
    for i, j, key in zip(first[k:].tolist(), last[k:].tolist(), keys[k:]):
        at = np.flatnonzero(h[i : j + width] == key) + i
        # A place is the last one from the window that ends with it to the one that ends before the next.
        begin = np.maximum(at - width + 1, i)
        begin[0] = i
        begin = begin[begin <= j]
        begin = np.unique(begin)
        out_keys.append(np.full(len(begin), key, np.uint64))
        out_first.append(begin)
        out_last.append(np.r_[begin[1:], j + 1] - 1)
    return np.concatenate(out_keys), np.concatenate(out_first), np.concatenate(out_last)
