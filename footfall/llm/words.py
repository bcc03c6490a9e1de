"""Vectorised word hashing over Arrow text columns (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

from footfall.llm.common import worker_cache

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every byte whether it is a space, and its lower case (A-Z only)."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    cache = worker_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, BASE, _U), np.full(size, pow(BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        cache["powers"] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return cache["powers"][0][:n], cache["powers"][1][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (byte positions in ``data``) of all words of the texts between ``offsets``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = ~_tables()[0][data[lo:hi]]
    starts, ends = inside.copy(), np.ones(hi - lo, bool)
    edge = offsets[1:-1] - lo
    edge = edge[(edge > 0) & (edge < hi - lo)]
    starts[1:] &= ~inside[:-1]
    starts[edge] = inside[edge]
    ends[:-1] = ~inside[1:]
    ends[edge - 1] = True
    ends &= inside
    return np.flatnonzero(starts) + lo, np.flatnonzero(ends) + lo + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words given by their bounds, block by block."""
    out = np.empty(len(starts), _U)
    fold = _tables()[1]
    a = 0
    while a < len(starts):
        first = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, first + BLOCK, side="right")))
        part = data[first : int(ends[b - 1])]
        codes = (fold[part] if lower else part).astype(_U) + _U(1)
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(codes * up[: len(part)], out=total[1:])
        s, e = starts[a:b] - first, ends[a:b] - first
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        a = b
    return out


#: Odd multipliers for the places of a shingle.
PLACES = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(hashes: np.ndarray, text_of: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, as (text number, hash), sorted by both.

    ``text_of`` is the text of each word (ascending), ``counts`` the words of
    each text.  A text of fewer than k words has one shingle, all its words.
    """
    n = len(hashes)
    total = np.zeros(n, _U)
    whole = np.zeros(n, bool)
    for i in range(k):
        shifted = hashes[i:] * PLACES[i]
        total[: n - i] += shifted
        if i == k - 1:
            whole[: n - i] = text_of[i:] == text_of[: n - i]
    kept, value = text_of[whole], mix(total[whole])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(text_of, short)
        sums = np.zeros(len(short), _U)
        for i in range(k - 1):
            there = counts[short] > i
            sums[there] += hashes[first[there] + i] * PLACES[i]
        kept = np.concatenate([kept, short])
        value = np.concatenate([value, mix(sums ^ mix(counts[short].astype(_U)))])
    order = np.lexsort((value, kept))
    kept, value = kept[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (kept[1:] != kept[:-1]) | (value[1:] != value[:-1])
    return kept[new], value[new]
