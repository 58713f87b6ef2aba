"""Words, word hashes and hashes of consecutive words, vectorised over whole Arrow batches.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. A word's hash adds its blocks of eight bytes, each mixed with
its place first, so no arrangement of equal blocks cancels out. Hashes of consecutive words are 64-bit polynomials of word hashes,
taken from prefix sums modulo 2**64 and mixed at the end; that is sound for windows and shingles, whose words are few.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
WORD_BASE = 0xD6E8FEB86659FD93
#: Keeps the first r bytes of a little-endian block, r = 0 .. 8.
_FIRST = np.array([(1 << 8 * r) - 1 for r in range(9)], np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 16), base, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if n <= 1 << 22:
            _powers[base] = kept
    return kept[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and for each row the index of its first word (one more at the end).

    off are the rows' offsets into buf, off[0] == 0."""
    word = ~SEPARATOR[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = off[(off > 0) & (off < len(buf))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    blocks = (size + 7) >> 3
    first = blocks.cumsum() - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at_every_byte = np.ndarray((len(buf),), "<u8", padded, 0, (1,))
    value = at_every_byte[np.repeat(starts, blocks) + 8 * place] & _FIRST[np.minimum(8, np.repeat(size, blocks) - 8 * place)]
    mixed = mix(value ^ mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x6A09E667F3BCC909)))
    return mix(np.add.reduceat(mixed, first) + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


class Runs:
    """Hashes of any run of consecutive words."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(WORD_BASE, n), out=self.total[1:])
        self.back = powers(inverse(WORD_BASE), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return mix((self.total[end] - self.total[start]) * self.back[start] + size * np.uint64(0xA0761D6478BD642F))

    def every(self, k: int) -> np.ndarray:
        """Of each k consecutive words, whichever rows they stand in."""
        n = len(self.total) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.total[k:] - self.total[: n - k + 1]) * self.back[: n - k + 1] + np.uint64(k * 0xA0761D6478BD642F % 2**64))


def shingles(runs: Runs, a: int, b: int, k: int, grams: np.ndarray) -> np.ndarray:
    """Distinct k-word hashes of the words [a, b), or the one of them all where there are fewer than k."""
    if b - a < k:
        return runs.of(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)
    return np.unique(grams[a : b - k + 1])
