"""Word shingles as sets of 64-bit hashes, and min-max signatures over them.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z only.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: bytes.lower() changes A-Z only, and bytes.split() cuts at 0x20, 0x09-0x0D only:
#: on UTF-8 both do exactly what the contract says.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = tuple(np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class WordHasher(dict):
    """64-bit hash of a word; a plain dict that forgets everything once it is large."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MUL[0]
    h = (h ^ (h >> np.uint64(27))) * _MUL[1]
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, k: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))
    size = min(k, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = _finish((h + w[i : i + len(h)]) * _MIX + np.uint64(i))
    h.sort()
    if len(h) > 1:
        h = h[np.concatenate(([True], h[1:] != h[:-1]))]
    return h


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32))


def min_max(h: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """Both the smallest and the largest image of the set under each permutation: mins, then maxes."""
    x = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    high = np.zeros(len(a), np.uint32)
    for i in range(0, len(x), block):
        y = x[i : i + block, None] * a + b
        np.minimum(low, y.min(0), out=low)
        np.maximum(high, y.max(0), out=high)
    return np.concatenate((low, high))


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` consecutive signature values."""
    s = signature.reshape(-1, rows).astype(np.uint64)
    h = np.arange(1, len(s) + 1, dtype=np.uint64) * _MIX
    for i in range(rows):
        h = _finish((h + s[:, i]) * _MIX)
    return h.view(np.int64)


def parity_bits(h: np.ndarray, size: int) -> np.ndarray:
    """``size`` bits as longs: each element flips one bit, so differing bits never outnumber differing elements."""
    odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y|, for sorted distinct arrays."""
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate((x, y))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (small + large - shared)
