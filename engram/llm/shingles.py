"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
CACHE = 50_000
_WORDS: dict[bytes, int] = {}
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def word_hash(word: bytes) -> int:
    if len(_WORDS) >= CACHE:
        _WORDS.clear()
    value = _WORDS[word] = xxhash.xxh3_64_intdigest(word) or 1
    return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    get = _WORDS.get
    return np.array([get(w) or word_hash(w) for w in words], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text with A-Z lower-cased; fewer words are one shingle, none is the empty set."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for o in range(min(size, len(h))):
        out = mix(out * _MIX[0] + h[o : o + n])
    return np.unique(out)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))
