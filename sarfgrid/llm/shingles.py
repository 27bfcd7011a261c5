"""Fingerprints of words, shingles and byte strings, by numpy over whole UTF-8 buffers.

All are polynomials modulo 2**64 (an odd base, so its powers can be undone) followed by
a mixer. Equal strings have equal fingerprints everywhere; unequal ones collide with a
chance near 2**-64 a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (BASE, _INVERSE))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of (byte + 1) * BASE**k over i <= k < j."""
    up, _ = powers(len(raw) + 1)
    s = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=s[1:])
    return s


def spans_of_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no white space."""
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_fingerprints(raw: np.ndarray) -> np.ndarray:
    start, end = spans_of_words(raw)
    s = prefix_sums(raw)
    _, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        return mix((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, k: int = 3) -> np.ndarray:
    """Sorted distinct fingerprints of the k-word shingles, A-Z lower-cased; fewer words make one shingle, none an empty set."""
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    w = word_fingerprints(raw)
    if not len(w):
        return w
    size = min(k, len(w))
    with np.errstate(over="ignore"):
        g = np.full(len(w) - size + 1, size, np.uint64)
        for j in range(size):
            g = mix(g * BASE + w[j : len(w) - size + 1 + j])
    return np.unique(g)


def set_key(s: np.ndarray) -> int:
    """A 63-bit key of a sorted set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1
