"""Shingle sets and SetSketch registers of one text.

A register keeps, for one hash function, the smallest of the exponential
variates that the set's elements draw, on an exponential scale with base
``BASE``: floor(1 - log_BASE(minimum)), shifted and truncated to 16 bits. The
registers of a union are the larger ones of its parts (``merge``), equal
registers are about as likely as the sets are similar, and the similarity of
two sets of known size follows from how many registers are larger, smaller and
equal by maximum likelihood (``estimate``).
"""

from __future__ import annotations

import numpy as np
import xxhash

REGISTERS, ROWS = 200, 5
BANDS = REGISTERS // ROWS
BASE = 1.001
SHIFT = 4096
_RNG = np.random.default_rng(20_240_229)
_MUL = (_RNG.integers(0, 2**32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A bound on what a worker remembers of words it has met.
CACHE = 120_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C2
    h = (h ^ (h >> np.uint64(32))) * _C2
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, hashes: WordHashes, width: int = 2) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * _C1 + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def set_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def registers(own: np.ndarray) -> np.ndarray:
    """The REGISTERS 16-bit registers of a non-empty set."""
    h = (own >> np.uint64(32)).astype(np.uint32)
    most = np.zeros(REGISTERS, np.uint32)
    for at in range(0, len(h), 512):
        y = np.multiply.outer(h[at : at + 512], _MUL)
        y += _ADD
        np.maximum(most, y.max(0), out=most)
    least = -np.log((most.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)) + SHIFT, 0, 65_535).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of rows of registers, the sets' sizes being known.

    With u and v the sizes' shares, registers are larger with chance u - vJ,
    smaller with v - uJ, equal with J; the likelihood is at its peak where a
    quadratic in J is zero.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    qa = u * v * a.shape[1]
    qb = (u * u + v * v) * same + v * v * more + u * u * less
    root = np.sqrt(np.maximum(qb * qb - 4 * qa * same * u * v, 0))
    return np.minimum((qb - root) / (2 * qa), np.minimum(u / v, v / u))
