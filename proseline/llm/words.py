"""Hashes of words and of runs of words, shared by the operators that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words, remembered up to a number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = xxhash.xxh64_intdigest(word, 17)
        if len(word) <= 64:
            self[word] = out
        return out


def hashed(text: bytes, known: Hashes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(words: np.ndarray, n: int, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """A hash of each n words in a row: a polynomial modulo 2^64 of their hashes, mixed."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)], dtype=np.uint64)])
    out = (summed[n:] - summed[:-n]) * inverse[: len(words) - n + 1]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, made as long as texts ask for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            size = max(n, 1 << 12)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x)]), dtype=np.uint64) for x in (_BASE, inverse)
            )
        return self.up, self.down
