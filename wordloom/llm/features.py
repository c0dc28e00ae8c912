"""Hashed features of texts and small linear models over them."""

from __future__ import annotations

import numpy as np

from . import words

_U = np.uint64


def hashed(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> _U(64 - bits)).astype(np.int64)


_BASE = 0x9E3779B97F4A7C55
_BYTE_VALUE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def word_starts(c: words.Chunk, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, (word number, hash of the word's first so many bytes) of the longer words.

    Features only: two beginnings with one hash are one feature.
    """
    length = c.end - c.start
    out = []
    for size in sizes:
        i = np.flatnonzero(length >= size)
        h = np.full(len(i), size, _U)
        for k in range(size):
            h = h * _U(_BASE) + _BYTE_VALUE[c.data[c.start[i] + k]]
        out.append((i, words.mix(h)))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """First-order steps with running moments."""

    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
