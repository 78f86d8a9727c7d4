"""Hashes of substrings of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2 ** 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n + 1, dtype=np.uint64), np.empty(n + 1, dtype=np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _BASE, _UNBASE
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Polynomial hashes of any substrings of a byte array, two gathers each."""

    def __init__(self, data: np.ndarray, values: np.ndarray, up: np.ndarray, down: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[:len(data)], out=self.sums[1:])
        self.down = down

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])
