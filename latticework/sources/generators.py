"""Generators of test systems: seeded 64-bit Mersenne twister, grids and dense matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..errors import ConfigurationError, require

SEED = 20260802


def twister(seed: int) -> Iterator[int]:
    """The 64-bit Mersenne twister of the C++ standard library (not numpy's 32-bit one)."""
    size, middle, word = 312, 156, (1 << 64) - 1
    state = [seed & word]
    for i in range(1, size):
        state.append((6364136223846793005 * (state[-1] ^ (state[-1] >> 62)) + i) & word)
    while True:
        for i in range(size):
            y = (state[i] & 0xFFFFFFFF80000000) | (state[(i + 1) % size] & 0x7FFFFFFF)
            state[i] = state[(i + middle) % size] ^ (y >> 1) ^ (0xB5026F5AA96619E9 if y & 1 else 0)
        for y in list(state):
            y ^= (y >> 29) & 0x5555555555555555
            y ^= (y << 17) & 0x71D67FFFEDA60000
            y ^= (y << 37) & 0xFFF7EEE000000000
            yield y ^ (y >> 43)


def symmetric(draws: Iterator[int]) -> float:
    """A draw, uniform in [-1, 1)."""
    return float(next(draws)) / 2.0**64 * 2.0 - 1.0


def grid_rhs(n: int, kind: str = "sine", seed: int = SEED) -> np.ndarray:
    """Right-hand side of the n x n grid: a sine with a known solution, or seeded draws."""
    require(n >= 1, "a grid needs one point a side at least")
    h = 1.0 / (n + 1.0)
    if kind == "rich":
        draws = twister(seed)
        return np.array([h * h * symmetric(draws) for _ in range(n * n)])
    if kind != "sine":
        raise ConfigurationError(f"unknown right-hand side {kind!r}; known: sine, rich")
    at = np.sin(np.pi * h * np.arange(1, n + 1))
    return (h * h * 2.0 * np.pi * np.pi * at[:, None] * at[None, :]).ravel()


def sine_solution(n: int) -> np.ndarray:
    at = np.sin(np.pi / (n + 1.0) * np.arange(1, n + 1))
    return (at[:, None] * at[None, :]).ravel()


def dense_system(n: int, seed: int = SEED, kind: str = "spd") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, right-hand side and exact solution; row-dominant, symmetric for "spd"."""
    if kind not in ("spd", "dd"):
        raise ConfigurationError(f"unknown dense kind {kind!r}; known: spd, dd")
    draws, a = twister(seed), np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1 if kind == "spd" else 0, n):
            if i != j:
                a[i, j] = symmetric(draws)
                if kind == "spd":
                    a[j, i] = a[i, j]
    for i in range(n):
        a[i, i] = float(np.add.accumulate(np.append(0.0, np.abs(np.delete(a[i], i))))[-1]) + 1.0
    exact = np.array([symmetric(draws) for _ in range(n)])
    return a, np.add.accumulate(a * exact[None, :], axis=1)[:, -1], exact
