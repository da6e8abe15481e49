"""Exact-order numpy kernels for one linear system.

Every kernel fixes the order of its floating-point operations, so a result depends
on the system alone, never on partitions or threads. Natural-order sweeps run along
anti-diagonals: a cell needs only new values of the diagonal before it, so the
vectorised form has the very bits of the cell-by-cell one.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from ..errors import NumericalFailure, require

CHUNKS = 512
BAND = 1 << 15  # cells of a band


def split(n: int, parts: int) -> list[tuple[int, int]]:
    """Half-open ranges of ``parts`` balanced blocks of 0..n-1; the first get the remainder."""
    if n < 0 or parts <= 0:
        return []
    base, extra = divmod(n, parts)
    edges = [k * base + min(k, extra) for k in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def in_order(values: np.ndarray) -> float:
    """Left-to-right sum from 0."""
    return float(np.add.accumulate(np.append(0.0, values))[-1])


def chunked(values: np.ndarray) -> float:
    """Sum over at most CHUNKS chunks, each and their partials from left to right."""
    n = len(values)
    return in_order(np.array([in_order(values[a:b]) for a, b in split(n, min(CHUNKS, n))])) if n else 0.0


def optimal_omega(n: int) -> float:
    """The relaxation that damps an n x n grid's errors most."""
    return 2.0 / (1.0 + np.sin(np.pi * (1.0 / (n + 1.0))))


class Grid:
    """Five-point Laplacian on an n x n grid, zero ring, right-hand side ``b`` (row-major)."""

    coloured, spd, gershgorin = True, True, 8.0

    def __init__(self, n: int, b: np.ndarray):
        require(n >= 1 and len(b) == n * n, "a grid needs n >= 1 and n * n right-hand values")
        self.n, self.blocks = n, n
        self.b = np.zeros((n + 2, n + 2))
        self.b[1:-1, 1:-1] = np.asarray(b, float).reshape(n, n)
        self.omega = optimal_omega(n)
        self.pivot, self.ratio = np.full(n, 4.0), np.full(n, -0.25)
        for k in range(1, n):
            self.pivot[k] = 4.0 + self.ratio[k - 1]
            self.ratio[k] = -1.0 / self.pivot[k]

    @cached_property
    def diagonals(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Cells of each anti-diagonal by row."""
        rows = [np.arange(max(1, s - self.n), min(self.n, s - 1) + 1) for s in range(2, 2 * self.n + 1)]
        return [(i, s - i) for s, i in enumerate(rows, 2)]

    @cached_property
    def colours(self) -> list[tuple[np.ndarray, np.ndarray]]:
        i, j = np.mgrid[1 : self.n + 1, 1 : self.n + 1]
        return [(i[(i + j) % 2 == c], j[(i + j) % 2 == c]) for c in (0, 1)]

    def start(self) -> np.ndarray:
        return np.zeros((self.n + 2, self.n + 2))

    def flat(self, x: np.ndarray) -> np.ndarray:
        return x[1:-1, 1:-1].ravel()

    def apply(self, x: np.ndarray) -> np.ndarray:
        y = self.start()
        y[1:-1, 1:-1] = 4.0 * x[1:-1, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:] - x[:-2, 1:-1] - x[2:, 1:-1]
        return y

    def residual(self, x: np.ndarray) -> np.ndarray:
        return self.b - self.apply(x)

    def dot(self, x: np.ndarray, y: np.ndarray) -> float:
        rows = np.add.accumulate(x[1:-1, 1:-1] * y[1:-1, 1:-1], axis=1)[:, -1]
        return chunked(rows)

    def jacobi(self, x: np.ndarray) -> np.ndarray:
        """Written in place by bands of rows that stay in the cache; the order within a cell is that of one expression."""
        y, band = np.empty_like(x), max(1, BAND // (self.n + 2))
        y[0] = y[-1] = y[:, 0] = y[:, -1] = 0.0
        for a in range(1, self.n + 1, band):
            z = min(a + band, self.n + 1)
            out = y[a:z, 1:-1]
            np.add(self.b[a:z, 1:-1], x[a:z, :-2], out=out)
            for near in (x[a:z, 2:], x[a - 1 : z - 1, 1:-1], x[a + 1 : z + 1, 1:-1]):
                out += near
            out *= 0.25
        return y

    def _update(self, x: np.ndarray, cells: tuple[np.ndarray, np.ndarray], omega: float) -> None:
        i, j = cells
        x[i, j] = (1.0 - omega) * x[i, j] + (0.25 * omega) * (self.b[i, j] + x[i, j - 1] + x[i, j + 1] + x[i - 1, j] + x[i + 1, j])

    def relax(self, x: np.ndarray, omega: float, backward: bool = False) -> np.ndarray:
        require(0 < omega < 2, "relaxation must lie between 0 and 2")
        for cells in reversed(self.diagonals) if backward else self.diagonals:
            self._update(x, cells, omega)
        return x

    def colour(self, x: np.ndarray, omega: float, which: int) -> np.ndarray:
        require(0 < omega < 2, "relaxation must lie between 0 and 2")
        self._update(x, self.colours[which], omega)
        return x

    def block(self, x: np.ndarray, lagged: bool) -> np.ndarray:
        """One solve per grid line, from the previous iterate or from what is newest."""
        source = x.copy() if lagged else x
        lines = slice(1, self.n + 1)
        for own in [lines] if lagged else [slice(i, i + 1) for i in range(1, self.n + 1)]:
            above, below = source[own.start - 1 : own.stop - 1], source[own.start + 1 : own.stop + 1]
            given = self.b[own] + above + below
            done = np.zeros_like(given)
            done[:, 1] = given[:, 1] / self.pivot[0]
            for j in range(1, self.n):
                done[:, j + 1] = (given[:, j + 1] + done[:, j]) / self.pivot[j]
            for j in range(self.n - 2, -1, -1):
                done[:, j + 1] = done[:, j + 1] - self.ratio[j] * done[:, j + 2]
            x[own] = done
        return x


class Dense:
    """A dense system; ``blocks`` diagonal blocks for the block methods."""

    coloured, omega = False, 1.0

    def __init__(self, a: np.ndarray, b: np.ndarray, blocks: int = 8, spd: bool = False):
        self.a, self.b, self.spd = np.asarray(a, float), np.asarray(b, float), spd
        n = len(self.b)
        require(n >= 1 and self.a.shape == (n, n) and 1 <= blocks <= n, "a dense system needs a square matrix and 1 to n blocks")
        self.n, self.blocks = n, blocks
        self.diagonal = np.diag(self.a).copy()
        self.gershgorin = max(d + in_order(np.abs(np.delete(row, i))) for i, (d, row) in enumerate(zip(self.diagonal, self.a, strict=True)))
        self.ranges = split(n, blocks)
        self.factors = None

    def start(self) -> np.ndarray:
        return np.zeros(self.n)

    def flat(self, x: np.ndarray) -> np.ndarray:
        return x

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.add.accumulate(self.a * x[None, :], axis=1)[:, -1]

    def residual(self, x: np.ndarray) -> np.ndarray:
        return self.b - self.apply(x)

    def dot(self, x: np.ndarray, y: np.ndarray) -> float:
        return chunked(x * y)

    def _rest(self, i: int, x: np.ndarray) -> float:
        terms = -(self.a[i] * x)
        terms[i] = 0.0
        return float(np.add.accumulate(np.append(self.b[i], terms))[-1])

    def jacobi(self, x: np.ndarray) -> np.ndarray:
        return np.array([self._rest(i, x) for i in range(self.n)]) / self.diagonal

    def relax(self, x: np.ndarray, omega: float, backward: bool = False) -> np.ndarray:
        require(0 < omega < 2, "relaxation must lie between 0 and 2")
        for i in reversed(range(self.n)) if backward else range(self.n):
            x[i] = (1.0 - omega) * x[i] + omega * self._rest(i, x) / self.diagonal[i]
        return x

    def block(self, x: np.ndarray, lagged: bool) -> np.ndarray:
        if self.factors is None:
            self.factors = [factorise(self.a[lo:hi, lo:hi]) for lo, hi in self.ranges]
        source = x.copy() if lagged else x
        for (lo, hi), factor in zip(self.ranges, self.factors, strict=True):
            terms = -(self.a[lo:hi] * source[None, :])
            terms[:, lo:hi] = 0.0
            given = np.add.accumulate(np.concatenate([self.b[lo:hi, None], terms], axis=1), axis=1)[:, -1]
            x[lo:hi] = substitute(factor, given)
        return x


TINY = 1e-300


def factorise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """LU with partial pivoting: packed factors, row order, and the permutation's sign."""
    lu, rows, sign = np.array(a, float), np.arange(len(a)), 1
    for k in range(len(lu)):
        p = k + int(np.argmax(np.abs(lu[k:, k])))
        if not abs(lu[p, k]) > TINY:
            raise NumericalFailure(f"the matrix is singular: pivot {k} vanishes")
        if p != k:
            lu[[k, p]], rows[[k, p]], sign = lu[[p, k]], rows[[p, k]], -sign
        lu[k + 1 :, k] /= lu[k, k]
        lu[k + 1 :, k + 1 :] -= np.outer(lu[k + 1 :, k], lu[k, k + 1 :])
    return lu, rows, sign


def substitute(factor: tuple[np.ndarray, np.ndarray, int], b: np.ndarray) -> np.ndarray:
    lu, rows, _ = factor
    x = np.asarray(b, float)[rows]
    for i in range(len(x)):
        x[i] = np.add.accumulate(np.append(x[i], -(lu[i, :i] * x[:i])))[-1]
    for i in range(len(x) - 1, -1, -1):
        x[i] = np.add.accumulate(np.append(x[i], -(lu[i, i + 1 :] * x[i + 1 :])))[-1] / lu[i, i]
    return x


def determinant(factor: tuple[np.ndarray, np.ndarray, int]) -> float:
    return float(factor[2] * np.multiply.accumulate(np.diag(factor[0]))[-1]) if len(factor[0]) else 1.0
