"""Leading eigenvalues and eigenvectors of a symmetric matrix.

Householder reflections make it tridiagonal, bisection on Sturm counts finds
eigenvalues, inverse iteration finds vectors; within clusters of eigenvalues
the vectors are made orthogonal again after each step.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of the norm form a cluster.
CLUSTER = 1e-3
STEPS = 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, beside it, reflections); reflection k works on the places from k + 1 on."""
    a = np.array(matrix, float)
    n = len(a)
    beside = np.zeros(max(n - 1, 0))
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        beside[k] = -length if v[0] > 0 else length
        v[0] -= beside[k]
        size = np.linalg.norm(v)
        if size:
            v /= size
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, w)
            rest -= np.outer(w, v)
        mirrors.append(v)
    if n > 1:
        beside[-1] = a[-1, -2]
    return np.diagonal(a).copy(), beside, mirrors


def count_below(diagonal: np.ndarray, squares: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """Eigenvalues of the tridiagonal matrix below each x: negative pivots of T - x."""
    found = np.zeros(len(x), np.int64)
    pivot = np.ones(len(x))
    for i, d in enumerate(diagonal):
        pivot = d - x - (squares[i - 1] / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        found += pivot < 0
    return found


def largest_values(diagonal: np.ndarray, beside: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling."""
    n = len(diagonal)
    around = np.zeros(n)
    around[:-1] += np.abs(beside)
    around[1:] += np.abs(beside)
    low, high = (diagonal - around).min(), (diagonal + around).max()
    norm = max(abs(low), abs(high), np.finfo(float).tiny)
    wide = 2 * _EPS * norm
    low, high = np.full(count, low - wide), np.full(count, high + wide)
    rank = n - 1 - np.arange(count)
    squares, least = beside**2, max(_EPS * _EPS * norm, np.finfo(float).tiny)
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)) + _EPS * _EPS * norm)).all():
            return middle
        above = count_below(diagonal, squares, middle, least) > rank
        low, high = np.where(above, low, middle), np.where(above, middle, high)


def _solver(diagonal: np.ndarray, beside: np.ndarray, shift: float, least: float):
    """Solve (T - shift) z = b by elimination with row exchanges."""
    n = len(diagonal)
    main, up, upper = (diagonal - shift).tolist(), beside.tolist() + [0.0], [0.0] * n
    factor, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        under = float(beside[i])
        if abs(under) > abs(main[i]):
            swapped[i] = True
            factor[i] = main[i] / under
            main[i], up[i], main[i + 1], upper[i], up[i + 1] = (
                under, main[i + 1], up[i] - factor[i] * main[i + 1], up[i + 1], -factor[i] * up[i + 1])
        else:
            main[i] = main[i] if abs(main[i]) >= least else least
            factor[i] = under / main[i]
            main[i + 1] -= factor[i] * up[i]
    main[-1] = main[-1] if abs(main[-1]) >= least else least

    def solve(b: np.ndarray) -> np.ndarray:
        z = b.tolist()
        for i in range(n - 1):
            if swapped[i]:
                z[i], z[i + 1] = z[i + 1], z[i]
            z[i + 1] -= factor[i] * z[i]
        for i in range(n - 1, -1, -1):
            x = z[i]
            if i + 1 < n:
                x -= up[i] * z[i + 1]
            if i + 2 < n:
                x -= upper[i] * z[i + 2]
            z[i] = x / main[i]
        return np.array(z)

    return solve


def _vectors(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors of the tridiagonal matrix as columns, for falling eigenvalues."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(beside).max(initial=0), np.finfo(float).tiny)
    draw = np.random.default_rng(7)
    out = np.zeros((n, len(values)))
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        shift = min(value, shift - 4 * _EPS * norm) if j > first else value     # equal values get shifts of their own
        solve = _solver(diagonal, beside, shift, _EPS * norm)
        z = draw.standard_normal(n)
        for _ in range(STEPS):
            z = solve(z / np.abs(z).max())
            z /= np.abs(z).max()
            z /= np.linalg.norm(z)
            for _ in range(2):
                z -= out[:, first:j] @ (out[:, first:j].T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``count`` largest eigenvalues, falling.

    The entry of a vector that is largest in size is positive.
    """
    n = len(matrix)
    count = min(count, n)
    scale = np.abs(matrix).max(initial=0)
    if not count or not scale:
        return np.zeros(count), np.eye(n)[:, :count]
    diagonal, beside, mirrors = tridiagonal(matrix / scale)
    values = largest_values(diagonal, beside, count)
    vectors = _vectors(diagonal, beside, values)
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(count)]
    return values * scale, vectors * np.where(top < 0, -1, 1)
