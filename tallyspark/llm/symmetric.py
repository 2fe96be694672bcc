"""Leading eigenvalues and vectors of a small symmetric matrix: Householder tridiagonalisation,
bisection on Sturm counts, inverse iteration with reorthogonalisation inside clusters."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of the norm are one cluster, their vectors made orthogonal to each other.
CLUSTER, SOLVES = 1e-3, 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The diagonal, the side diagonal, and the unit reflectors h (I - 2 h h') that bring ``matrix`` there."""
    a = np.array(matrix, float)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1:, k]
        h = np.zeros(n)
        h[k + 1:] = x
        h[k + 1] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(h)
        if size > 0:
            h /= size
            p = a @ h
            q = 2 * (p - (h @ p) * h)
            a -= np.outer(h, q) + np.outer(q, h)
        reflectors.append(h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each of ``at``: the negative pivots of T - at I."""
    least = EPS * max(1e-300, np.abs(diagonal).max(initial=0) + 2 * np.abs(side).max(initial=0))
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], side, strict=True):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - at - e * e / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected down to neighbouring doubles."""
    n = len(diagonal)
    edge = np.append(np.abs(side), 0) + np.append(0, np.abs(side))
    low, high = np.full(k, (diagonal - edge).min()), np.full(k, (diagonal + edge).max())
    high += 2 * EPS * np.abs(high) + 1e-300
    place = n - np.arange(k)  # the i-th largest has place[i] - 1 values under it
    for _ in range(2100):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        over = below(diagonal, side, middle) >= place
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return low + (high - low) / 2


def solved(diagonal: np.ndarray, side: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift I) y = right by elimination with row exchanges; pivots under ``least`` count as it."""
    n = len(diagonal)
    d, b = (diagonal - shift).tolist(), right.tolist()
    up, far, low = [*side.tolist(), 0.0], [0.0] * n, side.tolist()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low[i] = low[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            far[i], up[i + 1] = up[i + 1], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(d[i]) < least:
            d[i] = least
        factor = low[i] / d[i]
        d[i + 1] -= factor * up[i]
        up[i + 1] -= factor * far[i]
        b[i + 1] -= factor * b[i]
    if abs(d[-1]) < least:
        d[-1] = least
    y = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        y[i] = (b[i] - up[i] * y[i + 1] - far[i] * y[i + 2]) / d[i]
    return np.array(y[:n])


def leading_vectors(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit vector of T per value (falling), one a row."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0) + 2 * np.abs(side).max(initial=0), 1e-300)
    draw = np.random.default_rng(12)
    rows: list[np.ndarray] = []
    first, shift = 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * norm:
            first = i
        # equal values get shifts a little apart, so that their solves differ
        shift = min(float(value), shift - 10 * EPS * norm) if i > first else float(value)
        y = draw.standard_normal(n)
        for _ in range(SOLVES):
            y = solved(diagonal, side, shift, y / np.linalg.norm(y), EPS * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                for other in rows[first:]:
                    y -= (other @ y) * other
        rows.append(y / np.linalg.norm(y))
    return np.array(rows).reshape(len(values), n)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` eigenvalues, falling, that differ from 0 beyond rounding, and their unit vectors, one a row."""
    n = len(matrix)
    size = np.abs(matrix).max(initial=0)
    if not n or not size > 0:
        return np.zeros(0), np.zeros((0, n))
    diagonal, side, reflectors = tridiagonal(matrix / size)
    values = leading_values(diagonal, side, min(k, n))
    values = values[values > n * EPS * np.abs(values).max()]
    vectors = leading_vectors(diagonal, side, values)
    for h in reversed(reflectors):
        vectors -= 2 * np.outer(vectors @ h, h)
    return values * size, vectors
