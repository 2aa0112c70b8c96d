"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

By Sylvester's law V - s I = L D L^T has as many positive pivots in D as V has eigenvalues above s.  Bisecting on these
counts isolates the k-th largest eigenvalue; Rayleigh quotient iteration then converges cubically from inside the interval, and counts on
both sides of the result certify its number.
"""

from __future__ import annotations

import numpy as np

#: The pivot choice of Bunch and Kaufman: the value that balances the growth of 1 x 1 and 2 x 2 steps.
ALPHA = (1 + 17**0.5) / 8


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above ``shift``: positive pivots of an L D L^T with symmetric pivoting by 1 x 1 and 2 x 2 blocks."""
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        down = np.abs(a[1:, 0])
        r = 1 + int(down.argmax()) if len(down) else 0
        most = down[r - 1] if len(down) else 0.0
        if most == 0:  # nothing to eliminate
            positive += a[0, 0] > 0
            a = a[1:, 1:]
            continue
        aside = np.abs(a[r]).copy()
        aside[r] = 0
        if abs(a[0, 0]) * aside.max() >= ALPHA * most * most:
            pivot, wide = [0], 1
        elif abs(a[r, r]) >= ALPHA * aside.max():
            pivot, wide = [r], 1
        else:
            pivot, wide = [0, r], 2
        rest = np.delete(np.arange(len(a)), pivot)
        block, off = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        positive += (block[0, 0] > 0) if wide == 1 else 1  # such a 2 x 2 block has a negative determinant
        a = a[np.ix_(rest, rest)] - (off @ np.linalg.solve(block, off.T) if wide == 2 else np.outer(off[:, 0], off[:, 0]) / block[0, 0])
    return int(positive)


def isolated(matrix: np.ndarray, number: int, floor: float, ceiling: float, width: float) -> tuple[float, float, int]:
    """(low, high, count): an interval with the ``number``-th largest eigenvalue and, unless it is as narrow as ``width``, no other."""
    over_low, over_high = above(matrix, floor), above(matrix, ceiling)
    while over_low - over_high > 1 and ceiling - floor > width:
        middle = (floor + ceiling) / 2
        n = above(matrix, middle)
        if n >= number:
            floor, over_low = middle, n
        else:
            ceiling, over_high = middle, n
    return floor, ceiling, over_low - over_high


def solved(matrix: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """The solution of (matrix - shift) x = right, the shift moved by ``least`` where it is an eigenvalue to the last bit."""
    for move in (0.0, least, -least):
        try:
            x = np.linalg.solve(matrix - (shift + move) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    return right


def _apart(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in others:
            x = x - (u @ x) * u
    return x / np.linalg.norm(x)


def leading(matrix: np.ndarray, most: int = 4) -> list[tuple[float, np.ndarray]]:
    """Up to ``most`` (eigenvalue, unit eigenvector) by falling eigenvalue; eigenvalues that are 0 to working precision are left out.

    Equal eigenvalues, which no shift separates, get orthogonal vectors of their common space.
    """
    d = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if not top > 0:
        return []
    scale = np.ldexp(1.0, -int(np.frexp(top)[1]))  # a power of 2, so that scaling is exact and all eigenvalues are below 1
    a, eps = matrix * scale, float(np.finfo(float).eps)
    width, out = 64 * d * eps, []  # counts and values are right to this much
    while len(out) < min(most, d):
        number = len(out) + 1
        if above(a, width) < number:
            break
        low, high, _ = isolated(a, number, width, 1.0, width)
        others = [u for _, u in out]
        # No entry is zero and none repeats, so that the start has a part of every vector in all but made-up cases.
        start = _apart(np.cos(np.arange(1, d + 1) * (number + 0.5) ** 2) + 0.5, others)
        while True:
            x, value = _settled(a, start, (low + high) / 2, others, polish=high - low > width)
            if above(a, value + 2 * width) < number <= above(a, value - 2 * width):
                break  # certified
            if high - low <= width:
                raise ArithmeticError(f"inertia counts don't certify eigenvalue {number}")
            middle = (low + high) / 2  # another eigenvalue drew the iteration: halve the interval and start again
            low, high = (middle, high) if above(a, middle) >= number else (low, middle)
        out.append((value / scale, x))
    return out


def _settled(a: np.ndarray, x: np.ndarray, shift: float, others: list[np.ndarray], polish: bool) -> tuple[np.ndarray, float]:
    """Inverse iteration leads into the interval; Rayleigh quotients polish, unless the interval is as narrow as values are exact."""
    eps = float(np.finfo(float).eps)
    for _ in range(2 if polish else 6):
        x = _apart(solved(a, shift, x, eps), others)
    value = float(x @ a @ x)
    for _ in range(12 if polish else 0):
        if np.linalg.norm(a @ x - value * x) <= 2 * eps:
            break
        x = _apart(solved(a, value, x, eps), others)
        value = float(x @ a @ x)
    return x, value
