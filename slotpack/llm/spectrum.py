"""Leading eigenvalues of a small symmetric matrix by spectrum slicing.

The inertia of A - sI (signs of the pivots of a symmetric block LDL' factorisation) counts the eigenvalues
above s. Bisection on these counts isolates the k-th largest eigenvalue, Rayleigh quotient iteration
converges to it cubically, and two more counts beside the value certify that it is number k.
"""

from __future__ import annotations

import numpy as np

#: Pivot growth bound of the block factorisation, (1 + sqrt(17)) / 8.
_ALPHA = (1 + 17 ** 0.5) / 8
ROUNDING = 2.0 ** -52


def count_above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``a`` above ``shift``: positive pivots of a - shift * I = P L D L' P'.

    D has blocks of one or two rows, chosen so that the factors cannot grow (diagonal pivoting).
    """
    m = a - shift * np.eye(len(a))
    positive, k, n = 0, 0, len(a)
    while k < n:
        col = np.abs(m[k + 1:, k])
        r = k + 1 + int(col.argmax()) if len(col) else k
        big = col[r - k - 1] if len(col) else 0.0
        two = False
        if big > 0 and abs(m[k, k]) < _ALPHA * big:
            other = np.abs(m[r, k:])
            other[r - k] = 0.0
            most = other.max()
            if abs(m[k, k]) * most >= _ALPHA * big * big:
                pass
            elif abs(m[r, r]) >= _ALPHA * most:
                _swap(m, k, r)
            else:
                two = True
                _swap(m, k + 1, r)
        if two:
            block, rows = m[k:k + 2, k:k + 2], m[k + 2:, k:k + 2]
            positive += int((np.linalg.eigvalsh(block) > 0).sum())
            m[k + 2:, k + 2:] -= rows @ np.linalg.solve(block, rows.T)
            k += 2
        else:
            pivot = m[k, k]
            positive += bool(pivot > 0)
            if pivot != 0:
                rows = m[k + 1:, k]
                m[k + 1:, k + 1:] -= np.outer(rows, rows / pivot)
            k += 1
    return positive


def _swap(m: np.ndarray, i: int, j: int) -> None:
    if i != j:
        m[[i, j]] = m[[j, i]]
        m[:, [i, j]] = m[:, [j, i]]


def _refine(a: np.ndarray, value: float, before: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from ``value``, orthogonal to the vectors ``before`` (columns)."""
    norm = max(float(np.abs(a).sum(1).max()), np.finfo(float).tiny)
    v = np.random.default_rng(seed).standard_normal(len(a))
    eye, shift = np.eye(len(a)), value
    for step in range(50):
        v -= before @ (before.T @ v)
        v /= np.linalg.norm(v)
        if step >= 2:  # two steps with the isolated value choose the vector before the shift follows it
            shift = float(v @ a @ v)
            if np.linalg.norm(a @ v - shift * v) <= 4 * ROUNDING * norm:
                break
        try:
            w = np.linalg.solve(a - shift * eye, v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(a - (shift + 2 * ROUNDING * norm) * eye, v)
        size = np.linalg.norm(w)
        if not np.isfinite(size) or size == 0:
            break
        v = w / size
    v -= before @ (before.T @ v)
    v /= np.linalg.norm(v)
    return float(v @ a @ v), v


def leading(a: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` largest eigenvalues of symmetric ``a``, falling, and unit eigenvectors as columns.

    An eigenvalue that the counts cannot part from its neighbours (equal to rounding) takes any vector of
    their common space that is orthogonal to those before.
    """
    n = len(a)
    many = min(many, n)
    a = (a + a.T) / 2
    reach = float(np.abs(a).sum(1).max(initial=0.0))
    least = 8 * n * ROUNDING * reach
    values, vectors = np.zeros(many), np.zeros((n, many))
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(a, shift)
        return counts[shift]

    for k in range(many):
        low, high = -reach - least, reach + least
        for s in counts:  # cuts made for earlier components
            low, high = (max(low, s), high) if counts[s] > k else (low, min(high, s))
        certified = False
        while not certified:
            while high - low > least and (above(low) != k + 1 or above(high) != k):
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) > k else (low, middle)
            values[k], vectors[:, k] = _refine(a, (low + high) / 2, vectors[:, :k], k + 1)
            certified = above(values[k] - least) > k and above(values[k] + least) <= k
            if not certified:
                if high - low <= least:  # equal to rounding: any vector of the common space will do
                    break
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) > k else (low, middle)
    return values, vectors
