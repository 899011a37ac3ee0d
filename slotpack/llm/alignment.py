"""Edit distance of two word sequences inside a diagonal band, bit-parallel (Hyyrö 2003).

Column j of the dynamic program covers the rows j-t .. j+t; one integer holds the vertical
differences of that window, so a column costs a few operations on integers of 2t+1 bits.
"""

from __future__ import annotations

import numpy as np


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of ``a`` and ``b``, or ``most + 1`` when it is larger than ``most``."""
    if len(a) < len(b):
        a, b = b, a
    shift = len(a) - len(b)  # the last cell lies on this diagonal
    if shift > most:
        return most + 1
    if not b:
        return len(a)
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << (2 * most + 1)) - 1
    goal = 1 << (most + shift)
    up = full >> most << most  # rows from 1 on rise by one in column 0
    down, distance = 0, shift
    for j, w in enumerate(b):
        found = places.get(w, 0)
        low = j - most
        match = (found >> low if low >= 0 else found << -low) & full
        zero = ((((match & up) + up) ^ up) | match | down) & full
        rise = down | (full & ~(zero | up))
        fall = zero & up
        if not zero & goal:
            distance += 1
            if distance > most:
                return most + 1
        below = zero >> 1
        up = fall | (full & ~(below | rise))
        down = below & rise
    return distance


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - distance / longer length is at least ``least``.

    Words in common bound the similarity from above; equal ends need no alignment.
    """
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most or longer - _common(a, b) > most:
        return False
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n -= head
    differs = np.flatnonzero(a[len(a) - n:] != b[len(b) - n:])
    tail = n - 1 - int(differs[-1]) if len(differs) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    return banded_distance(a.tolist(), b.tolist(), min(most, max(len(a), len(b)))) <= most


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection."""
    wa, na = np.unique(a, return_counts=True)
    wb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(wa, wb, assume_unique=True, return_indices=True)
    return int(np.minimum(na[ia], nb[ib]).sum())
