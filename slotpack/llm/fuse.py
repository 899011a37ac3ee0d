"""Static binary-fuse filter over 64-bit keys (Graf and Lemire 2022), built and probed with numpy.

Three hash positions per key fall into three consecutive segments. A filter is built once from a set
of distinct keys and never changes. A probe of a member is always true; of another key it is true
with probability 2^-16.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QII")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 finaliser of ``x + seed``."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _shape(n: int) -> tuple[int, int]:
    """(bits of the segment length, number of segments)."""
    bits = max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return bits, max(1, int(np.ceil(max(n, 1) * factor / (1 << bits))))


def _positions(h: np.ndarray, bits: int, segments: int) -> np.ndarray:
    """Three table positions for each hash, in segments s, s+1 and s+2."""
    mask = np.uint64((1 << bits) - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    offsets = [h & mask, (h >> np.uint64(10)) & mask, mix(h, 7) & mask]
    return np.stack([((first + np.uint64(i)) << np.uint64(bits)) + o for i, o in enumerate(offsets)]).astype(np.int64)


def _print_of(h: np.ndarray) -> np.ndarray:
    return (mix(h, 3) >> np.uint64(40)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """Serialised filter over the distinct ``keys``; the empty set gives a filter that rejects all."""
    keys = np.unique(np.asarray(keys).astype(np.uint64))
    if not len(keys):
        return b""
    bits, segments = _shape(len(keys))
    size = (segments + 2) << bits
    for seed in range(1, 200):
        h = mix(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        pos = _positions(h, bits, segments)
        order = _peel(pos, size)
        if order is not None:
            break
    else:
        raise ValueError("no seed gives an acyclic filter")
    table, prints = np.zeros(size, np.uint16), _print_of(h)
    for who, where in reversed(order):
        table[where] = 0
        table[where] = prints[who] ^ table[pos[0, who]] ^ table[pos[1, who]] ^ table[pos[2, who]]
    return _HEAD.pack(seed, bits, segments) + table.tobytes()


def _peel(pos: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their own position) where each key alone holds its position; None if stuck."""
    left, rounds = np.arange(pos.shape[1]), []
    while len(left):
        p = pos[:, left]
        degree = np.bincount(p.ravel(), minlength=size)
        alone = degree[p] == 1
        take = alone.any(axis=0)
        if not take.any():
            return None
        who = left[take]
        rounds.append((who, p[alone.argmax(axis=0)[take], np.flatnonzero(take)]))
        left = left[~take]
    return rounds


def probe(data: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key whether it may be in the set."""
    keys = np.asarray(keys).astype(np.uint64)
    if not data:
        return np.zeros(len(keys), bool)
    seed, bits, segments = _HEAD.unpack_from(data)
    table = np.frombuffer(data, np.uint16, offset=_HEAD.size)
    h = mix(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    pos = _positions(h, bits, segments)
    return (table[pos[0]] ^ table[pos[1]] ^ table[pos[2]]) == _print_of(h)
