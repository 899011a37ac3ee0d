"""Words of whole texts as 64-bit hashes, for a batch of texts at once (numpy).

A word is a longest run of bytes that are not separators in the UTF-8 text. Texts are handled in
pieces of about PIECE_BYTES, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII white space separates words; every other byte belongs to one.
WHITE = _WHITE
_PLAIN = np.ones(256, bool)
_PLAIN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1),
        *range(0x80, 0x100)]] = False
#: Everything but ASCII letters, digits and bytes of other scripts separates words.
NOT_ALNUM = _PLAIN
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_FEW_POWERS = 1 << 16


def _powers(n: int) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64, at least ``n`` of them; only the first ones are kept between calls."""
    if n <= _FEW_POWERS:
        return _first_powers()
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)


@cache
def _first_powers() -> np.ndarray:
    return _powers(_FEW_POWERS + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about PIECE_BYTES characters each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE_BYTES:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def text_pieces(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of consecutive texts of about PIECE_BYTES, taken from Arrow piece by piece."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(column):
        before = ends[begin - 1] if begin else 0
        end = min(int(np.searchsorted(ends, before + PIECE_BYTES)) + 1, len(column))
        yield begin, column.slice(begin, end - begin).to_pylist()
        begin = end


def _letters(texts: list[str | None], separators: np.ndarray, lower: bool):
    """(bytes of all words, the same weighted, their places in the word, first byte and size of words, bounds)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    inside = ~separators[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    at = np.flatnonzero(inside)
    first = np.cumsum(sizes) - sizes
    within = np.arange(len(at), dtype=np.int64) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        value = (data[at].astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max(initial=0)) + 1)[within]
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
    return data[at], value, within, first, sizes, bounds


def word_hashes(texts: list[str | None], separators: np.ndarray = WHITE, lower: bool = True
                ) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in text order, bounds): words of text i are hashes[bounds[i]:bounds[i+1]].

    ``lower`` folds ASCII A-Z. Null counts as empty.
    """
    stems, bounds = stem_hashes(texts, (), separators, lower)
    return stems[0], bounds


def stem_hashes(texts: list[str | None], lengths: tuple[int, ...], separators: np.ndarray = WHITE, lower: bool = True
                ) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, with a row of hashes for whole words and one for their first n bytes, n in ``lengths``.

    A word of at most n bytes has its whole hash there too.
    """
    _, value, within, first, sizes, bounds = _letters(texts, separators, lower)
    if not len(first):
        return np.zeros((1 + len(lengths), 0), np.uint64), bounds
    with np.errstate(over="ignore"):
        whole = _mix(np.add.reduceat(value, first) + sizes.astype(np.uint64) * np.uint64(_BASE))
        out = [whole]
        for n in lengths:
            part = np.add.reduceat(np.where(within < n, value, np.uint64(0)), first)
            out.append(np.where(sizes > n, _mix(part ^ np.uint64(0xC2B2AE3D27D4EB4F * n & (2**64 - 1))), whole))
    return np.stack(out), bounds


def words_and_endings(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes and, for each word, a number made of its last three bytes."""
    letters, value, _, first, sizes, bounds = _letters(texts, WHITE, True)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), bounds
    with np.errstate(over="ignore"):
        whole = _mix(np.add.reduceat(value, first) + sizes.astype(np.uint64) * np.uint64(_BASE))
    last, ending = first + sizes - 1, np.zeros(len(first), np.int64)
    for k in range(3):
        ending = ending * 256 + np.where(sizes > k, letters[np.maximum(last - k, 0)], 0)
    return whole, ending, bounds
