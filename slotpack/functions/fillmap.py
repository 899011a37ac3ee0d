"""Next-fit filling of bins of any capacity as maps over the incoming fill.

What a run of items does depends only on the fill u of the open bin that meets it (0 <= u < capacity). A map
is a list of segments (low, high, bins, fill, waste, open) that cover all u in order. In an open segment no
bin closes: the fill after the run is u - low + ``fill``. In any other the first closing leaves a state that
no longer depends on u, and the waste is ``waste`` - (u - low). Maps compose, so a long run of items is cut
into chunks whose maps are computed independently.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

Segment = tuple[int, int, int, int, int, bool]


def run_map(sizes: list[int], cap: int) -> list[Segment]:
    """The map of a run of items; sizes of at least ``cap`` take whole bins, sizes below 1 no room."""
    sizes = [max(b, 0) for b in sizes]
    n, total = len(sizes), [0, *accumulate(sizes)]
    after: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)  # (bins, fill, waste) of the items from j on in a new bin
    for j in range(n - 1, -1, -1):
        m = bisect_left(total, total[j] + cap, j + 1) - 1  # the first item that reaches the capacity
        if m == n:
            after[j] = (0, total[n] - total[j], 0)
            continue
        fill = total[m] - total[j]
        after[j] = _closed(fill, sizes[m], cap, after, m)
    out: list[Segment] = []
    high = cap - 1
    for j, b in enumerate(sizes):
        if high < 0 or b == 0:
            continue
        if b >= cap:
            if total[j] == 0:
                out.append((0, 0, *_closed(0, b, cap, after, j), False))
            low = 1 if total[j] == 0 else 0
            if high >= low:
                out.append((low, high, *_closed(low + total[j], b, cap, after, j), False))
            high = -1
            break
        least = cap - total[j] - b  # this fill is exactly completed, a larger one is closed before the item
        if least < high:
            low = max(least + 1, 0)
            out.append((low, high, *_closed(low + total[j], b, cap, after, j), False))
            high = low - 1
        if high >= 0 and least == high:
            out.append((high, high, *_closed(high + total[j], b, cap, after, j), False))
            high -= 1
    if high >= 0:
        out.append((0, high, 0, total[n], 0, True))
    return sorted(out)


def _closed(fill: int, b: int, cap: int, after: list[tuple[int, int, int]], j: int) -> tuple[int, int, int]:
    """(bins, fill, waste) of the items from j on, where item j of size b closes a bin with this fill."""
    if b >= cap:
        own = ((fill > 0) + -(-b // cap), (cap - fill if fill else 0) + -b % cap)
        rest = after[j + 1]
    elif fill + b == cap:
        own, rest = (1, 0), after[j + 1]
    else:
        own, rest = (1, cap - fill), after[j]
    return own[0] + rest[0], rest[1], own[1] + rest[2]


def apply(segments: list[Segment], fill: int) -> tuple[int, int, int]:
    """(bins closed, fill, waste) of a map for one incoming fill."""
    low, _, bins, out, waste, open_ = segments[bisect_left([s[1] for s in segments], fill)]
    return (bins, out + fill - low, waste) if open_ else (bins, out, waste - (fill - low))


def composed(first: list[Segment], second: list[Segment]) -> list[Segment]:
    """The map of ``first`` followed by ``second``."""
    out: list[Segment] = []
    for low, high, bins, fill, waste, open_ in first:
        if not open_:
            more, end, lost = apply(second, fill)
            out.append((low, high, bins + more, end, waste + lost, False))
            continue
        for low2, high2, bins2, fill2, waste2, open2 in second:
            begin, stop = max(fill, low2), min(fill + high - low, high2)
            if begin <= stop:
                shift = begin - low2
                out.append((low + begin - fill, low + stop - fill, bins2, fill2 + (shift if open2 else 0),
                            waste2 - (0 if open2 else shift), open2))
    return out


def placed(sizes: list[int], cap: int, bins: int, fill: int) -> list[tuple[int, int]]:
    """(bin, offset) of every item of a run that meets ``bins`` closed bins and this fill."""
    out = []
    for b in sizes:
        b = max(b, 0)
        if b >= cap:
            bins += fill > 0
            out.append((bins, 0))
            bins, fill = bins + -(-b // cap), 0
            continue
        if fill + b > cap:
            bins, fill = bins + 1, 0
        out.append((bins, fill))
        fill += b
        if fill == cap:
            bins, fill = bins + 1, 0
    return out
