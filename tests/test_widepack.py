"""Packing and next fit for any capacity, keys and order equal item-by-item recursions."""

import random
import time
from collections import Counter, defaultdict

import pytest

from slotpack.functions import binpack, fillmap
from slotpack.operators import widepack


def first_fit(sizes, cap):
    """Bin of every item: largest first, ties in order, each into the first bin with room; oversized ones alone."""
    free, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = max(sizes[i], 0)
        at = next((j for j, f in enumerate(free) if sizes[i] <= cap and f >= s), None)
        if at is None:
            at = len(free)
            free.append(cap)
        free[at] = max(free[at] - s, 0)
        out[i] = at
    return out


def fill(sizes, cap, u=0):
    """(places, bins, fill, waste) of a plain fold."""
    s, w, at = 0, 0, []
    for b in sizes:
        b = max(b, 0)
        if u and u + b > cap or b >= cap and u:
            s, w, u = s + 1, w + cap - u, 0
        at.append((s, u))
        if b >= cap:
            s, w = s + -(-b // cap), w + -b % cap
        else:
            u += b
            if u == cap:
                s, u = s + 1, 0
    return at, s, u, w


@pytest.mark.parametrize("cap", [1, 7, 32, 50])
def test_maps_equal_a_fold(cap):
    r = random.Random(cap)
    run = lambda: [r.choice([r.randint(0, cap), r.randint(1, max(1, cap // 4)), cap, cap + 3, 0, -1, 2 * cap])
                   for _ in range(r.randint(0, 12))]
    for _ in range(300):
        a, b = run(), run()
        one = fillmap.run_map(a, cap)
        both = fillmap.composed(one, fillmap.run_map(b, cap))
        for m in (one, both):
            assert [u for s in m for u in range(s[0], s[1] + 1)] == list(range(cap))
        for u in range(cap):
            assert fillmap.apply(one, u) == fill(a, cap, u)[1:] and fillmap.apply(both, u) == fill(a + b, cap, u)[1:]


@pytest.mark.parametrize("cap", [32, 100, 5000])
def test_first_fit_runs_equal_items(cap):
    r = random.Random(cap)
    for _ in range(300):
        sizes = [r.choice([r.randint(1, cap), r.randint(1, cap // 8), cap, cap // 2, cap // 3, cap + 5, 0]) for _ in range(r.choice([1, 5, 60]))]
        many, seen = Counter(sizes), Counter()
        runs = binpack.ffd_runs_wide(list(many), list(many.values()), cap)
        got = []
        for s in sizes:
            (_, start, per, low, _), = [x for x in runs if x[0] == s and x[3] <= seen[s] <= x[4]]
            got.append(start + (seen[s] - low) // per)
            seen[s] += 1
        assert got == first_fit(sizes, cap)


def by_masks(sizes, cap):
    """Least bins, and the groups of repeatedly the largest mask whose rest packs into one bin less."""
    n = len(sizes)
    best = [(0, cap)] + [None] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        best[mask] = min(((b, f + sizes[i]) if f + sizes[i] <= cap else (b + 1, sizes[i]))
                         for i in range(n) if mask >> i & 1 for b, f in [best[mask ^ 1 << i]])
    least = [b for b, _ in best]
    rest, out, bin_no = (1 << n) - 1, [None] * n, 0
    while rest:
        sub = rest
        while not (sum(sizes[i] for i in range(n) if sub >> i & 1) <= cap and least[rest ^ sub] == least[rest] - 1):
            sub = (sub - 1) & rest
        for i in range(n):
            if sub >> i & 1:
                out[i] = bin_no
        rest, bin_no = rest ^ sub, bin_no + 1
    return out


@pytest.mark.parametrize("cap", [32, 64, 1000])
def test_exact_equals_masks(cap):
    r = random.Random(cap)
    for _ in range(120):
        sizes = [r.randint(1, cap // r.choice([1, 2, 3])) for _ in range(r.randint(1, 9))]
        assert binpack.exact_bins(sizes, cap) == by_masks(sizes, cap)
    begin = time.time()
    for _ in range(40):
        sizes = [r.randint(cap // 5, cap // 2) for _ in range(20)]
        bins = binpack.exact_bins(sizes, cap)
        assert max(bins) + 1 >= binpack.lower_bound(tuple(sorted(sizes, reverse=True)), cap)
        filled = Counter()
        for b, s in zip(bins, sizes, strict=True):
            filled[b] += s
        assert max(filled.values()) <= cap
    assert time.time() - begin < 20


ITEMS = "a string, b int, day int, seq int, size int, note string"


def rows(seed, cap):
    r, out = random.Random(seed), []
    for g in range(30):
        for i in range(r.choice([1, 3, 20, 21, 70]) if g else 900):
            size = r.choice([r.randint(1, cap), r.randint(1, max(cap // 10, 1)), cap]) if g % 4 else r.choice([0, cap + 3, r.randint(1, cap)])
            out.append((None if g == 1 else f"g{g // 2}", g % 2, i // 5, i % 5, size, "x"))
    r.shuffle(out)
    return out


def grouped(items):
    out = defaultdict(list)
    for a, b, day, seq, size, _ in sorted(items, key=lambda x: (x[2], x[3])):
        out[a, b].append((day, seq, size))
    return out


@pytest.mark.parametrize("cap", [32, 100, 5000])
def test_pack_any_capacity(spark, cap):
    items = rows(cap, cap)
    got = defaultdict(dict)
    for x in widepack.pack(spark.createDataFrame(items, ITEMS), ["a", "b"], ["day", "seq"], "size", cap).collect():
        got[x.a, x.b][x.day, x.seq] = (x["size"], x.bin)
    for key, own in grouped(items).items():
        sizes = [s for _, _, s in own]
        few = len(sizes) <= 20 and min(sizes) > 0 and max(sizes) <= cap
        bins = binpack.exact_bins(sizes, cap) if few else first_fit(sizes, cap)
        assert got[key] == {(d, q): (s, b) for (d, q, s), b in zip(own, bins, strict=True)}


@pytest.mark.parametrize("cap, chunk, fanout", [(32, 256, 256), (5000, 7, 3)])
def test_next_fit_any_capacity(spark, monkeypatch, cap, chunk, fanout):
    monkeypatch.setattr(widepack, "CHUNK", chunk)
    monkeypatch.setattr(widepack, "FANOUT", fanout)
    items = rows(cap + 1, cap)
    at, totals = widepack.next_fit(spark.createDataFrame(items, ITEMS), ["a", "b"], ["day", "seq"], "size", cap)
    got = {(x.a, x.b, x.day, x.seq): (x.slot, x.offset) for x in at.collect()}
    ends = {(x.a, x.b): (x.slots, x.wasted) for x in totals.collect()}
    assert len(got) == len(items)
    for key, own in grouped(items).items():
        places, s, u, w = fill([z for _, _, z in own], cap)
        assert [got[(*key, d, q)] for d, q, _ in own] == places
        assert ends[key] == (s + (u > 0), w + (cap - u if u else 0))


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert widepack.pack(none, ["a"], ["seq"], "size", 10).count() == 0
    at, totals = widepack.next_fit(none, ["a"], ["seq"], "size", 10)
    assert at.count() == 0 and totals.count() == 0
