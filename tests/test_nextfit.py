"""Chunked, tree-composed sequential filling equals the item-by-item rule for any tree shape."""

import random

import pytest

from slotpack.functions import nextfit


def reference(sizes):
    s = u = w = 0
    pos = []
    for b in sizes:
        if b >= 32:
            slot = s + (1 if u else 0)
            w += (32 - u if u else 0) + (32 - b % 32 if b % 32 else 0)
            pos.append((slot, 0))
            s, u = slot + (b + 31) // 32, 0
        else:
            if u + b > 32:
                w, s, u = w + 32 - u, s + 1, 0
            pos.append((s, u))
            u += b
            if u == 32:
                s, u = s + 1, 0
    return pos, (s + (1 if u else 0), w + (32 - u if u else 0))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows, ref_pos, ref_tot = [], {}, {}
    for g in range(30):
        n = rng.choice([1, 3, 7, 50, 200])
        sizes = [rng.choice([0, 1, 2, 4, 8, 12, 16, 20, 31, 32, 33, 64]) for _ in range(n)]
        pos, tot = reference(sizes)
        for i, b in enumerate(sizes):
            rows.append((f"g{g}", i, b))
            ref_pos[(f"g{g}", i)] = pos[i]
        ref_tot[f"g{g}"] = tot
    return spark.createDataFrame(rows, "k string, p int, b int"), ref_pos, ref_tot


@pytest.mark.parametrize("chunk,fanout,levels", [(1024, 1024, 3), (4, 2, 3), (3, 3, 1), (2, 2, 0)])
def test_tree_shapes(data, chunk, fanout, levels):
    df, ref_pos, ref_tot = data
    got = {(r.k, r.p): (r.slot, r.offset)
           for r in nextfit.positions(df, ["k"], "p", "b", chunk, fanout, levels).collect()}
    tot = {r.k: (r.slots, r.wasted) for r in nextfit.fold_totals(df, ["k"], "p", "b", chunk, fanout, levels).collect()}
    assert got == ref_pos and tot == ref_tot


def test_groups_within_a_chunk_meet_once(data):
    df, ref_pos, _ = data
    placed = nextfit.positions(df, ["k"], "p", "b")
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.k, r.p): (r.slot, r.offset) for r in placed.collect()} == ref_pos
