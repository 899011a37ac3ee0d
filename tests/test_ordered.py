"""Chunked dense positions and neighbours equal plain per-group windows, whatever the chunking."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slotpack.functions import ordered


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(9)
    rows = []
    for g in range(25):
        n = rng.choice([1, 2, 5, 40])
        slots = sorted(rng.randint(0, 30) for _ in range(n))
        for i, s in enumerate(slots):
            rows.append((f"g{g}", s, rng.randint(0, 31), i, f"v{i}"))
    return spark.createDataFrame(rows, "k string, slot bigint, off int, ord int, label string")


@pytest.mark.parametrize("size", [1024, 4, 1])
def test_dense_position(df, size):
    got = {(r.k, r.ord): r.position for r in
           ordered.dense_position(df, ["k"], ["slot", "off", "ord"], ordered.chunk_of("slot", size)).collect()}
    w = Window.partitionBy("k").orderBy("slot", "off", "ord")
    want = {(r.k, r.ord): r.p for r in df.select("k", "ord", (F.row_number().over(w) - 1).alias("p")).collect()}
    assert got == want


@pytest.mark.parametrize("size", [1024, 3, 1])
def test_neighbours(df, size):
    got = {(r.k, r.ord): (r.prev_label, r.next_label) for r in
           ordered.neighbours(df, ["k"], ["slot", "off", "ord"], ordered.chunk_of("slot", size), ["label"]).collect()}
    w = Window.partitionBy("k").orderBy("slot", "off", "ord")
    want = {(r.k, r.ord): (r.p, r.n) for r in
            df.select("k", "ord", F.lag("label").over(w).alias("p"), F.lead("label").over(w).alias("n")).collect()}
    assert got == want


def test_sequence_does_not_depend_on_partitions(spark):
    rows = [("big", i % 7, i) for i in range(3000)] + [(f"k{i}", None, i) for i in range(200)] + [(None, 1, 5)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    order = [F.col("k").asc_nulls_last(), F.col("v").asc_nulls_first(), "i"]
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.p: (r.k, r.v, r.i) for r in ordered.sequence(df.repartition(5), order, "p").collect()}
        assert got == dict(enumerate(want))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert ordered.sequence(df.limit(0), order, "p").count() == 0


@pytest.mark.parametrize("most", [4096, 30])
def test_positions_and_neighbours_of_tied_groups(spark, monkeypatch, most):
    """One group has all its rows in one slot; it spreads over tasks, whatever the values repeat."""
    monkeypatch.setattr(ordered, "MOST_ROWS", most)
    rows = [("big", 0, 0, i, f"b{i}") for i in range(3000)] + [(f"k{g}", i // 3, i % 2, i, f"v{i}") for g in range(20) for i in range(g)]
    d = spark.createDataFrame(rows, "k string, slot bigint, off int, ord int, label string").repartition(6)
    w = Window.partitionBy("k").orderBy("slot", "off", "ord")
    want = d.select("k", "ord", (F.row_number().over(w) - 1).alias("p"), F.lag("label").over(w).alias("a"), F.lead("label").over(w).alias("z"))
    placed = {(r.k, r.ord): r.position for r in ordered.group_position(d, ["k"], ["slot", "off", "ord"]).collect()}
    beside = {(r.k, r.ord): (r.prev_label, r.next_label) for r in ordered.group_neighbours(d, ["k"], ["slot", "off", "ord"], ["label"]).collect()}
    assert placed == {(r.k, r.ord): r.p for r in want.collect()}
    assert beside == {(r.k, r.ord): (r.a, r.z) for r in want.collect()}
