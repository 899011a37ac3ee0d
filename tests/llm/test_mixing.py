import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from slotpack.llm import mixing

SCHEMA = "doc_id long, text string, source string, skey string, size long, target double, rank int, p int, base int, n int, position int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 5, 1.0, 1, 1, 1, 1, 1) for r in rows], SCHEMA)


def targets(rows):
    """Source size and target of every source, by filling up and resharing."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall("[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(size.values()), set(order)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                free.discard(s)
    return size, target


def check(out, rows, near):
    size, target = targets(rows)
    taken, seen = defaultdict(int), Counter()
    for r in out.collect():
        words = r["size"]
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-6)
        assert r.taken == r.copies * words and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        seen[r.doc_id, r.source, words] += 1
    assert seen == Counter((i, s, len(re.findall("[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows)
    for s in size:
        assert abs(taken[s] - target[s]) <= near * target[s] + 1, s


def corpus(seed, many, sources):
    rng = random.Random(seed)
    return [(i, "w " * int(rng.paretovariate(1.3) * 5), rng.choice(sources)) for i in range(many)]


@pytest.mark.parametrize("block", [4096, 16])
def test_sources_meet_their_targets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = corpus(block, 3000, ["a", "b", "ä", "Z", "", "big", "big", "big", "日"]) + corpus(7, 500, [None])
    check(mixing.mix(frame(spark, rows)), rows, 0.001)


def test_sample_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(mixing.mix(table), [(r.doc_id, r.text, r.source) for r in table.collect()], 0.001)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = corpus(1, 2000, ["a", "b", "c"]) + [(5, "x y", "a")] * 50
    first = sorted(map(tuple, mixing.mix(frame(spark, rows)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sorted(map(tuple, mixing.mix(frame(spark, rows[::-1]).repartition(5)).collect())) == first
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_one_document_outweighs_its_source(spark):
    rows = [(0, "w " * 30000, "a")] + [(i, "w " * (i % 40 + 1), "a") for i in range(1, 1000)] + corpus(3, 900, ["b", "c"])
    check(mixing.mix(frame(spark, rows)), rows, 0.001)
    rows = [(0, "w " * 160000, "b"), (1, "w " * 40000, "a")] + [(i, "w w", "b") for i in range(2, 80)]
    size, target = targets(rows)  # the long one once leaves more than the others can give, twice is further off
    taken = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows)).collect()}
    assert size["b"] < target["b"] < 2 * size["b"]
    assert sum(t for i, t in taken.items() if i != 1) == min((160000 + 312, 320000), key=lambda x: abs(x - target["b"]))


def test_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "\x1f", "b"), (None, None, "b"), (4, "word " * 200000, "c"),
            (5, "one two", "c"), (5, "one two", "c")]
    check(mixing.mix(frame(spark, rows)), rows, 1.0)


def test_flight_keeps_both_totals_and_hits_the_probabilities():
    rng = random.Random(5)
    size = [rng.randint(1, 900) for _ in range(40)]
    start = [0.3] * 40
    mean = [0.0] * 40
    for run in range(2000):
        p = list(start)
        mixing.flight(p, size, random.Random(run))
        assert sum(0 < x < 1 for x in p) <= 2
        assert sum(p) == pytest.approx(12, abs=1e-6)
        assert sum(a * s for a, s in zip(p, size, strict=True)) == pytest.approx(0.3 * sum(size), abs=1e-3)
        mean = [m + x / 2000 for m, x in zip(mean, p, strict=True)]
    assert all(abs(m - 0.3) < 0.06 for m in mean)  # over five standard errors


def test_landing_equals_trying_all():
    rng = random.Random(6)
    for _ in range(200):
        size = [rng.randint(0, 50) for _ in range(rng.randint(0, 8))]
        wanted = rng.random() * sum(size)
        copies, miss = mixing.landing(size, wanted, [(0, 1)] * len(size))
        assert miss == pytest.approx(abs(sum(s * c for s, c in zip(size, copies, strict=True)) - wanted))
        assert miss == pytest.approx(min(abs(sum(s * c for s, c in zip(size, x, strict=True)) - wanted)
                                         for x in itertools.product((0, 1), repeat=len(size))))
