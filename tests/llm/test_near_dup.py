import random
from collections import defaultdict

import numpy as np

from slotpack.llm import near_dup
from slotpack.llm.alignment import banded_distance, similar
from slotpack.llm.components import components

from .conftest import prose


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_equals_the_full_program():
    r = random.Random(1)
    for _ in range(1500):
        k = r.choice([2, 3, 9])
        a = [r.randrange(k) for _ in range(r.randrange(13))]
        b = [x for x in a if r.random() < 0.8] + [r.randrange(k) for _ in range(r.randrange(4))]
        d = _distance(a, b)
        for most in range(13):
            assert banded_distance(a, b, most) == min(d, most + 1)
        longer = max(len(a), len(b), 1)
        assert similar(np.array(a, int), np.array(b, int), 0.8) == (d <= int(0.2 * longer + 1e-9))


def _edited(text, share, seed):
    r, out = random.Random(seed), []
    for w in text.split():
        x = r.random()
        if x < share / 3:
            continue
        out.append("changed" if x < share * 2 / 3 else w)
        if share * 2 / 3 < x < share:
            out.append("added")
    return " ".join(out)


def test_near_copies_meet_and_others_do_not(frame):
    rows, truth = [], []
    for g in range(12):
        base = prose(g, 60 + 20 * g)
        rows += [(10 * g, base), (10 * g + 1, base.upper()), (10 * g + 2, _edited(base, 0.05, g)),
                 (10 * g + 3, _edited(base, 0.08, g + 50))]
        truth.append({10 * g + k for k in range(4)})
    rows += [(1000 + k, prose(1000 + k, 120) + " " + prose(0, 60)) for k in range(5)]  # share a passage only
    got = defaultdict(set)
    for r in near_dup.near_groups(frame(rows)).collect():
        got[r.class_id].add(r.doc_id)
    assert sorted(map(sorted, (v for v in got.values() if len(v) > 1))) == sorted(map(sorted, truth))


def test_recall_at_the_threshold():
    r = random.Random(4)
    word = lambda: r.randrange(1, 2**63)

    def meet(a, b):
        values = near_dup.bucket_values(np.array(a + b, np.uint64), np.array([0, len(a), len(a) + len(b)]))
        return bool(set(values[0].tolist()) & set(values[1].tolist()))

    for n in range(5, 15):  # short texts always meet
        for _ in range(40):
            a = [word() for _ in range(n)]
            b = list(a)
            for _ in range(n // 5):
                at = r.randrange(len(b))
                b[at:at + 1] = r.choice([[word()], []]) if len(b) > 0.8 * n else [word()]
            assert _distance(a, b) <= n // 5 and meet(a, b)
    a = [word() for _ in range(9)]
    assert meet(a, a[:4] + [word()] + a[5:])
    for similarity, n in ((0.8, 15), (0.8, 40), (0.8, 64), (0.8, 150), (0.82, 150), (0.85, 150)):
        found = 0
        for _ in range(100):
            a = [word() for _ in range(n)]
            b = list(a)
            for at in r.sample(range(n), int((1 - similarity) * n + 1e-9)):
                b[at] = word()
            found += meet(a, b)
        assert found >= 97


def test_pairs_at_the_threshold_against_brute_force(frame):
    rows = []
    for g in range(60):
        n = (9, 12, 30, 150)[g % 4]
        base, r = prose(500 + g, n).split(), random.Random(g)
        copy = list(base)
        for at in r.sample(range(n), n // 5):
            copy[at] = f"other{at}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    texts = {i: t.split() for i, t in rows}
    similar_pairs = {(a, b) for a in texts for b in texts if a < b and len(texts[a]) == len(texts[b])
                     and similar(np.array(list(map(hash, texts[a]))), np.array(list(map(hash, texts[b]))), 0.8)}
    group = {r.doc_id: r.class_id for r in near_dup.near_groups(frame(rows)).collect()}
    assert sum(group[a] == group[b] for a, b in similar_pairs) >= 59 and len(set(group.values())) <= 61


def _family(g, passage, share, n=200, others=20):
    """Earlier documents with a common passage, then two that are similar to each other only."""
    common, r = prose(7000 + g, int(n * passage)).split(), random.Random(g)
    own = [prose(8000 + 100 * g + k, n - len(common)).split() for k in range(others + 1)]
    late, copy = own[-1], list(own[-1])
    for at in r.sample(range(len(copy)), int(n * share)):
        copy[at] = f"other{at}"
    return [" ".join(common + x) for x in [*own[:-1], late, copy]]


def test_similar_documents_behind_a_common_passage_meet(frame):
    rows, pairs = [], []
    for g in range(12):
        texts = _family(g, *((0.5, 0.1), (0.7, 0.12), (0.78, 0.1), (0.78, 0.18))[g % 4])
        pairs.append((100 * g + len(texts) - 2, 100 * g + len(texts) - 1))
        rows += [(100 * g + k, t) for k, t in enumerate(texts)]
    group = {r.doc_id: r.class_id for r in near_dup.near_groups(frame(rows)).collect()}
    assert [p for p in pairs if group[p[0]] != group[p[1]]] == []
    assert len(set(group.values())) == len(rows) - len(pairs)


def test_large_buckets_compare_components(frame, monkeypatch):
    monkeypatch.setattr(near_dup, "EXACT", 4)
    base, passage = prose(41, 100), prose(42, 75)
    rows = [(i, f"{base} tail{i}") for i in range(40)]
    rows += [(100 + i, f"{passage} {prose(4300 + i // 2, 25)} {'x' * (i % 2)}") for i in range(24)]
    group = {r.doc_id: r.class_id for r in near_dup.near_groups(frame(rows)).collect()}
    assert {group[i] for i in range(40)} == {0}
    assert all(group[100 + i] == 100 + i // 2 * 2 for i in range(24))


def test_recall_in_buckets_that_are_subdivided(frame, monkeypatch):
    """Pairs of similarity 0.80 to 0.85 among many documents with the same passage (a third of each)."""
    monkeypatch.setattr(near_dup, "EXACT", 8)
    rows, pairs, passage = [], [], prose(43, 50).split()
    for g in range(120):
        own = prose(5000 + g, 100).split()
        rows.append((2 * g, " ".join(passage + own)))
        copy, r = passage + own, random.Random(g)
        for at in r.sample(range(50, 150), r.randint(23, 30)):
            copy[at] = f"other{at}"
        if g < 40:
            pairs.append((2 * g, 2 * g + 1))
            rows.append((2 * g + 1, " ".join(copy)))
    group = {r.doc_id: r.class_id for r in near_dup.near_groups(frame(rows)).collect()}
    assert sum(group[a] == group[b] for a, b in pairs) >= 39
    assert len(set(group.values())) >= len(rows) - len(pairs)


def test_sieve_passes_similar_texts():
    r = random.Random(11)
    word = lambda: r.randrange(1, 2**63)
    passed = 0
    for n in (5, 9, 30, 150, 1000):
        for _ in range(60):
            a = [word() for _ in range(n)]
            b = list(a)
            for at in r.sample(range(n), n // 5):
                b[at] = word()
            other = a[:n // 4] + [word() for _ in range(n - n // 4)]
            sign = near_dup.signatures(np.array(a + b + other, np.uint64), np.array([0, n, 2 * n, 3 * n]))
            passed += (sign[0] == sign[1]).sum() >= near_dup.AGREEING
            assert n < 30 or (sign[0] == sign[2]).sum() < near_dup.AGREEING
    assert passed >= 0.99 * 300


def test_steps_of_subdivision_keep_similar_pairs():
    assert all(1 - (1 - (2 / 3) ** words) ** tables >= 0.99 for words, tables in near_dup.TABLES)


def test_large_group_of_near_copies(frame):
    base = prose(77, 80)
    rows = [(i, f"{base} tail{i}") for i in range(500)] + [(1000, prose(5, 50))]
    out = near_dup.near_groups(frame(rows)).collect()
    assert {r.class_id for r in out if r.doc_id < 1000} == {0}
    assert sum(r.kept for r in out) == 2


def test_edge_rows(frame, edge_rows):
    docs = frame(edge_rows)
    out = near_dup.near_groups(docs).collect()
    assert len(out) == len(edge_rows)
    groups = defaultdict(list)
    for r in out:
        groups[r.class_id].append(r)
    assert sum(r.kept for r in out) == 10  # plain, empty, white space, signs, unicode, no id, a, long, special, same id
    assert sorted(str(r.doc_id) for r in groups[7]) == ["7", "8"]
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert near_dup.near_groups(frame([])).collect() == []
    assert near_dup.keep_one(frame([])).collect() == []


def test_components(spark):
    r = random.Random(9)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + \
            [(r.randrange(200, 230), r.randrange(200, 230)) for _ in range(20)] + [(5, 5)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    from slotpack.llm.common import store
    got = dict(map(tuple, components(store(spark.createDataFrame(links, "one long, two long"), "links")).collect()))
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}
    assert components(store(spark.createDataFrame([], "one long, two long"), "links")).collect() == []


def _members(spark, roots, key=1):
    """Rows of one bucket with equal signatures: node i of component roots[i]."""
    rows = [(key, i, 10, r, bytearray(near_dup.SIGNED), [key]) for i, r in enumerate(roots)]
    return spark.createDataFrame(rows, "bucket long, node long, words long, root long, sign binary, own array<long>")


def test_every_member_of_a_large_component_stands_in_its_bucket(spark):
    rows = near_dup.open_members(_members(spark, [0] * 50 + [50, 50, 52])).collect()
    assert sorted(r.node for r in rows) == list(range(53))
    assert {(r.n, r.top.members, r.cross) for r in rows} == {(53, 50, 50 * 3 + 2)}


def test_buckets_of_any_size_are_compared_in_full(spark, monkeypatch):
    """Also those that no subdivision makes smaller, as all signatures are equal."""
    monkeypatch.setattr(near_dup, "TABLES", ((2, 2),))
    for exact, roots in ((8, [0] * 30 + [30, 30, 32]), (4, [*range(20), 0, 0, 1, 1, 1, 1])):
        monkeypatch.setattr(near_dup, "EXACT", exact)
        placed = _members(spark, roots)
        signs = near_dup.store(placed.select("node", "sign"), "signs")
        tried = spark.createDataFrame([(0, len(roots) - 1)], "one long, two long")
        got = near_dup.further_pairs(near_dup.open_members(placed), signs, tried).collect()
        want = {(a, b) for b in range(len(roots)) for a in range(b) if roots[a] != roots[b]} - {(0, len(roots) - 1)}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pairs_of_a_bucket_are_verified_where_they_meet(frame, monkeypatch):
    """Documents with a long common passage, all of which pass the sieve: their rows move to their words, not their pairs."""
    moved, verified = [], near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda pairs, words: moved.append(pairs.count()) or verified(pairs, words))
    passage, n = prose(91, 110).split(), 40
    rows = [(i, " ".join(passage + prose(9100 + i, 40).split())) for i in range(n)]
    copy = rows[-1][1].split()
    rows.append((n, " ".join(copy[:120] + ["other"] + copy[121:])))
    monkeypatch.setattr(near_dup, "LINKED", 8, raising=False)
    out = {r.doc_id: (r.class_id, r.links) for r in near_dup.near_groups(frame(rows)).collect()}
    assert out == {i: (i, 0) for i in range(n - 1)} | {n - 1: (n - 1, 1), n: (n - 1, 1)}
    assert sum(moved) < 10 * n  # all pairs: 820
