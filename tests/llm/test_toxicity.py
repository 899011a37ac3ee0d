import itertools
import random
import zlib

import numpy as np

from slotpack.llm import toxicity

from .conftest import prose


def _maximal(scores):
    """All maximal scoring segments by their definition: split at the best segment, recurse on both sides."""
    def best(a, b):
        top = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if top is None or top[0] <= 1e-12:
            return []
        _, _, i, j = top
        return best(a, i) + [(i, j - 1)] + best(j, b)
    return best(0, len(scores))


def test_segments_match_the_definition():
    r = random.Random(2)
    for _ in range(400):
        n, drift = r.randint(0, 14), 1.0
        at = sorted(r.sample(range(n), r.randint(0, n)))
        weight = [1 + r.choice([0.37, 1.13, 2.71, 4.19]) + r.random() / 1000 for _ in at]
        scores = [-drift] * n
        for p, w in zip(at, weight, strict=True):
            scores[p] += w
        got = toxicity.segments(at, weight, drift)
        assert [(a, b) for a, b, _ in got] == _maximal(scores)
        assert all(abs(s - sum(scores[a:b + 1])) < 1e-9 for a, b, s in got)


def test_rate_solves_its_equation():
    weight, share, drift = np.array([2.0, 3.5]), np.array([0.01, 0.002]), 0.1
    x = toxicity._rate(weight, share, drift)
    assert x > 0.1
    assert abs((share * np.exp(x * (weight - drift))).sum() + (1 - share.sum()) * np.exp(-x * drift) - 1) < 1e-6


def _corpus():
    r, rows, labels = random.Random(3), [], []
    for i in range(400):
        words = prose(i, 60).split()
        bad = i % 4 == 0
        if bad:
            at = r.randrange(50)
            words[at:at + 6] = ["vile", "the", "nasty", "rotten", "of", "vile"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_passages(frame, spark):
    rows, labels = _corpus()
    table = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(frame(rows), table).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i].score >= toxicity.THRESHOLD) == bool(dict(labels)[i]) for i in held]) > 0.97
    texts = dict(rows)
    for i in held:
        if labels[i][1]:
            assert any("vile" in texts[i].split()[p.first_word:p.last_word + 1] for p in got[i].passages)
        assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_do_not_matter(frame, spark):
    rows, labels = _corpus()
    own = [(i, 1, t) for i, t in labels]
    turned = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(
        frame(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (own, turned))
    assert a == b


def test_edge_rows(frame, edge_rows, spark):
    schema = "doc_id long, quality int, toxic int"
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (2, 0, 1), (2, 0, 0), (None, 1, 1), (3, None, None), (9, 1, 5), (8, 1, 1)]):
        got = toxicity.toxicity_scores(frame(edge_rows), spark.createDataFrame(labels, schema)).collect()
        assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.toxicity_scores(frame([]), spark.createDataFrame(labels, schema)).collect() == []
    assert {round(r.score, 9) for r in toxicity.toxicity_scores(
        frame(edge_rows), spark.createDataFrame([], schema)).collect()} == {0.5}


def test_empty_model_gives_no_passages():
    model = toxicity.Model(0.5, np.zeros(0, np.uint64), np.zeros(0))
    assert [f for _, f in toxicity.passages(model, ["a b", None])] == [[], []]
    assert list(itertools.islice(toxicity.passages(model, ["a b", None]), 2))[0][0] == 2
