import random
import zlib

import numpy as np

from slotpack.llm import quality

from .conftest import prose

LABELS = "doc_id long, quality int, toxic int"


def _corpus(n=300):
    r, rows, labels = random.Random(3), [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 40 + i % 90).capitalize() + "."
        if not good:
            text = r.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join([text.split()[0]] * 80)])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(frame, spark):
    rows, labels = _corpus()
    got = {r.doc_id: r.score for r in quality.quality_scores(frame(rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(got[i] >= quality.THRESHOLD) == bool(q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.95
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q, _ in labels]
    again = {r.doc_id: r.score for r in quality.quality_scores(frame(rows), spark.createDataFrame(turned, LABELS)).collect()}
    assert all(abs(got[i] - again[i]) < 1e-9 for i in got)


def test_kept_rows(frame, spark):
    rows, labels = _corpus()
    docs, table = frame(rows), spark.createDataFrame(labels, LABELS)
    kept = quality.keep_good(docs, table)
    scored = {r.doc_id for r in quality.quality_scores(docs, table).where(f"score >= {quality.THRESHOLD}").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == scored


def test_density_difference_is_the_gaussian_one():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    means, roots = rng.normal(size=(2, d)), rng.normal(size=(2, d, d)) + 3 * np.eye(d)
    cov = roots @ roots.transpose(0, 2, 1)
    model = quality.Model(0.5, means, np.linalg.cholesky(cov), 0.3)
    x = rng.normal(size=(20, d))
    direct = [[-0.5 * (v - m) @ np.linalg.inv(c) @ (v - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(means, cov)] for v in x]
    expected = np.clip([b - a + 0.3 for a, b in direct], -quality.CLIP, quality.CLIP)
    assert np.allclose(model.difference(x), expected)


def test_statistics_do_not_depend_on_the_batch(edge_rows):
    texts = [t for _, t in edge_rows]
    whole = quality.statistics(texts)
    assert np.allclose(whole, np.concatenate([quality.statistics([t]) for t in texts])) and np.isfinite(whole).all()
    assert quality.statistics([]).shape == (0, len(quality.STATISTICS))


def test_edge_rows(frame, edge_rows, spark):
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (1, 1, 0), (7, 0, 0), (8, 0, 0), (None, 1, 0), (3, None, 0), (9, 4, 0)]):
        table = spark.createDataFrame(labels, LABELS)
        got = quality.quality_scores(frame(edge_rows), table).collect()
        assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
        assert quality.quality_scores(frame([]), table).collect() == []
        assert quality.keep_good(frame([]), table).collect() == []
