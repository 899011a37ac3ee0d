import numpy as np
import pytest
from pyspark.sql import functions as F

from slotpack.llm import spectrum, whitening

SCHEMA = "vec_id long, embedding array<double>, x int, v int, n int, i int, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 120])
def test_spectrum_slicing(n):
    rng = np.random.default_rng(n)
    half = rng.standard_normal((n, n))
    cases = [half @ half.T, half + half.T, np.ones((n, n)), np.diag(np.round(rng.standard_normal(n) * 2)), np.zeros((n, n)),
             np.array([[0.0, 1.0], [1.0, 0.0]]) if n == 2 else np.diag(np.arange(n) * 1e-9 + 1)]
    for a in cases:
        want = np.linalg.eigvalsh(a)[::-1]
        values, vectors = spectrum.leading(a, 4)
        size = max(np.abs(want).max(), 1e-300)
        assert np.allclose(values, want[:4], rtol=1e-12, atol=1e-13 * size)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size
        for s in [*rng.standard_normal(5), float((want[0] + want[-1]) / 2) + 1e-3]:
            assert spectrum.count_above(a, s) == (want > s).sum()


def brute(rows, components=4):
    """(n, deviation by row, |whitened| columns, explained) from numpy's own decomposition."""
    x = np.floor(256 * np.array([v for _, v in rows], float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    covariance = np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    white = (x - sums / n) @ vectors / np.sqrt(values)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, white, values / np.trace(covariance)


def check(out, rows, components=4):
    n, deviation, white, explained = brute(rows, components)
    got = out.toPandas().sort_values(["vec_id", "component"])
    own = got.whitened.to_numpy().reshape(len(rows), -1)
    sign = np.sign((own * white).sum(0))
    assert np.allclose(own * sign, white, rtol=1e-9, atol=1e-9)
    assert set(got.n) == {n} and got.deviation.to_numpy().reshape(len(rows), -1)[:, 0].tolist() == deviation
    assert np.allclose(got.explained.to_numpy().reshape(len(rows), -1), explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_sample_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whitening.whiten(table), sorted((r.vec_id, list(r.embedding)) for r in table.collect()))


def test_repeated_rows_count_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]
    monkeypatch.setattr(whitening, "PIECE", 7)
    check(whitening.whiten(frame(spark, rows).repartition(3)), rows)


def test_unusable_rows_are_dropped(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(20)]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [1.0, 2.0, float("-inf")]),
           (54, [1.0]), (55, [])]
    out = whitening.whiten(frame(spark, rows + bad))
    check(out, rows, 3)
    assert out.where(F.col("vec_id") >= 50).count() == 0


def test_edges(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whiten(frame(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [
        (None, 1, 0, 0.0, 0.0, None)] * 4
    wide = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, -0.5])])).collect()
    assert {r.deviation for r in wide if r.vec_id == 1} == {None} and {r.n for r in wide} == {3}
    assert np.isfinite([r.whitened for r in wide]).all()


def test_quantised_values_keep_their_bits():
    values = np.array([[0.0, -0.001, 1e300, -1e300, 0.00390625, 36028797018963968.0]])
    x = whitening.quantised(values)
    assert x.tolist() == [[0, -1, 2 ** 63 - 1, -2 ** 63, 1, 2 ** 63 - 1]]
    import pyarrow as pa
    rows = np.array([[1, -128], [300, 0], [-40000, 7], [2 ** 62, -2 ** 63]])
    assert (whitening.unpacked(pa.array(whitening.packed(rows)), 2) == rows).all()
