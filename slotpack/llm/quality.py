"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass turns every whole text into a fixed vector of statistics (sizes, shares of byte classes,
repetition of words, word pairs and lines), transformed so that each is roughly bell-shaped. Class
means and covariances come from sums that Spark aggregates over all labelled training rows. Each
covariance is shrunk towards the pooled one and towards a multiple of the identity; its Cholesky
factor is computed once and reused for every score. The score is the calibrated difference of the
classes' Mahalanobis log densities.

Defined results: null text counts as empty and gets the empty text's vector; rows without a label
are scored but never learnt from; labels other than 0 and 1 and null labels are ignored; a label row
that is repeated counts as often as it is repeated; with fewer than two rows in either class the
score of every document is the smoothed share of label 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotpack.llm.common import MOST_BROADCAST_IDS, map_batches, remainder, store, with_ids
from slotpack.llm.words import _mix, pieces, text_pieces, word_hashes

SPLIT_MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Weight of the pooled covariance in each class covariance, and of the scaled identity in the sum.
POOLED_SHARE, IDENTITY_SHARE = 0.2, 0.02
CALIBRATION_BINS = 400
#: Log-density differences are clipped to this range, in which the bins lie.
CLIP = 60.0

STATISTICS = ["words", "word_bytes", "symbols", "upper", "digits", "marks", "bars", "distinct", "repeats", "top_word",
              "pairs", "lines", "same_lines", "marked_words"]
_SPACE = [0x20, *range(0x09, 0x0E)]


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _bytes("0123456789")
_SYMBOL = _bytes("#$%&*+/<=>@[]^_`{}~\\")
_MARK = _bytes("!?")
_BAR = _bytes("|")
_PROSE = np.zeros(256, bool)
_PROSE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *map(ord, ".,;:'-")]] = True


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` owners: the number of distinct hashes and the count of the commonest one."""
    with np.errstate(over="ignore"):
        key = _mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    many, top = np.bincount(owner[first], minlength=n), np.zeros(n, np.int64)
    np.maximum.at(top, owner[first], counts)
    return many, top


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of transformed statistics, as named in STATISTICS, for each text."""
    return np.concatenate([_statistics(texts[a:b]) for a, b in pieces(texts)] or [np.zeros((0, len(STATISTICS)))])


def _statistics(texts: list[str | None]) -> np.ndarray:
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw])
    first = np.cumsum(sizes) - sizes
    total = {k: np.add.reduceat(t[data], first) for k, t in
             (("symbols", _SYMBOL), ("upper", _UPPER), ("digits", _DIGIT), ("marks", _MARK), ("bars", _BAR))}
    hashes, bounds = word_hashes(texts)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(n), count)
    many, top = _distinct(hashes, owner, n)
    same = owner[1:] == owner[:-1]
    repeats = np.bincount(owner[1:][same & (hashes[1:] == hashes[:-1])], minlength=n)
    with np.errstate(over="ignore"):
        pair = (hashes[1:] * np.uint64(3) + hashes[:-1])[same]
    pairs, _ = _distinct(pair, owner[1:][same], n)
    odd = np.add.reduceat(_odd_words(data), first)
    lines, same_lines = np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts):
        own = [x for x in (t or "").split("\n") if x.strip()]
        lines[i], same_lines[i] = len(own), len(own) - len(set(own))
    words = np.maximum(count, 1)
    share = lambda k: np.sqrt(total[k] / sizes)
    return np.column_stack([
        np.log1p(count), np.log1p(sizes / words), share("symbols"), share("upper"), share("digits"), share("marks"),
        share("bars"), np.log((many + 1) / (count + 1)), np.sqrt(repeats / words), np.sqrt(top / words),
        np.log((pairs + 1) / (np.maximum(count - 1, 0) + 1)), np.log1p(lines) - 0.5 * np.log1p(count),
        np.sqrt(same_lines / np.maximum(lines, 1)), np.sqrt(odd / words)])


def _odd_words(data: np.ndarray) -> np.ndarray:
    """1 at the last byte of each word that ends in a byte other than letters, digits and prose marks."""
    space = np.isin(data, _SPACE)
    last = ~space & np.append(space[1:], True)
    return (last & ~_PROSE[data]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Class means, Cholesky factors of the shrunken covariances, log priors and calibration."""

    base: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    log_prior: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0, clipped."""
        density = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        return np.clip(density[1] - density[0] + self.log_prior, -CLIP, CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.offset)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with x the statistics of the whole text; one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, texts in text_pieces(b.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(begin, len(texts)), pa.array(list(statistics(texts)), pa.list_(pa.float64()))],
                    ["doc_id", "x"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {_kind(docs)}, x array<double>")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Training rows of ``rows`` with ``label`` 0 or 1; held-out ids and null labels stay out."""
    own = labels.where(F.col(column).isin(0, 1)).select("doc_id", F.col(column).cast("int").alias("label"))
    return rows.where(remainder(SPLIT_MODULUS) != HELD_OUT).join(own, "doc_id")


def fit(rows: DataFrame) -> Model:
    """Model from stored (x, label) rows: two aggregations over all of them, nothing else reaches the driver."""
    d = len(STATISTICS)
    at = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(at)]
    cross = [F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    got = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *cross).collect()}
    n = [got[k]["n"] if k in got else 0 for k in (0, 1)]
    base = (n[1] + 1) / (sum(n) + 2)
    if min(n) < 2:
        return Model(base)
    means = np.array([[got[k][f"s{i}"] / got[k]["n"] for i in range(d)] for k in (0, 1)])
    own = np.zeros((2, d, d))
    for k in (0, 1):
        for i in range(d):
            for j in range(i, d):
                own[k, i, j] = own[k, j, i] = got[k][f"p{i}_{j}"] / n[k] - means[k, i] * means[k, j]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    mixed = (1 - POOLED_SHARE) * own + POOLED_SHARE * pooled
    flat = np.array([max(np.trace(m) / d, 1e-6) * np.eye(d) for m in mixed])
    factors = np.linalg.cholesky((1 - IDENTITY_SHARE) * mixed + IDENTITY_SHARE * flat)
    raw = Model(base, means, factors, float(np.log(n[1] / n[0])))
    return Model(base, means, factors, raw.log_prior, *_calibrated(rows, raw))


def _calibrated(rows: DataFrame, model: Model) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the labels by binned log-density difference."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = model.difference(np.array(b.column("x").to_pylist(), float).reshape(-1, len(STATISTICS)))
            cell = np.minimum((g + CLIP) / (2 * CLIP) * CALIBRATION_BINS, CALIBRATION_BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("label")], ["cell", "label"])

    counts = rows.select("x", "label").mapInArrow(run, "cell long, label int").groupBy("cell", "label").count()
    got = counts.collect()  # at most 2 * CALIBRATION_BINS rows
    g = (np.array([r["cell"] for r in got]) + 0.5) / CALIBRATION_BINS * 2 * CLIP - CLIP
    y, w = np.array([r["label"] for r in got], float), np.array([r["count"] for r in got], float)
    return logistic(g, y, w)


def logistic(g: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Weighted one-variable logistic regression by Newton steps with a small ridge towards (0, 0)."""
    x, beta = np.column_stack([g, np.ones_like(g)]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every document; statistics are computed once and stored."""
    stored = store(with_statistics(docs), "statistics")
    model = fit(store(labelled(stored, labels, "quality").select("x", "label"), "training"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return stored.mapInArrow(run, f"doc_id {_kind(docs)}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``; columns unchanged.

    Statistics of the labelled documents are computed first, those of all documents in the pass that
    filters them; with more labels than can be broadcast the first pass is over all documents as well.
    """
    own = docs.select("doc_id", "text")
    if labels.count() <= MOST_BROADCAST_IDS:
        own = with_ids(own, store(labels.select("doc_id").distinct(), "ids"), "left_semi")
    stored = store(with_statistics(own), "statistics")
    model = fit(store(labelled(stored, labels, "quality").select("x", "label"), "training"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, texts in text_pieces(b.column("text")):
                good = model.score(statistics(texts)) >= threshold
                yield b.slice(begin, len(texts)).filter(pa.array(good))

    return map_batches(docs, run, docs.schema)
