"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value theory.

A token is a word or one of its stems (its first STEMS bytes). A token's weight is its log-odds between toxic and clean labelled documents under a Dirichlet prior
that grows with its document frequency in the whole corpus (Monroe et al. 2008); only weights that are
large and significant count: a word scores the weight of itself or else of its longest weighted stem, and every
word costs a small drift. A linear scan finds all maximal scoring segments of a text
(Ruzzo and Tompa 1999). For clean text the best segment of n tokens follows an extreme-value law:
E = K n exp(-lambda S) segments of score S are expected by chance, with lambda from the clean tokens'
score distribution (Karlin and Altschul 1990) and K fitted to clean documents. Segments with E below
SIGNIFICANT are the document's toxic passages; the score is a logistic curve over the strength
-log P(a segment as good by chance).

Weights and curve are learnt from at most SAMPLE labelled training documents (those with the least
hash of the id); corpus frequencies come from all documents. The weights that are sent to the tasks
are bounded by the sample.

Defined results: null text counts as empty and has strength 0; labels other than 0 and 1 are ignored,
a document with several labels counts as toxic if one says so; without toxic or without clean sample
documents the score of every document is the smoothed share of label 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotpack.llm.common import remainder, store
from slotpack.llm.quality import logistic
from slotpack.llm.words import NOT_ALNUM, _mix, pieces, stem_hashes, word_hashes

SPLIT_MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SAMPLE = 50_000
#: Dirichlet prior of a token: FLAT documents and PRIOR times its share of all document frequencies,
#: dealt to the classes by their size.
FLAT, PRIOR = 1.0, 500.0
LEAST_Z = 3.5
#: Smaller weights (odds ratios below about 7) tell a language or topic with more toxic texts, not toxicity.
LEAST_WEIGHT = 2.0
#: Stems: first bytes of longer words, longest last.
STEMS = (5, 7)
#: Fewer toxic documents than this can't make a weight significant.
LEAST_DOCUMENTS = 4
#: Cost of every word; more where clean words would gain on average, which the law excludes.
DRIFT = 0.02
SIGNIFICANT = 0.05


@dataclass(frozen=True)
class Model:
    """Sorted token hashes with weights, extreme-value parameters and the score's curve."""

    base: float
    tokens: np.ndarray | None = None
    weights: np.ndarray | None = None
    drift: float = DRIFT
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    offset: float = 0.0

    def expected(self, score: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Segments at least as good as ``score`` that chance gives in ``tokens`` tokens."""
        return self.scale * np.maximum(tokens, 1) * np.exp(-self.rate * score)

    def strength(self, score: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Logarithm of 1 - log P, with P the chance of a best segment at least as good."""
        e = np.maximum(self.expected(score, tokens), 1e-300)
        p = np.where(e < 1e-8, e, -np.expm1(-e))
        return np.log1p(-np.log(np.minimum(p, 1.0)))

    def score(self, strength: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * strength + self.offset)))


def segments(at: list[int], weight: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a text, in order.

    The tokens at the positions ``at`` score ``weight`` - ``drift`` > 0, all others -``drift``. Each
    candidate keeps the cumulative score before and after it and the nearest earlier candidate that
    starts lower, so the search for the candidate to extend skips all between.
    """
    found: list[list] = []  # [first, last, score before, score after, index of nearest lower start]
    gained = 0.0
    for p, w in zip(at, weight, strict=True):
        before = gained - drift * p
        gained += w
        one = [p, p, before, gained - drift * (p + 1), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= one[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= one[3]:
                one[4] = j
                found.append(one)
                break
            one = [found[j][0], one[1], found[j][2], one[3], found[j][4]]
            del found[j:]
    return [(a, b, end - start) for a, b, start, end, _ in found]


def _hits(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in the piece's word sequence, weight) of every weighted word, and the texts' bounds."""
    stems, bounds = stem_hashes(texts, STEMS, NOT_ALNUM)
    weight = np.zeros(stems.shape[1])
    for row in (*stems[1:], stems[0]):  # later rows are longer and take precedence
        slot = np.minimum(np.searchsorted(model.tokens, row), len(model.tokens) - 1)
        weight = np.where(model.tokens[slot] == row, model.weights[slot], weight)
    at = np.flatnonzero(weight)
    return at, weight[at], bounds


def passages(model: Model, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(number of tokens, maximal segments) of each text."""
    if model.tokens is None or not len(model.tokens):
        for begin, end in pieces(texts):
            yield from ((int(n), []) for n in np.diff(word_hashes(texts[begin:end], NOT_ALNUM)[1]))
        return
    for begin, end in pieces(texts):
        at, weight, bounds = _hits(model, texts[begin:end])
        own = np.searchsorted(at, bounds)
        for i in range(end - begin):
            a, b = own[i], own[i + 1]
            found = segments((at[a:b] - bounds[i]).tolist(), weight[a:b].tolist(), model.drift) if a < b else []
            yield int(bounds[i + 1] - bounds[i]), found


def sample(labels: DataFrame) -> DataFrame:
    """Stored (own_id, label) of at most SAMPLE labelled training documents, by hash of the id."""
    own = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
           .where(remainder(SPLIT_MODULUS) != HELD_OUT)
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    return store(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
                 .select(F.col("doc_id").alias("own_id"), "label"), "sample")


def frequencies(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Stored (token, documents, toxic, clean): document frequencies of every token of the corpus.

    Each task counts its own texts before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, label = b.column("text").to_pylist(), b.column("label").fill_null(-1).to_numpy(False)
            for begin, end in pieces(texts):
                stems, bounds = stem_hashes(texts[begin:end], STEMS, NOT_ALNUM)
                hashes, owner = stems.reshape(-1), np.tile(np.repeat(np.arange(end - begin), np.diff(bounds)), len(stems))
                with np.errstate(over="ignore"):
                    key = _mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                first = np.unique(key, return_index=True)[1]
                token, slot = np.unique(hashes[first], return_inverse=True)
                own_label = label[begin:end][owner[first]]
                counts = [np.bincount(slot, own_label == k if k is not None else None, len(token)).astype(np.int64)
                          for k in (None, 1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *map(pa.array, counts)],
                                                 ["token", "documents", "toxic", "clean"])

    rows = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("own_id"), "left")
    counted = rows.select("text", "label").mapInArrow(run, "token long, documents long, toxic long, clean long")
    sums = [F.sum(c).alias(c) for c in ("documents", "toxic", "clean")]
    return store(counted.groupBy("token").agg(*sums), "frequencies")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    own = sample(labels)
    n = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    base = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    if min(n.get(0, 0), n.get(1, 0)) == 0:
        return Model(base)
    counts = frequencies(docs, own)
    total = counts.agg(*[F.sum(c).alias(c) for c in ("documents", "toxic", "clean")]).first()
    if not total["toxic"] or not total["clean"]:
        return Model(base)
    share = {c: total[c] / (total["toxic"] + total["clean"]) for c in ("toxic", "clean")}
    mass = F.lit(FLAT) + F.lit(PRIOR) * F.col("documents") / F.lit(float(total["documents"]))
    seen = {c: F.col(c) + mass * F.lit(share[c]) for c in share}
    odds = {c: F.log(seen[c] / (F.lit(total[c] + (PRIOR + FLAT) * share[c]) - seen[c])) for c in share}
    weight, spread = odds["toxic"] - odds["clean"], F.sqrt(1 / seen["toxic"] + 1 / seen["clean"])
    kept = (counts.where(F.col("toxic") >= LEAST_DOCUMENTS)
            .select("token", "clean", weight.alias("weight"), (weight / spread).alias("z"))
            .where((F.col("z") >= LEAST_Z) & (F.col("weight") >= LEAST_WEIGHT)).toPandas())  # bounded by the sample
    if not len(kept):
        return Model(base)
    token = kept["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    weights = kept["weight"].to_numpy()[order]
    seen = (kept["clean"].to_numpy()[order] + 0.5) / total["clean"]
    drift = max(DRIFT, 2 * float((seen * weights).sum()))
    gain = weights > drift
    token, weights, seen = token[order][gain], weights[gain], seen[gain]
    if not len(token):
        return Model(base)
    return _calibrated(docs, own, Model(base, token, weights, drift, _rate(weights, seen, drift)))


def _rate(weight: np.ndarray, share: np.ndarray, drift: float) -> float:
    """The positive x at which a clean word's exp(x score) is 1 on average, by bisection."""
    def mean(x: float) -> float:
        return float((share * np.exp(np.minimum(x * (weight - drift), 700))).sum() + (1 - share.sum()) * np.exp(-x * drift))

    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 100:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return max(high, 1e-3)


def best_segments(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, tokens, best, passages) of every document: score of the best and all significant segments."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    passage = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, best, every = [], [], []
            for n, found in passages(model, b.column("text").to_pylist()):
                tokens.append(n)
                best.append(max((s for _, _, s in found), default=0.0))
                every.append([{"first_word": x, "last_word": y, "score": s} for x, y, s in found
                              if model.expected(s, n) < SIGNIFICANT])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(best, pa.float64()),
                 pa.array(every, passage)], ["doc_id", "tokens", "best", "passages"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, tokens long, best double, "
             "passages array<struct<first_word:bigint,last_word:bigint,score:double>>")


def _calibrated(docs: DataFrame, own: DataFrame, model: Model) -> Model:
    """The model with K and the logistic curve fitted to the sample's documents."""
    rows = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("own_id"))
    label = best_segments(rows, model).join(F.broadcast(own), F.col("doc_id") == F.col("own_id"))
    got = label.select("label", "tokens", "best").toPandas()  # at most SAMPLE documents
    y, n, s = (got[c].to_numpy(float) for c in ("label", "tokens", "best"))
    clean = y == 0
    if not clean.any() or clean.all():
        return Model(model.base)
    chance = (np.maximum(n[clean], 1) * np.exp(-model.rate * s[clean])).sum()
    fitted = Model(model.base, model.tokens, model.weights, model.drift, model.rate, float(clean.sum() / max(chance, 1e-300)))
    slope, offset = logistic(fitted.strength(s, n), y, np.ones(len(y)))
    return Model(model.base, model.tokens, model.weights, model.drift, model.rate, fitted.scale, slope, offset)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, passages) of every document."""
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = best_segments(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tokens", "best"))
            score = np.full(len(n), model.base) if model.tokens is None else model.score(model.strength(s, n))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), b.column("passages")],
                                             ["doc_id", "score", "passages"])

    return found.mapInArrow(run, f"doc_id {kind}, score double, {found.schema['passages'].simpleString().replace(':', ' ', 1)}")
