"""Hidden Markov language model of whole texts, trained by Baum-Welch over all training documents.

Tokens are words (runs of bytes other than ASCII white space, A-Z folded) and one end per text. The
unigram base is (c + 1) / (N + V + 1) with counts c of all training tokens. A state emits a class, the
class a word: words with at least 1/OWN_SHARE of all training tokens are classes of their own (there
can be at most OWN_SHARE), every other word belongs to the class of its last three bytes, one of
ENDINGS. Within a class words keep their base proportions, unknown words counting as one word of it.
So the likelihood of a text is that of its class sequence times base(word) / base(class) per token.

Counts: each task counts its own words before the shuffle. Training: each task runs the scaled forward
and backward recursions over its texts' classes and adds up expected counts, which are summed per
class by Spark; what returns to the driver is bounded by OWN_SHARE + ENDINGS classes. Scoring: the
forward recursion over every text. Counts of words: those with at least 1/COMMON_SHARE of the tokens
are sent to the tasks (at most COMMON_SHARE of them); the distinct other words of a block of texts
are joined with the count table and meet the block's texts again, so no word is a hot key.

Words are told apart by 64-bit hashes (expected collisions: V^2 / 2^65).

Defined results: null text counts as empty (one token, the end); null ids train; repeated rows train
as often as they are repeated; without training documents every word is unknown; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotpack.llm.common import remainder, store
from slotpack.llm.words import _mix, pieces, words_and_endings

SPLIT_MODULUS, HELD_OUT = 7, 2
STATES = 8
ROUNDS = 5
OWN_SHARE = 1 << 15
COMMON_SHARE = 1 << 19
ENDINGS = 1 << 12
#: Share of the base distribution in each state's emissions and of the uniform one in its transitions.
BASE_SHARE, UNIFORM_SHARE = 0.02, 0.001
STICKY = 0.9
#: Tokens of the texts whose rare words are counted together, and that are recursed together.
BLOCK = 4_000_000
BATCH = 250_000
END = np.uint64(0x5BD1E9955BD1E995)
END_CODE = -1


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, endings, bounds) of the words of each text and its end."""
    hashes, endings, bounds = words_and_endings(texts)
    at = bounds[1:]
    return (np.insert(hashes, at, END), np.insert(endings, at, END_CODE),
            bounds + np.arange(len(bounds)))


def word_counts(docs: DataFrame) -> DataFrame:
    """Stored (token, ending, n): counts of all tokens of the training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for begin, end in pieces(texts):
                hashes, endings, _ = _tokens(texts[begin:end])
                token, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(endings[first]), pa.array(n.astype(np.int64))],
                    ["token", "ending", "n"])

    counted = docs.where(remainder(SPLIT_MODULUS) != HELD_OUT).select("text").mapInArrow(
        run, "token long, ending long, n long")
    return store(counted.groupBy("token").agg(F.max("ending").alias("ending"), F.sum("n").alias("n")), "counts")


def _ending_class(ending: np.ndarray) -> np.ndarray:
    return (_mix(ending.astype(np.uint64)) % np.uint64(ENDINGS)).astype(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """Totals, the counts of common words, and the classes with their base mass."""

    tokens: int
    distinct: int
    common: np.ndarray  # sorted hashes
    common_counts: np.ndarray
    own: np.ndarray  # sorted hashes of words that are classes, numbered in this order
    mass: np.ndarray  # base probability of each class; the endings follow the own classes

    def classes(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = len(self.own) + _ending_class(endings)
        if len(self.own):
            slot = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            out = np.where(self.own[slot] == hashes, slot, out)
        return out

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of common words, -1 for all others."""
        if not len(self.common):
            return np.full(len(hashes), -1)
        slot = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[slot] == hashes, self.common_counts[slot], -1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    common = counts.where(F.col("n") >= F.lit(max(1, n / COMMON_SHARE))).select("token", "n").toPandas()
    token, many = common["token"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64)
    order = np.argsort(token)
    token, many = token[order], many[order]
    is_own = many >= max(1, n / OWN_SHARE)
    rest = counts.where(F.col("n") < F.lit(max(1, n / OWN_SHARE))).select("ending", "n")
    by_ending = rest.groupBy("ending").agg(F.sum(F.col("n") + 1).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(_ending_class(b.column("ending").to_numpy())), b.column("n")], ["class", "n"])

    masses = by_ending.mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    ending_mass = np.ones(ENDINGS)  # the unknown word of each class
    for r in masses:
        ending_mass[r["class"]] += r["n"]
    mass = np.concatenate([many[is_own] + 1, ending_mass]) / (n + v + 1)
    return Vocabulary(n, v, token, many, token[is_own], mass)


def encoded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Stored texts as classes, one row each, and the distinct rare words of each block, one row each.

    Text rows: row, doc_id, train, n_tokens, classes (16 bits each), common_sum (sum of log10(c + 1) over
    common words), common_known, rare (numbers of rare words in the block's list, 32 bits each). Word
    rows: block, number, token.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            texts = b.column("text").to_pylist()
            for begin, end in pieces(texts):
                hashes, endings, bounds = _tokens(texts[begin:end])
                word, first, slot = np.unique(hashes, return_index=True, return_inverse=True)
                held.append((b.slice(begin, end - begin), word, words.classes(word, endings[first]), words.counts(word),
                             slot, bounds))
                size += len(hashes)
                if size >= BLOCK:
                    yield from _block((part << 32) + number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield from _block((part << 32) + number, held)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       (remainder(SPLIT_MODULUS) != HELD_OUT).alias("train"), "text")
    return store(rows.mapInArrow(
        run, f"block long, row long, doc_id {kind}, train boolean, n_tokens long, classes binary, common_sum double, "
             "common_known long, rare binary, number int, token long"), "encoded")


def _block(block: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["block", "row", "doc_id", "train", "n_tokens", "classes", "common_sum", "common_known", "rare", "number",
             "token"]
    rare = np.unique(np.concatenate([word[count < 0] for _, word, _, count, _, _ in held]))
    for b, word, own_class, count, slot, bounds in held:
        classes = own_class.astype(np.uint16)[slot]
        is_rare = (count < 0)[slot]
        place = np.searchsorted(rare, word).astype(np.int32)[slot[is_rare]]
        cut = np.concatenate([[0], np.cumsum(is_rare)])[bounds]
        value = np.concatenate([[0.0], np.cumsum(np.where(count < 0, 0.0, np.log10(np.maximum(count, 0) + 1.0))[slot])])
        n = b.num_rows
        none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), b.column("row"), b.column("doc_id"), b.column("train"),
             pa.array(np.diff(bounds)),
             pa.array([classes[bounds[i]:bounds[i + 1]].tobytes() for i in range(n)], pa.binary()),
             pa.array(np.diff(value[bounds])), pa.array(np.diff(bounds) - np.diff(cut)),
             pa.array([place[cut[i]:cut[i + 1]].tobytes() for i in range(n)], pa.binary()), *none], names)
    n, like = len(rare), held[0][0]
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), pa.nulls(n, like.column("doc_id").type),
             pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64()),
             pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)),
             pa.array(rare.view(np.int64))], names)


@dataclass(frozen=True)
class Chain:
    """Initial distribution, transitions (from, to) and emissions (class, state)."""

    initial: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def start(mass: np.ndarray) -> Chain:
    """A sticky chain whose states emit the base distribution, each distorted by its own hash of the class."""
    share = mass / mass.sum()
    noise = _mix(np.arange(len(mass) * STATES, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    emit = share[:, None] * (0.5 + (noise >> np.uint64(11)).astype(float).reshape(-1, STATES) / 2**53)
    step = np.full((STATES, STATES), (1 - STICKY) / (STATES - 1))
    np.fill_diagonal(step, STICKY)
    return Chain(np.full(STATES, 1 / STATES), step, emit / emit.sum(axis=0))


@dataclass(frozen=True)
class Lattice:
    """Texts of a batch laid out step by step: the k-th tokens of all texts lie together."""

    owner: np.ndarray  # text of each token
    classes: np.ndarray
    begins: np.ndarray  # first token of each step; the texts of a step are the first ones of the step before

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Lattice:
        sizes = np.array([len(t) for t in texts])
        longest = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([texts[i] for i in longest])
        lengths = sizes[longest]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(place, kind="stable")
        begins = np.concatenate([[0], np.cumsum(np.bincount(place))])
        return cls(np.repeat(longest, lengths)[order], flat[order].astype(np.int64), begins)


def forward(chain: Chain, lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """(scaled forward probabilities, scale) of each token; a text's likelihood is the product of its scales."""
    emit = chain.emit[lat.classes]
    alpha, scale, ones = np.empty_like(emit), np.empty(len(emit)), np.ones(STATES)
    for k in range(len(lat.begins) - 1):
        a, b = lat.begins[k], lat.begins[k + 1]
        if k:
            before = lat.begins[k - 1]
            now = (alpha[before:before + b - a] @ chain.step) * emit[a:b]
        else:
            now = chain.initial * emit[a:b]
        total = now @ ones
        np.divide(now, total[:, None], out=alpha[a:b])
        scale[a:b] = total
    return alpha, scale


def expected(chain: Chain, lat: Lattice, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected (initial, transition, emission) counts of a batch."""
    alpha, scale = forward(chain, lat)
    emit = chain.emit[lat.classes]
    ahead = emit / scale[:, None]  # turned into emission times backward probability, scaled
    beta, back = np.ones_like(alpha), np.ascontiguousarray(chain.step.T)
    for k in range(len(lat.begins) - 2, 0, -1):
        a, b = lat.begins[k], lat.begins[k + 1]
        before = lat.begins[k - 1]
        ahead[a:b] *= beta[a:b]
        np.matmul(ahead[a:b], back, out=beta[before:before + b - a])
    sizes, second = np.diff(lat.begins), lat.begins[1]
    moved = alpha[np.arange(second, len(alpha)) - np.repeat(sizes[:-1], sizes[1:])].T @ ahead[second:]
    gamma = alpha * beta
    emitted = np.column_stack([np.bincount(lat.classes, gamma[:, s], classes) for s in range(STATES)])
    return gamma[:lat.begins[1]].sum(axis=0), moved * chain.step, emitted


def _lattices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(rows, lattice) of texts with about BATCH tokens together; texts of like length share a lattice."""
    texts = [np.frombuffer(x, np.uint16) for x in batch.column("classes").to_pylist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    cut = np.cumsum(sizes[order]) // BATCH
    for rows in np.split(order, np.flatnonzero(np.diff(cut)) + 1):
        if len(rows):
            yield rows, Lattice.of([texts[i] for i in rows])


def baum_welch(texts: DataFrame, chain: Chain, mass: np.ndarray) -> Chain:
    """One round: expected counts of all training texts, summed per task and then per class."""
    n = len(mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((n + STATES + 1, STATES))  # classes, transitions, initial
        for b in batches:
            for _, lat in _lattices(b):
                initial, moved, emitted = expected(chain, lat, n)
                table += np.vstack([emitted, moved, initial])
        own = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(own), *[pa.array(table[own, s]) for s in range(STATES)]],
                                         ["line", *[f"s{s}" for s in range(STATES)]])

    names = [f"s{s}" for s in range(STATES)]
    found = texts.where("train").select("classes").mapInArrow(
        run, ", ".join(["line long", *[f"{c} double" for c in names]]))
    got = found.groupBy("line").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a row per class at most
    table = np.zeros((n + STATES + 1, STATES))
    table[got["line"].to_numpy(np.int64)] = got[names].to_numpy(float)
    share = (mass / mass.sum())[:, None]
    emitted, moved, initial = table[:n], table[n:n + STATES], table[-1]
    emit = (1 - BASE_SHARE) * emitted / np.maximum(emitted.sum(axis=0), 1e-300) + BASE_SHARE * share
    emit = np.where(emitted.sum(axis=0) > 0, emit, share)
    step = moved / np.maximum(moved.sum(axis=1, keepdims=True), 1e-300) + UNIFORM_SHARE / STATES
    step = np.where(moved.sum(axis=1, keepdims=True) > 0, step, chain.step)
    initial = initial + UNIFORM_SHARE if initial.sum() > 0 else chain.initial
    return Chain(initial / initial.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def class_scores(texts: DataFrame, chain: Chain, mass: np.ndarray) -> DataFrame:
    """(row, class_score): log10 likelihood of each text's classes, less the base mass of the classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less = np.log10(mass)
        for b in batches:
            for rows, lat in _lattices(b):
                value = np.log10(forward(chain, lat)[1]) - less[lat.classes]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(pa.array(rows)), pa.array(np.bincount(lat.owner, value, len(rows)))],
                    ["row", "class_score"])

    return texts.select("row", "classes").mapInArrow(run, "row long, class_score double")


def rare_sums(table: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, rare_sum, rare_known): sum of log10(c + 1) and number of known ones over each text's rare words."""
    listed = (table.where("token IS NOT NULL").select("block", "number", "token")
              .join(counts.select("token", "n"), "token").select(F.col("block").alias("list"), "number", "n"))

    def meet(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rare = [np.frombuffer(x, np.int32) for x in texts["rare"]]
        size = max([int(found["number"].max()) + 1 if len(found) else 0, *(int(r.max()) + 1 for r in rare if len(r))])
        n = np.zeros(size, np.int64)
        n[found["number"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        value = np.log10(n + 1.0)
        return pd.DataFrame({"row": texts["row"], "rare_sum": [value[r].sum() for r in rare],
                             "rare_known": [int((n[r] > 0).sum()) for r in rare]})

    texts = table.where("row IS NOT NULL").select("block", "row", "rare")
    return (texts.groupBy("block").cogroup(listed.groupBy("list"))
            .applyInPandas(meet, "row long, rare_sum double, rare_known long"))


def language_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    counts = word_counts(docs)
    words = vocabulary(counts)
    table = encoded(docs, words)
    texts = table.where("row IS NOT NULL")
    chain = start(words.mass)
    for _ in range(rounds):
        chain = baum_welch(texts, chain, words.mass)
    found = (texts.select("row", "doc_id", "n_tokens", "common_sum", "common_known")
             .join(class_scores(texts, chain, words.mass), "row").join(rare_sums(table, counts), "row"))
    base = (F.col("common_sum") + F.col("rare_sum")
            - F.col("n_tokens") * F.lit(float(np.log10(words.tokens + words.distinct + 1))))
    return found.select("doc_id", "n_tokens", (F.col("common_known") + F.col("rare_known")).alias("n_known"),
                        F.lit(words.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
                        (base + F.col("class_score")).alias("score"))
