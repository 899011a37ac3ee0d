"""Mixing of sources to target weights by balanced sampling with the cube method.

Every source has a target number of words: sources in code point order (null last) weigh 5, 2, 1, 5, 2,
1, ... and share 150 % of all words by weight; no target passes twice its source's words, and what that
cuts off is shared among the others by weight again. A document of a source with target t and s words is
taken t / s times on average: floor(t / s) times for certain, once more with the fractional probability.

Which documents get the further copy is decided by the cube method: the vector of fractional
probabilities moves through the null space of two balance constraints (words and documents taken), in a
random direction until a coordinate reaches 0 or 1, so both totals stay exact. The flight runs in blocks
of documents of one source and one size class (a power of two), at most two of a block stay open; open
ones meet in blocks of the next level until each source holds at most two per class. This small landing
problem (at most 64 documents a source) is solved as a subset sum: whole documents whose words come
nearest to what is open. Where that misses the target by more than LANDING_MISS, documents of the
landing may be taken 0, 1 or 2 times.

In a source of over LANDING documents, those with over 1 / HEAVY of its words (fewer than HEAVY) fly and
land first, and the rate of the others makes up for what their landing took too much or too little.

Blocks are cut by the position in (source, size, id) order, so a source with a third of all rows spreads
over tasks, and results depend neither on partitions nor on the run (directions come from a generator
seeded with the block).

Defined results: null and blank texts have size 0 and take 0 words (copies are still sampled); a null
source is a source of its own; repeated rows are documents of their own; very long texts count as whole;
of a source without words the target is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotpack.functions.ordered import sequence
from slotpack.llm.common import lookup, store, whole_text

#: Weights of the sources in their order, repeating, and the share of all words that the mix has.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BLOCK = 4096
#: Open documents of one block after the flight: one less than a move needs.
OPEN = 2
NEAR = 1e-9
#: Relative miss of a source's target from which the landing may take documents 0, 1 or 2 times.
LANDING_MISS = 0.001
LANDING_STATES = 1 << 15
LANDING = 40
HEAVY = 32


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, skey, size): ``skey`` is the source as a key that is never null."""
    words = F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    source = F.col("source").cast("string")
    return docs.select("doc_id", source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("skey"),
                       words.alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """Stored (skey, n, source_size, target) of every source."""
    per = sizes.groupBy("skey", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = sequence(per, [F.col("source").asc_nulls_last()], "rank", "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = store(ranked.withColumn("weight", weight), "weights")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    full, level = F.lit(False), 0.0
    while True:  # each round fills at least one more source, or is the last
        capped = F.sum(F.when(full, F.col("source_size")).otherwise(0))
        weights = F.sum(F.when(full, 0).otherwise(F.col("weight")))
        used, free = ranked.agg(capped, weights).first()
        if not free:
            break
        new = (SHARE * total - MOST_COPIES * used) / free
        if new == level:
            break
        level = new
        full = F.col("source_size") * MOST_COPIES <= F.col("weight") * F.lit(level)
    target = F.least(F.col("source_size") * F.lit(float(MOST_COPIES)), F.col("weight") * F.lit(float(level)))
    return store(ranked.select("skey", "n", "source_size", target.alias("target")), "targets")


def flight(p: list[float], size: list[int], rng: random.Random) -> None:
    """Move ``p`` in place along directions that keep sum(p) and sum(p * size); at most OPEN stay fractional."""
    held: list[int] = []
    for k, probability in enumerate(p):
        if 0.0 < probability < 1.0:
            held.append(k)
        if len(held) == OPEN + 1:
            a, b, c = held
            u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
            _move(p, held, u if any(u) else [1, -1, 0], rng)
            held = [i for i in held if 0.0 < p[i] < 1.0]
    if len(held) == 2 and size[held[0]] == size[held[1]]:
        _move(p, held, [1, -1], rng)


def _move(p: list[float], held: list[int], u: list[int], rng: random.Random) -> None:
    """One random step along ``u`` or against it, as far as the cube goes; its mean is no move."""
    most = max(abs(x) for x in u)
    step = [x / most for x in u]
    ahead = min((1 - p[i]) / s if s > 0 else p[i] / -s for i, s in zip(held, step, strict=True) if s)
    back = min(p[i] / s if s > 0 else (1 - p[i]) / -s for i, s in zip(held, step, strict=True) if s)
    by = ahead if rng.random() * (ahead + back) < back else -back
    for i, s in zip(held, step, strict=True):
        p[i] += by * s
        if p[i] < NEAR:
            p[i] = 0.0
        elif p[i] > 1 - NEAR:
            p[i] = 1.0


def landing(sizes: list[int], wanted: float, choices: list[tuple[int, ...]]) -> tuple[list[int], float]:
    """Copies of each document, one of its ``choices``, whose words come nearest to ``wanted``; and the miss.

    All sums are tried as far as they differ by more than 1 / LANDING_STATES of the words at hand.
    """
    width = max(1, sum(s * max(c) for s, c in zip(sizes, choices, strict=True)) // LANDING_STATES)
    sums, steps = np.zeros(1, np.int64), []
    for s, own in zip(sizes, choices, strict=True):
        grown = np.concatenate([sums + s * c for c in own])
        _, kept = np.unique(grown // width, return_index=True)
        steps.append((kept % len(sums), np.array(own)[kept // len(sums)]))
        sums = grown[kept]
    at = int(np.argmin(np.abs(sums - wanted)))
    miss, out = abs(float(sums[at]) - wanted), []
    for before, chosen in reversed(steps):
        out.append(int(chosen[at]))
        at = int(before[at])
    return out[::-1], miss


def _flown(block: pa.Table) -> pa.Table:
    """One block after its flight."""
    block = block.sort_by("position")
    p, size = block["p"].to_pylist(), block["size"].to_pylist()
    seed = zlib.crc32(f"{block['skey'][0]}/{block['class'][0]}/{block['position'][0]}".encode("utf-8", "surrogatepass"))
    flight(p, size, random.Random(seed))
    return block.set_column(block.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def _heavy(source: pa.Table) -> pa.Table:
    """The heavy documents of one source with their copies as ``base``; the others can make up for the rest.

    After the flight each open document is taken with its probability. Where the others cannot make up for
    that (0 to MOST_COPIES times their words), all heavy documents are landed so that they can, or nearly.
    """
    source = source.sort_by([("size", "descending"), ("position", "ascending")])
    size, p, base = (source[c].to_pylist() for c in ("size", "p", "base"))
    target, whole = source["target"][0].as_py(), source["source_size"][0].as_py()
    wanted, others = sum(s * (b + x) for s, b, x in zip(size, base, p, strict=True)), whole - sum(size)
    rng = random.Random(zlib.crc32(source["skey"][0].as_py().encode("utf-8", "surrogatepass")))
    flight(p, size, rng)
    copies = [b + (rng.random() < x) for b, x in zip(base, p, strict=True)]

    def miss(own: list[int]) -> float:
        left = target - sum(s * c for s, c in zip(size, own, strict=True))
        return max(-left, left - MOST_COPIES * others, 0.0)

    if miss(copies) > 0:
        every = [tuple(range(MOST_COPIES + 1))] * len(size)
        copies = min([landing(size, goal, every)[0] for goal in (wanted, target, target - MOST_COPIES * others)], key=miss)
    columns = {"base": pa.array(copies, pa.int32()), "p": pa.array([0.0] * len(size), pa.float64())}
    for name, values in columns.items():
        source = source.set_column(source.schema.get_field_index(name), name, values)
    return source


def _landed(source: pa.Table) -> pa.Table:
    """The open documents of one source with 0 or 1 as their ``p`` (-1 to 2 where that misses the target)."""
    source = source.sort_by([("size", "descending"), ("position", "ascending")])
    size, p, base = (source[c].to_pylist() for c in ("size", "p", "base"))
    wanted = sum(s * x for s, x in zip(size, p, strict=True))
    copies, miss = landing(size, wanted, [(0, 1)] * len(size))
    if miss > LANDING_MISS * source["target"][0].as_py():
        copies, _ = landing(size, wanted, [tuple(range(-b, MOST_COPIES + 1 - b)) for b in base])
    return source.set_column(source.schema.get_field_index("p"), "p", pa.array([float(c) for c in copies], pa.float64()))


def _with_rate(rows: DataFrame, target: Column, words: Column) -> DataFrame:
    """Certain copies, probability of one more and size class of every document."""
    rate = F.least(F.when(words > 0, target / words).otherwise(0.0), F.lit(float(MOST_COPIES)))
    return (rows.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("int"))
            .withColumn("p", F.col("rate") - F.col("base")).drop("rate")
            .withColumn("class", F.floor(F.log2(F.col("size") + 1)).cast("int")))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs``."""
    sizes = store(sized(docs), "sizes")
    aims = targets(sizes)
    order = ["skey", F.col("size").desc(), F.col("doc_id").asc_nulls_first(), F.rand(13)]
    placed = store(sequence(sizes.withColumn("salt", order.pop()), [*order, "salt"], "position").drop("salt"), "placed")
    rows = store(_with_rate(lookup(placed, aims, ["skey"], size="n"), F.col("target"), F.col("source_size")), "rows")
    large = (F.col("n") > LANDING) & (F.col("size") * HEAVY > F.col("source_size"))
    heavy = store(rows.where(large).groupBy("skey").applyInArrow(_heavy, rows.schema), "heavy")
    taken = store(heavy.groupBy("skey", "n").agg(F.sum("size").alias("heavy_size"), F.sum(F.col("size") * F.col("base")).alias(
        "heavy_taken")).withColumnRenamed("n", "many"), "heavy-sums")
    met = lookup(rows.where(~large), taken, ["skey"], "left", size="many")
    target = F.greatest(F.col("target") - F.coalesce("heavy_taken", F.lit(0)), F.lit(0.0))
    rows = _with_rate(met, target, F.col("source_size") - F.coalesce("heavy_size", F.lit(0))).select(rows.columns)
    schema, span, done = rows.schema, BLOCK, [heavy]
    level, many = store(rows, "level"), placed.count()
    while True:
        settled = F.col("p").isin(0.0, 1.0)
        done.append(level.where(settled))
        level = level.where(~settled)
        flown = level.groupBy("skey", "class", F.expr(f"position div {span}")).applyInArrow(_flown, schema)
        level = store(flown, "level")
        if span >= many:
            break
        span *= BLOCK // OPEN
    done.append(level.where(F.col("p").isin(0.0, 1.0)))
    ended = level.where(~F.col("p").isin(0.0, 1.0)).groupBy("skey").applyInArrow(_landed, schema)
    done.append(store(ended, "landed"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("base") + F.col("p")).cast("bigint")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                      (F.col("size") * copies).alias("taken"))
