"""Chat formatting: collapse of cumulative snapshots, then rendering.

A logged conversation is often a prefix of a later log of the same conversation. Each turn's rolling
hash stands for the turns up to it; a conversation whose whole hash is the hash of a proper prefix of
another one is dropped by an anti-join, of equal conversations the one with the least id stays. The
maximal conversations are rendered turn by turn in a fixed template.

No conversation is gathered whole: turns are cut into chunks of CHUNK turn numbers, hashes run inside
a chunk and chunks are offset by the totals before them; the rendered text comes in parts of PART
turns, whose concatenation in order is the conversation. The set of prefixes is made distinct before
it meets the conversations, so a first turn that very many share counts once.

Defined results: null role and text count as empty, a null turn as 0; rows with a null conv_id belong
to no conversation and are left out; turns are ordered by turn, role, text, and rows repeated in full
are one turn; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotpack.functions.ordered import chunk_of, dense_position
from slotpack.llm.common import lookup, store

CHUNK = 512
PART = 256


def turns(conversations: DataFrame) -> DataFrame:
    """Stored (conv_id, position, role, text, chunk): distinct turns with their place in the conversation."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).distinct()
    chunk = F.greatest(chunk_of("turn", CHUNK), F.lit(0))
    placed = dense_position(store(rows.withColumn("chunk", chunk), "turns"), ["conv_id"], ["turn", "role", "text"],
                            F.col("chunk"))
    return store(placed.select("conv_id", "position", "role", "text", "chunk"), "positions")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """Stored (conv_id, length, one, two): two rolling hashes of the first ``length`` turns."""
    lanes = [F.xxhash64(F.lit(k), "position", "role", "text").cast("decimal(20,0)") for k in (1, 2)]
    hashed = placed.select("conv_id", "chunk", "position", lanes[0].alias("one"), lanes[1].alias("two"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.select("conv_id", "chunk", (F.col("position") + 1).alias("length"),
                        *[F.sum(c).over(inside).cast("decimal(38,0)").alias(c) for c in ("one", "two")])
    totals = hashed.groupBy("conv_id", "chunk").agg(F.sum("one").alias("one"), F.sum("two").alias("two"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "chunk", *[F.sum(c).over(earlier).cast("decimal(38,0)").alias(f"{c}_before")
                                                  for c in ("one", "two")]).where(F.col("one_before").isNotNull())
    met = run.join(offsets, ["conv_id", "chunk"], "left")
    return store(met.select("conv_id", "length", *[
        (F.col(c) + F.coalesce(f"{c}_before", F.lit(0))).cast("decimal(38,0)").alias(c) for c in ("one", "two")]),
        "prefixes")


def maximal(prefixes: DataFrame) -> DataFrame:
    """Stored (conv_id, n_turns, copies) of the conversations that are no proper prefix of another one."""
    last = prefixes.groupBy("conv_id").agg(F.max("length").alias("length"))
    whole = prefixes.join(last, ["conv_id", "length"])
    key = ["length", "one", "two"]
    groups = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = prefixes.join(last.withColumnRenamed("length", "n"), "conv_id").where("length < n").select(*key).distinct()
    return store(groups.join(proper, key, "left_anti").select("conv_id", F.col("length").alias("n_turns"), "copies"),
                 "maximal")


def segment() -> Column:
    return F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, rendered) of the maximal conversations."""
    placed = turns(conversations)
    kept = maximal(prefix_hashes(placed))
    rows = lookup(placed.drop("chunk"), kept, ["conv_id"], size="n_turns")
    parts = rows.groupBy("conv_id", F.floor(F.col("position") / PART).alias("part"), "n_turns", "copies").agg(
        F.sort_array(F.collect_list(F.struct("position", segment().alias("segment")))).alias("own"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join("own.segment", "").alias("rendered"))
