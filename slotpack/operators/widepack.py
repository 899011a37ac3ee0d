"""Packing of any groups of items into bins of any capacity (general form of O25, O26, O30, O36b).

``pack`` gives every item of a group its bin: exact for groups of at most ``max_exact`` items of sizes 1 to
the capacity, first-fit decreasing for all others. ``next_fit`` fills bins in the items' order. Groups are
told by any columns (null is a key), items are ordered by any columns.

No group is gathered. A range exchange gives all items dense positions (``ordered.sequence``), so the rank of
an item among the equal sizes of its group is its position minus that of the first; first-fit decreasing
solves the histogram of sizes, which grows with the distinct sizes of a group and not with its items. Next
fit cuts a group into chunks of CHUNK items, composes their maps (``functions.fillmap``) by FANOUT and carries
the state through one row per CHUNK * FANOUT items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotpack.functions import binpack, fillmap
from slotpack.functions.ordered import sequence
from slotpack.schema import MAX_EXACT_ITEMS, SLOT_SIZE
from slotpack.session import materialize

STRETCH = 4096
CHUNK = 256
FANOUT = 256


@lru_cache(maxsize=100_000)
def _exact(sizes: tuple[int, ...], cap: int) -> list[int]:
    return binpack.exact_bins(sizes, cap)


def _placed(items: DataFrame, keys: list[str], order: list[str], size: str, largest_first: bool) -> DataFrame:
    """Stored (_k, _o, _b, _p): key, order columns, size and dense position of every item."""
    d = items.select(F.struct(*keys).alias("_k"), F.struct(*order).alias("_o"), F.col(size).cast("bigint").alias("_b"))
    by = ["_k", F.col("_b").desc(), "_o"] if largest_first else ["_k", "_o"]
    return materialize(sequence(d, by, "_p", "placed"), "placed")


def _named(rows: DataFrame, size: str, *columns: str) -> DataFrame:
    return rows.select("_k.*", "_o.*", F.col("_b").alias(size), *columns)


def pack(items: DataFrame, keys: list[str], order: list[str], size: str, capacity: int = SLOT_SIZE,
         max_exact: int = MAX_EXACT_ITEMS) -> DataFrame:
    """keys, order columns, size and ``bin`` of every item; items larger than ``capacity`` have a bin each."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def exact(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda v: _exact(tuple(int(b) for b in v), capacity))

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def runs(sizes: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([[list(r) for r in binpack.ffd_runs_wide(s, n, capacity)] for s, n in zip(sizes, counts, strict=True)])

    placed = _placed(items, keys, order, size, largest_first=True)
    hist = materialize(placed.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_first")), "sizes")
    groups = hist.groupBy("_k").agg(F.sum("_n").alias("_items"), F.min("_b").alias("_low"), F.max("_b").alias("_high"))
    few = (F.col("_items") <= max_exact) & (F.col("_low") > 0) & (F.col("_high") <= capacity)
    groups = materialize(groups.select("_k", few.alias("_few")), "groups")
    small, large = (groups.where(c).select("_k") for c in (F.col("_few"), ~F.col("_few")))
    vectors = (placed.join(small, "_k", "left_semi").groupBy("_k")
               .agg(F.array_sort(F.collect_list(F.struct("_o", "_p", "_b"))).alias("_v")))
    solved = vectors.withColumn("_bins", exact(F.col("_v._b"))).select("_k", F.explode(F.arrays_zip("_v", "_bins")).alias("_x"))
    out = solved.select("_k", "_x._v._o", "_x._v._b", F.col("_x._bins").cast("bigint").alias("bin"))
    per_group = hist.join(large, "_k", "left_semi").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_b", "_n"))).alias("_h"))
    found = per_group.select("_k", F.explode(runs("_h._b", "_h._n")).alias("r")).select(
        "_k", F.col("r")[0].alias("_b"), F.col("r")[1].alias("_bin"), F.col("r")[2].alias("_per"),
        F.col("r")[3].alias("_low"), F.col("r")[4].alias("_high")).join(hist.select("_k", "_b", "_first"), ["_k", "_b"])
    found = found.withColumn("_low", F.col("_low") + F.col("_first")).withColumn("_high", F.col("_high") + F.col("_first"))
    # a run meets its items by stretches of positions, so very many items of one size spread over tasks
    found = found.withColumn("_s", F.explode(F.expr(f"sequence(_low div {STRETCH}, _high div {STRETCH})")))
    ranked = placed.withColumn("_s", F.expr(f"_p div {STRETCH}")).join(found, ["_k", "_b", "_s"]).where(
        F.col("_p").between(F.col("_low"), F.col("_high")))
    rest = ranked.select("_k", "_o", "_b", (F.col("_bin") + F.expr("(_p - _low) div _per")).alias("bin"))
    return _named(out.unionByName(rest), size, "bin")


_MAP = "array<struct<low: bigint, high: bigint, bins: bigint, fill: bigint, waste: bigint, open: boolean>>"
_FIELDS = ("low", "high", "bins", "fill", "waste", "open")


def _segments(rows: list[dict]) -> list[fillmap.Segment]:
    return [tuple(r[f] for f in _FIELDS) for r in rows]


def _rows(segments: list[fillmap.Segment]) -> list[dict]:
    return [dict(zip(_FIELDS, s, strict=True)) for s in segments]


def next_fit(items: DataFrame, keys: list[str], order: list[str], size: str, capacity: int = SLOT_SIZE
             ) -> tuple[DataFrame, DataFrame]:
    """(positions, totals) of filling bins in order: keys, order columns, size, slot, offset of every item, and
    keys, slots, wasted of every group after its last bin is closed."""
    placed = _placed(items, keys, order, size, largest_first=False)
    kind = placed.schema["_k"].dataType.simpleString()

    @F.pandas_udf(_MAP)
    def maps(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda v: _rows(fillmap.run_map([int(b) for b in v], capacity)))

    @F.pandas_udf(_MAP)
    def joined(parts: pd.Series) -> pd.Series:
        def one(row):
            whole = None
            for p in row:
                own = _segments(p["m"])
                whole = own if whole is None else fillmap.composed(whole, own)
            return _rows(whole)
        return parts.map(one)

    def carried(level: str, states: bool):
        """Streams the maps of a group in order; each row gets the state that meets it, or the last one the totals."""
        names = ["_k", level, "s", "u"] if states else ["_k", "slots", "wasted"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, s, u, w = None, 0, 0, 0
            for b in batches:
                out = []
                for row in b.to_pylist():
                    if row["_k"] != key or (states and row["s0"] is not None):
                        if key is not None and not states:
                            out.append((key, s + (u > 0), w + (capacity - u if u else 0)))
                        key, s, u, w = row["_k"], row["s0"] or 0, row["u0"] or 0, 0
                    if states:
                        out.append((key, row[level], s, u))
                    bins, u, waste = fillmap.apply(_segments(row["m"]), u)
                    s, w = s + bins, w + waste
                yield _batch(out, names, b.schema.field("_k").type)
            if key is not None and not states:
                yield _batch([(key, s + (u > 0), w + (capacity - u if u else 0))], names, b.schema.field("_k").type)

        return run

    def _batch(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, key if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=names)

    chunks = placed.groupBy("_k", F.expr(f"_p div {CHUNK}").alias("_c")).agg(
        F.array_sort(F.collect_list(F.struct("_p", "_o", "_b"))).alias("_v"))
    chunks = materialize(chunks.withColumn("m", maps(F.col("_v._b"))), "chunks")
    outer = F.expr(f"_c div {FANOUT}").alias("_d")
    wide = chunks.groupBy("_k", outer).agg(F.array_sort(F.collect_list(F.struct("_c", "m"))).alias("parts"))
    wide = materialize(wide.select("_k", "_d", joined("parts").alias("m")), "wide")
    none = [F.lit(None).cast("bigint").alias(c) for c in ("s0", "u0")]
    in_order = wide.select("_k", "_d", "m", *none).repartition("_k").sortWithinPartitions("_k", "_d")
    totals = in_order.mapInArrow(carried("_d", False), f"_k {kind}, slots bigint, wasted bigint")
    met = materialize(in_order.mapInArrow(carried("_d", True), f"_k {kind}, _d bigint, s bigint, u bigint"), "met")
    first = F.row_number().over(Window.partitionBy("_k", "_d").orderBy("_c")) == 1
    inner = chunks.select("_k", "_c", outer, "m").join(met, ["_k", "_d"]).select(
        "_k", "_d", "_c", "m", F.when(first, F.col("s")).alias("s0"), F.when(first, F.col("u")).alias("u0"))
    states = inner.repartition("_k", "_d").sortWithinPartitions("_k", "_d", "_c").mapInArrow(
        carried("_c", True), f"_k {kind}, _c bigint, s bigint, u bigint")

    @F.pandas_udf("array<struct<slot: bigint, offset: bigint>>")
    def places(sizes: pd.Series, s: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([[{"slot": x, "offset": y} for x, y in fillmap.placed([int(b) for b in v], capacity, int(a), int(f))]
                          for v, a, f in zip(sizes, s, u, strict=True)])

    at = chunks.drop("m").join(states, ["_k", "_c"]).withColumn("at", places("_v._b", "s", "u"))
    rows = at.select("_k", F.explode(F.arrays_zip("_v", "at")).alias("x")).select(
        "_k", "x._v._o", "x._v._b", "x.at.slot", "x.at.offset")
    return _named(rows, size, "slot", "offset"), totals.select("_k.*", "slots", "wasted")

