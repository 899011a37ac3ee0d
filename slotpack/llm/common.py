"""Shared pieces of the training-data operators: input shape, label split, skew-safe lookup."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotpack.session import materialize

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A lookup broadcasts only keys that hold over 1/HOT_SHARE of the rows: there are fewer than HOT_SHARE.
HOT_SHARE = 4096
#: Ids that one broadcast may hold; more are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: a lost executor re-reads instead of recomputing."""
    return materialize(df, name)


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose worker hands memory back when a task ends, as it lives on for other stages."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return rows.mapInArrow(whole, schema)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", size: str | None = None) -> DataFrame:
    """Join ``rows`` with ``table`` (at most one row per key) although a few keys may hold most rows.

    Both sides must be stored tables, since they are read more than once. Keys with more than
    1/HOT_SHARE of all rows come first; fewer than HOT_SHARE such keys can exist, so their ``table``
    rows are broadcast and their ``rows`` never move. All other rows meet by a shuffle. ``size`` names
    a column of ``table`` that holds the number of rows of each key; without it they are counted here.
    ``how`` is inner or left.
    """
    least = F.lit(rows.count() / HOT_SHARE)
    if size is None:
        known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        hot = rows.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    else:
        hot = table.where(F.col(size) > least)
    mark = F.xxhash64(*keys)
    found = [r[0] for r in hot.select(mark).collect()]  # fewer than HOT_SHARE
    if not found:
        return rows.join(table, keys, how)
    warm = mark.isin(found)  # a key that shares a hot key's hash may go with it: both sides deal it alike
    hot_rows = rows.where(warm).join(F.broadcast(table.where(warm)), keys, how)
    return hot_rows.unionByName(rows.where(~warm).join(table.where(~warm), keys, how))


def with_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with stored distinct ``doc_id``s; they are broadcast only while they are few."""
    side = ids.select(F.col("doc_id").alias("own_id"))
    if ids.count() <= MOST_BROADCAST_IDS:
        side = F.broadcast(side)
    return rows.join(side, F.col("doc_id").eqNullSafe(F.col("own_id")), how)
