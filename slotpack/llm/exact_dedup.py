"""Exact deduplication of an incoming batch against an immutable snapshot.

Texts are equal when identical after every run of ASCII white space becomes one space. Per row a
narrow record (digest, doc_id) is stored once. The snapshot's distinct digests are dealt into buckets
and each bucket gets a static binary-fuse filter. The batch is grouped on its own (its duplicates
among themselves need no snapshot), its distinct digests are screened by the filter of their bucket,
and only positives are joined with the exact digests of the snapshot. Every member of a group of
several rows is then compared byte by byte with the group's first row; rows of a digest collision
are grouped again by text.

Defined results: null text counts as empty, empty texts are equal to each other; null doc_ids come
after all others; of repeated rows (same doc_id and text) one stays; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotpack.llm import fuse
from slotpack.llm.common import lookup, store, whole_text

WHITE_SPACE = r"[\x20\x09-\x0D]+"
KEYS_PER_BUCKET = 100_000
#: Members of one group that are compared with one copy of its first text.
ROWS_PER_COPY = 256


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(whole_text(column), WHITE_SPACE, " ")


def digests(docs: DataFrame) -> DataFrame:
    """Stored (row, doc_id, digest): one narrow record per document; ``row`` tells repeated rows apart."""
    return store(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                             F.unhex(F.sha2(normalised(), 256)).alias("digest")), "digests")


def _key(digest: str = "digest") -> Column:
    """First 64 bits of the digest as a long."""
    return F.xxhash64(F.col(digest))


def _order() -> Column:
    """Rank of a row inside its group: smallest doc_id first, null ids last, then stored order."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")


def groups(rows: DataFrame) -> DataFrame:
    """(digest, first, size) of each group of rows with one digest; pre-aggregated before the shuffle."""
    return rows.groupBy("digest").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("size"))


def filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter): one static binary-fuse filter per bucket of the snapshot's distinct digests."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "filter": [fuse.build(part["key"].to_numpy())]})

    keyed = snapshot.select(F.pmod(_key(), F.lit(buckets)).alias("bucket"), _key().alias("key"))
    return keyed.groupBy("bucket").applyInPandas(build, "bucket long, filter binary")


def screen(batch: DataFrame, snapshot_filters: DataFrame, buckets: int) -> DataFrame:
    """Distinct batch digests whose bucket's filter says that the snapshot may hold them."""
    def probe(incoming: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        data = known["filter"].iloc[0] if len(known) else b""
        return incoming.loc[fuse.probe(data, incoming["key"].to_numpy().astype(np.int64)), ["digest"]]

    keyed = batch.select(F.pmod(_key(), F.lit(buckets)).alias("bucket"), _key().alias("key"), "digest")
    return (keyed.groupBy("bucket").cogroup(snapshot_filters.groupBy("bucket"))
            .applyInPandas(probe, "digest binary"))


def merged(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together: (digest, first, size)."""
    old, new = store(groups(snapshot), "snapshot"), store(groups(batch), "batch")
    buckets = max(1, math.ceil(old.count() / KEYS_PER_BUCKET))
    positive = screen(new, filters(old, buckets), buckets)
    met = (new.join(positive, "digest").select("digest", F.col("first").alias("_first"), F.col("size").alias("_size"))
           .join(old, "digest")
           .select("digest", F.least("first", "_first").alias("first"), (F.col("size") + F.col("_size")).alias("size")))
    met = store(met, "met")
    both = met.select("digest")
    return store(old.join(both, "digest", "left_anti").unionByName(new.join(both, "digest", "left_anti"))
                 .unionByName(met), "groups")


def byte_check(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Texts of ``members`` (doc_id, digest, keep_id, size) that differ from their group's first text.

    A group's first text is copied once per ROWS_PER_COPY members, so a large group spreads over many
    tasks. The result (doc_id, digest, norm) is empty unless two texts share a SHA-256.
    """
    texts = docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"), normalised().alias("norm"))
    wanted = members.groupBy("doc_id", "digest").agg(F.first("keep_id").alias("keep_id"),
                                                     F.first("size").alias("size"))
    texts = store(texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"])
                             & (texts["digest"] == wanted["digest"]))
                  .select(texts["doc_id"], texts["digest"], "norm", "keep_id", "size"), "members")
    copies = F.ceil(F.col("size") / F.lit(ROWS_PER_COPY)).cast("int")
    first = (texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"])
             .select("digest", F.col("norm").alias("first_norm"),
                     F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt")))
    dealt = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), copies).cast("int"))
    return dealt.join(first, ["digest", "salt"]).where(F.col("norm") != F.col("first_norm")) \
        .select("doc_id", "digest", "norm")


def exact_groups(docs: DataFrame, is_snapshot: Column | None = None) -> DataFrame:
    """Per document: row, doc_id, digest, keep_id, size, kept.

    ``is_snapshot`` (over doc_id) tells rows of the immutable snapshot from the incoming batch; by
    default the rows below the median doc_id are the snapshot, of ids that are no numbers half by hash.
    """
    rows = digests(docs)
    if is_snapshot is None and not isinstance(rows.schema["doc_id"].dataType, T.NumericType):
        is_snapshot = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    elif is_snapshot is None:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        is_snapshot = F.coalesce(F.col("doc_id") < F.lit(middle), F.lit(False))
    found = merged(rows.where(is_snapshot), rows.where(~is_snapshot))
    out = lookup(rows, found, ["digest"]).select(
        "row", "doc_id", "digest", F.col("first.doc_id").alias("keep_id"), "size",
        (F.col("row") == F.col("first.row")).alias("kept"))
    out = store(out, "exact")
    return _apart(out, store(byte_check(docs, out.where(F.col("size") > 1)), "unequal"))


def _apart(out: DataFrame, unequal: DataFrame) -> DataFrame:
    """Give rows whose text differs from their group's first text a group of their own text."""
    if unequal.isEmpty():
        return out
    same = [out[k].eqNullSafe(unequal[k]) for k in ("doc_id", "digest")]
    lone = out.join(unequal, reduce(Column.__and__, same)).select(out["row"], out["doc_id"], out["digest"], "norm")
    regrouped = lone.groupBy("digest", "norm").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("size"))
    moved = lone.join(regrouped, ["digest", "norm"]).select(
        "row", "doc_id", "digest", F.col("first.doc_id").alias("keep_id"), "size",
        (F.col("row") == F.col("first.row")).alias("kept"))
    gone = lone.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    stay = (out.join(lone.select("row"), "row", "left_anti").join(gone, "digest", "left")
            .withColumn("size", F.col("size") - F.coalesce("lost", F.lit(0))).drop("lost"))
    return stay.unionByName(moved)


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without later copies of equal texts; columns unchanged.

    A kept row is found again by (doc_id, digest); rows repeated in full are reduced to one.
    """
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    rows = docs.select(F.struct("*").alias("whole"), "doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"))
    found = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")),
                      "left_semi")
    return found.dropDuplicates(["doc_id", "digest"]).select("whole.*")
