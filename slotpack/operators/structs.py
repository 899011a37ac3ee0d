"""Struct optimisation (O31-O33): the packing operators applied to struct members.

Key is (contract_id, type_id). Optimal slots = sum of ceil(bytes/32) over full members + packed
groups + one slot per dynamic member (dynamic members count 1 each here, unlike the contract-level
estimate). Only direct state variables of the struct type count as instances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotpack.functions import columns as C
from slotpack.functions import ordered
from slotpack.operators import packing
from slotpack.schema import MAX_EXACT_ITEMS, STRATEGY_EXACT, STRATEGY_FFD

KEYS = ["contract_id", "type_id"]


def member_bins(fields: DataFrame) -> DataFrame:
    """Bin of every packable member (exact or FFD per struct)."""
    f = packing.classify(fields)
    packable = f.where(F.col("cls") == "packable").select(*KEYS, "ordinal", "number_of_bytes")
    counts = packing.group_counts(packable, KEYS, "number_of_bytes")
    return (packing.pack_exact(packable, KEYS, "ordinal", "number_of_bytes", counts)
            .unionByName(packing.pack_ffd(packable, KEYS, "ordinal", "number_of_bytes", counts)))


def direct_instances(entries: DataFrame) -> DataFrame:
    """Number of state variables whose type id equals the struct's."""
    return (entries.groupBy("contract_id", F.col("type_id"))
            .agg(F.count(F.lit(1)).alias("direct_instances")))


def struct_optimization(structs: DataFrame, fields: DataFrame, entries: DataFrame,
                        bins: DataFrame | None = None) -> DataFrame:
    """Per struct current vs optimal slots, instances, savings, strategy."""
    bins = bins if bins is not None else member_bins(fields)
    f = packing.classify(fields)
    per_class = f.groupBy(*KEYS).agg(
        F.sum(F.when(F.col("cls") == "full", C.ceil_slots("number_of_bytes")).otherwise(0)).alias("_full_slots"),
        F.count_if(F.col("cls") == "dynamic").alias("_n_dynamic"),
        F.count_if(F.col("cls") == "packable").alias("n_packable"),
        F.min(F.when(F.col("cls") == "packable", F.col("number_of_bytes"))).alias("_min_packable"),
        F.count(F.lit(1)).alias("n_fields"))
    n_bins = bins.groupBy(*KEYS, "bin").agg(F.lit(1).alias("_x")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n_bins"))
    s = (structs.select("contract_id", "type_id", "label", "number_of_bytes", "struct_ord")
         .join(per_class, KEYS, "left")
         .join(n_bins, KEYS, "left")
         .join(direct_instances(entries), KEYS, "left")
         .fillna(0, ["_full_slots", "_n_dynamic", "n_packable", "n_fields", "_n_bins", "direct_instances"]))
    current = C.ceil_slots("number_of_bytes")
    optimal = (F.col("_full_slots") + F.col("_n_bins") + F.col("_n_dynamic")).cast("bigint")
    out = (s.withColumn("current_slots", current.cast("bigint"))
           .withColumn("optimal_slots", optimal)
           .withColumn("saved_per_instance", F.col("current_slots") - F.col("optimal_slots"))
           .withColumn("total_saved_slots",
                       (F.col("saved_per_instance") * F.greatest(F.col("direct_instances"), F.lit(0))).cast("bigint"))
           .withColumn("improved", F.col("saved_per_instance") > 0)
           .withColumn("struct_strategy", F.when(F.col("n_packable") > MAX_EXACT_ITEMS, F.lit(STRATEGY_FFD))
                       .otherwise(F.lit(STRATEGY_EXACT)))
           .withColumn("invalid_size", (F.col("n_packable") <= MAX_EXACT_ITEMS)
                       & F.coalesce(F.col("_min_packable") <= 0, F.lit(False))))
    return out.select("contract_id", "type_id", "label", "struct_ord", "n_fields", "current_slots", "optimal_slots",
                      F.col("direct_instances").cast("bigint").alias("direct_instances"),
                      "saved_per_instance", "total_saved_slots", "improved", "struct_strategy", "invalid_size",
                      F.col("_min_packable").alias("min_packable_size"))


def struct_field_order(fields: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """Recommended member order: full members, packed groups (by first member), dynamic members.

    ``position`` counts from 0 inside each struct.
    """
    if bins is None:
        small, large = ordered.split(fields, KEYS, packing.GATHERED)
        placed = packing.numbered(small.select(*KEYS, "ordinal", "label", "encoding", "number_of_bytes"), KEYS, whole=False)
        out = placed.select(*KEYS, "position", "ordinal", "label")
        return out if large is None else out.unionByName(struct_field_order(large, member_bins(large)).select(*out.columns))
    f = packing.classify(fields).join(bins.select(*KEYS, "ordinal", "bin"), [*KEYS, "ordinal"], "left")
    first = bins.groupBy(*KEYS, "bin").agg(F.min("ordinal").alias("_first"))
    f = f.join(first, [*KEYS, "bin"], "left")
    group = F.when(F.col("cls") == "packable", F.col("_first")).otherwise(F.col("ordinal"))
    f = f.select(*KEYS, "ordinal", "label", "type_label", "number_of_bytes", "cls", "cls_rank", group.alias("group"))
    chunk = F.col("cls_rank").cast("bigint") * F.lit(1 << 40) + ordered.chunk_of("group")
    return ordered.dense_position(f, KEYS, ["cls_rank", "group", "ordinal"], chunk, "position")


def contract_struct_summary(opt: DataFrame) -> DataFrame:
    """Per contract: structs total / improved / saved slots (improved ones only) / invalid flag."""
    return opt.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("structs_total"),
        F.count_if("improved").alias("structs_improved"),
        F.coalesce(F.sum(F.when(F.col("improved"), F.col("total_saved_slots"))), F.lit(0)).cast("bigint")
        .alias("struct_saved_slots"),
        F.max(F.col("invalid_size").cast("int")).alias("_struct_invalid"),
        F.min(F.when(F.col("invalid_size"), F.col("min_packable_size"))).alias("_struct_invalid_size"))
