"""Current-layout metrics and issue detection.

All per-contract figures are partial/final hash aggregations, so a contract with very many
variables is combined map-side before the shuffle. Order-dependent detection (O23) takes the
neighbours of large contracts from one range exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotpack.functions import columns as C
from slotpack.functions import ordered
from slotpack.schema import (ISSUE_ORDER, ISSUE_PARTIAL, PARTIAL_RECOMMENDATION, SEVERITY_LOW,
                             SEVERITY_MEDIUM, SLOT_SIZE)

# Fixed message formats of the two issue kinds.
PARTIAL_MESSAGE = "Slot %s uses only %d of 32 bytes."
ORDER_MESSAGE = "The large type '%s' separates two small variables that could be grouped more efficiently."
ORDER_RECOMMENDATION = "Consider reordering variables %s, %s before %s."


def current_slots(entries: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Max over entries of slot + slots_needed(bytes); contracts without entries get 0."""
    per = entries.groupBy("contract_id").agg(
        F.max(F.col("slot") + C.slots_needed("number_of_bytes")).cast("bigint").alias("current_slots"))
    if contracts is None:
        return per
    return (contracts.select("contract_id").join(per, "contract_id", "left")
            .select("contract_id", F.coalesce("current_slots", F.lit(0)).cast("bigint").alias("current_slots")))


def _slot_groups(entries: DataFrame) -> DataFrame:
    """Entries grouped by start slot: used bytes, slots spanned, wasted bytes."""
    return (entries.groupBy("contract_id", "slot")
            .agg(F.sum("number_of_bytes").cast("bigint").alias("used"))
            .withColumn("slots_spanned", C.slots_needed("used").cast("bigint"))
            .withColumn("wasted", (F.col("slots_spanned") * SLOT_SIZE - F.col("used")).cast("bigint")))


def current_waste(entries: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Per start slot ceil(sum/32)*32 - sum, summed per contract."""
    per = (_slot_groups(entries).groupBy("contract_id")
           .agg(F.sum("wasted").cast("bigint").alias("current_wasted")))
    if contracts is None:
        return per
    return (contracts.select("contract_id").join(per, "contract_id", "left")
            .select("contract_id", F.coalesce("current_wasted", F.lit(0)).cast("bigint").alias("current_wasted")))


def slot_view(entries: DataFrame) -> DataFrame:
    """The current layout per start slot with its variables in offset order."""
    return (entries.groupBy("contract_id", "slot")
            .agg(F.sum("number_of_bytes").cast("bigint").alias("used"),
                 F.count(F.lit(1)).alias("n_vars"),
                 F.sort_array(F.collect_list(F.struct("offset", "ordinal", "label", "type_label",
                                                      "number_of_bytes"))).alias("_vars"))
            .withColumn("slots_spanned", C.slots_needed("used").cast("bigint"))
            .withColumn("wasted", (F.col("slots_spanned") * SLOT_SIZE - F.col("used")).cast("bigint"))
            .withColumn("variables", F.expr("transform(_vars, v -> named_struct("
                                            "'label', v.label, 'type_label', v.type_label, "
                                            "'number_of_bytes', v.number_of_bytes, 'offset', v.offset))"))
            .drop("_vars"))


def partial_slot_waste(entries: DataFrame) -> DataFrame:
    """Start slots using fewer than 32 bytes, labels sorted and comma-joined."""
    g = (entries.groupBy("contract_id", "slot_text")
         .agg(F.sum("number_of_bytes").cast("bigint").alias("used"),
              F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("variable"))
         .where(F.col("used") < SLOT_SIZE))
    return g.select(
        "contract_id",
        F.lit(ISSUE_PARTIAL).alias("code"),
        F.when(F.col("used") <= 16, F.lit(SEVERITY_MEDIUM)).otherwise(F.lit(SEVERITY_LOW)).alias("severity"),
        "variable",
        F.format_string(PARTIAL_MESSAGE, F.col("slot_text"), F.col("used")).alias("message"),
        F.lit(PARTIAL_RECOMMENDATION).alias("recommendation"),
        "slot_text", "used",
    )


def suboptimal_order(entries: DataFrame) -> DataFrame:
    """A >= 32-byte variable whose neighbours in (slot, offset) order are both packable."""
    d = entries.select("contract_id", "slot", "offset", "ordinal", "label", "number_of_bytes",
                       C.is_packable("encoding", "number_of_bytes").alias("packable"))
    d = ordered.group_neighbours(d, ["contract_id"], ["slot", "offset", "ordinal"], ["label", "packable"])
    hit = d.where((F.col("number_of_bytes") >= SLOT_SIZE) & F.col("prev_packable") & F.col("next_packable"))
    return hit.select(
        "contract_id",
        F.lit(ISSUE_ORDER).alias("code"),
        F.lit(SEVERITY_MEDIUM).alias("severity"),
        F.col("label").alias("variable"),
        F.format_string(ORDER_MESSAGE, F.col("label")).alias("message"),
        F.format_string(ORDER_RECOMMENDATION, F.col("prev_label"), F.col("next_label"), F.col("label"))
        .alias("recommendation"),
        "ordinal",
    )


ISSUE_COLUMNS = ["contract_id", "code", "severity", "variable", "message", "recommendation"]


def issues(entries: DataFrame) -> DataFrame:
    """Wasted-slot issues followed by order issues (UNION ALL)."""
    return (partial_slot_waste(entries).select(*ISSUE_COLUMNS)
            .unionByName(suboptimal_order(entries).select(*ISSUE_COLUMNS)))
