"""Per-contract report (O34), error rows (O36, O37) and the bulk row projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotpack.functions import columns as C
from slotpack.schema import (BULK_COLUMNS, MAX_EXACT_ITEMS, STATUS_ERROR, STATUS_OK, STRATEGY_EXACT,
                             STRATEGY_FFD)

# Fixed error texts of contracts the packer rejects.
ERR_INVALID_SIZE = "INVALID_SIZE: a packable variable has %d bytes (must be in [1, 32])"
ERR_SLOT_RANGE = "SLOT_OUT_OF_RANGE: slot %s does not fit a 64-bit integer"


def contract_errors(stats: DataFrame, struct_summary: DataFrame | None) -> DataFrame:
    """Contracts that cannot be analysed: (contract_id, error). Q1 and Q3.

    ``stats`` carries per contract ``bad_slot`` (a slot text beyond 64 bits), ``invalid_size`` and
    ``min_packable_size``.
    """
    slot_bad = (stats.where(F.col("bad_slot").isNotNull())
                .select("contract_id", F.format_string(ERR_SLOT_RANGE, F.col("bad_slot")).alias("error")))
    size_bad = (stats.where(F.coalesce(F.col("invalid_size"), F.lit(False)))
                .select("contract_id", F.format_string(ERR_INVALID_SIZE, F.col("min_packable_size")).alias("error")))
    out = slot_bad.unionByName(size_bad)
    if struct_summary is not None:
        out = out.unionByName(struct_summary.where(F.col("_struct_invalid") == 1)
                              .select("contract_id", F.format_string(ERR_INVALID_SIZE, F.col("_struct_invalid_size")).alias("error")))
    return out.groupBy("contract_id").agg(F.min("error").alias("error"))


def contract_report(contracts: DataFrame, strategy: DataFrame, cur_slots: DataFrame, cur_waste: DataFrame,
                    estimate: DataFrame, issue_counts: DataFrame, struct_summary: DataFrame,
                    errors: DataFrame) -> DataFrame:
    """One row per contract with the report scalars and its status."""
    # every figure is one number per contract: stacked and added up in one aggregation
    figures = ["n_vars", "n_packable", "current_slots", "current_wasted", "recommended_slots", "recommended_wasted",
               "n_issues", "structs_total", "structs_improved", "struct_saved_slots"]
    parts = [strategy.select("contract_id", "n_vars", "n_packable"), cur_slots, cur_waste, estimate, issue_counts,
             struct_summary.select("contract_id", "structs_total", "structs_improved", "struct_saved_slots")]
    stacked = reduce(DataFrame.unionByName, [
        p.select("contract_id", *[(F.col(c) if c in p.columns else F.lit(None)).cast("bigint").alias(c) for c in figures])
        for p in parts])
    sums = stacked.groupBy("contract_id").agg(*[F.sum(c).alias(c) for c in figures])
    r = (contracts.select("contract_id", "file", "source_unit", "contract_name", "source_ord", "contract_ord")
         .join(sums, "contract_id", "left").join(errors, "contract_id", "left").fillna(0, figures))
    r = r.withColumn("strategy", F.when(F.col("n_packable") > MAX_EXACT_ITEMS, F.lit(STRATEGY_FFD))
                     .otherwise(F.lit(STRATEGY_EXACT)))
    return r.select(
        "contract_id", "file", "source_unit", "contract_name", "source_ord", "contract_ord",
        F.when(F.col("error").isNull(), F.lit(STATUS_OK)).otherwise(F.lit(STATUS_ERROR)).alias("status"),
        F.coalesce(F.col("error"), F.lit("")).alias("error"),
        F.col("n_vars").cast("bigint").alias("n_vars"),
        F.col("current_slots").cast("bigint").alias("current_slots"),
        F.col("recommended_slots").cast("bigint").alias("recommended_slots"),
        F.col("current_wasted").cast("bigint").alias("current_wasted"),
        F.col("recommended_wasted").cast("bigint").alias("recommended_wasted"),
        "strategy",
        F.col("n_issues").cast("bigint").alias("n_issues"),
        F.col("structs_total").cast("bigint").alias("structs_total"),
        F.col("structs_improved").cast("bigint").alias("structs_improved"),
        F.col("struct_saved_slots").cast("bigint").alias("struct_saved_slots"),
    )


def bulk_rows(report: DataFrame, file_errors: DataFrame | None = None, profile: DataFrame | None = None) -> DataFrame:
    """The 18-column bulk rows: OK rows per contract, one ERROR row per failed file.

    A file fails as a whole when any of its contracts fails (the reference aborts the file on the
    first exception) or when its layout document is rejected (``file_errors``: file, error).
    """
    failed_contracts = (report.where(F.col("status") == STATUS_ERROR)
                        .groupBy("file").agg(F.min_by("error", F.struct("source_ord", "contract_ord")).alias("error")))
    failed = failed_contracts if file_errors is None else failed_contracts.unionByName(
        file_errors.select("file", "error")).groupBy("file").agg(F.min("error").alias("error"))
    ok = report.join(failed.select("file"), "file", "left_anti")
    counters = ["imports_removed", "functions_removed", "types_replaced"]
    if profile is not None:  # counters of the source files; error rows have none
        ok = ok.join(profile.select("file", *counters), "file", "left")
    else:
        ok = ok.select("*", *[F.lit(None).cast("bigint").alias(c) for c in counters])
    ok_rows = ok.select(
        "file", F.col("contract_name").alias("contract"), F.lit(STATUS_OK).alias("status"), F.lit("").alias("error"),
        "current_slots", "recommended_slots",
        (F.col("current_slots") - F.col("recommended_slots")).alias("saved_slots"),
        "current_wasted", "recommended_wasted",
        (F.col("current_wasted") - F.col("recommended_wasted")).alias("saved_wasted"),
        "strategy", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counters],
        "structs_total", "structs_improved", "struct_saved_slots", "source_ord", "contract_ord")
    err_rows = failed.select(
        "file", F.lit("").alias("contract"), F.lit(STATUS_ERROR).alias("status"),
        C.short_error(F.col("error")).alias("error"),
        *[F.lit(0).cast("bigint").alias(c) for c in ["current_slots", "recommended_slots", "saved_slots",
                                                     "current_wasted", "recommended_wasted", "saved_wasted"]],
        F.lit("").alias("strategy"),
        *[F.lit(0).cast("bigint").alias(c) for c in [*counters, "structs_total", "structs_improved", "struct_saved_slots"]],
        F.lit(0).alias("source_ord"), F.lit(-1).alias("contract_ord"))
    rows = ok_rows.unionByName(err_rows).withColumn("modifiers_removed", F.lit(0).cast("bigint"))  # Q9: never assigned
    ints = [c for c in BULK_COLUMNS if c not in ("file", "contract", "status", "error", "strategy")]
    return rows.select("file", "contract", "status", "error",
                       *[F.col(c).cast("bigint").alias(c) if c in ints else F.col(c) for c in BULK_COLUMNS[4:]],
                       "source_ord", "contract_ord")
