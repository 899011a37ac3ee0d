"""Corpus-level reports over bulk rows.

Every summary is one conditional aggregation (partial per task, final on one row); the top lists
use ``orderBy(...).limit(k)``, which Spark plans as a per-partition top-k (TakeOrderedAndProject)
instead of a full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotpack.functions import columns as C
from slotpack.schema import CLI_TOP_N, LEADERBOARD_PAGE, STATUS_EMPTY, STATUS_ERROR, STATUS_OK, WEB_TOP_N

# Detail formats of the CLI top list (translated).
DETAIL_BOTH = "-%d slots (%d state + %d struct)"
DETAIL_STRUCT = "-%d slots (internal struct)"
DETAIL_STATE = "-%d slots, -%d bytes"


def _sum_if(cond, col) -> F.Column:
    return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0)).cast("bigint")


def bulk_summary(rows: DataFrame) -> DataFrame:
    """CLI summary: counts by status and strategy, sums over OK rows (state savings only)."""
    ok = F.col("status") == STATUS_OK
    winner = ok & ((F.col("saved_slots") > 0) | (F.col("struct_saved_slots") > 0))
    return rows.agg(
        F.count_distinct("file").cast("bigint").alias("files"),
        F.count_if(F.col("status") == STATUS_ERROR).cast("bigint").alias("file_errors"),
        F.count_if(ok).cast("bigint").alias("contracts_ok"),
        F.count_if(F.col("status") == STATUS_ERROR).cast("bigint").alias("contracts_error"),
        F.count_if(F.col("status") == STATUS_EMPTY).cast("bigint").alias("contracts_empty"),
        F.count_if(ok & F.col("strategy").startswith("DP")).cast("bigint").alias("strategy_exact"),
        F.count_if(ok & F.col("strategy").startswith("First")).cast("bigint").alias("strategy_ffd"),
        _sum_if(ok, "saved_slots").alias("saved_slots"),
        _sum_if(ok, "saved_wasted").alias("saved_bytes"),
        _sum_if(ok, "structs_total").alias("structs_total"),
        _sum_if(ok, "structs_improved").alias("structs_improved"),
        _sum_if(ok, "struct_saved_slots").alias("struct_saved_slots"),
        F.count_if(winner).cast("bigint").alias("winners"),
    )


def dataset_report(rows: DataFrame) -> DataFrame:
    """O40 + O43: web dataset report (state + struct savings), split by kind, KPIs."""
    ok = F.col("status") == STATUS_OK
    total = F.col("saved_slots") + F.col("struct_saved_slots")
    ffd = F.coalesce(F.col("strategy").startswith("First"), F.lit(False))
    r = rows.withColumn("_kind", C.kind_of("file")).withColumn("_total", total)
    agg = r.agg(
        F.count(F.lit(1)).cast("bigint").alias("contracts_total"),
        F.count_if(ok).cast("bigint").alias("contracts_ok"),
        F.count_if(F.col("status") == STATUS_ERROR).cast("bigint").alias("contracts_error"),
        F.count_if(ok & (F.col("_kind") == "real")).cast("bigint").alias("real_count"),
        F.count_if(ok & (F.col("_kind") == "synthetic")).cast("bigint").alias("synthetic_count"),
        _sum_if(ok, "_total").alias("total_saved_slots"),
        _sum_if(ok, "saved_wasted").alias("total_saved_bytes"),
        _sum_if(ok & (F.col("_kind") == "real"), "_total").alias("real_saved_slots"),
        _sum_if(ok & (F.col("_kind") == "synthetic"), "_total").alias("synthetic_saved_slots"),
        F.count_if(ok & ~ffd).cast("bigint").alias("strategy_exact"),
        F.count_if(ok & ffd).cast("bigint").alias("strategy_ffd"),
        _sum_if(ok, "structs_improved").alias("structs_improved"),
        _sum_if(ok, "struct_saved_slots").alias("struct_saved_slots"),
        F.count_if(ok & (F.col("_total") > 0)).cast("bigint").alias("winners"),
    )
    return _with_shares(agg)


def _with_shares(agg: DataFrame) -> DataFrame:
    """Share of winners and gas."""
    return agg.withColumn(
        "winners_pct",
        F.when(F.col("contracts_ok") == 0, F.lit(0.0))
        .otherwise(F.round(F.col("winners") * 1000.0 / F.col("contracts_ok")) / 10.0)
    ).withColumn("gas_saved", C.gas("total_saved_slots"))


#: What partial sums add up, by kind, strategy tag and status.
SUMS = ["rows", "saved_slots", "saved_wasted", "structs_total", "structs_improved", "struct_saved_slots", "winners", "winners_total"]
DETAIL, WHOLE = 0, 7  # grouping ids of the two sets of partial sums


def _tagged(rows: DataFrame) -> DataFrame:
    total = F.col("saved_slots") + F.col("struct_saved_slots")
    tag = F.when(F.col("strategy").startswith("DP"), F.lit("exact")).when(F.col("strategy").startswith("First"), F.lit("ffd")).otherwise("")
    return rows.select(
        C.kind_of("file").alias("kind"), tag.alias("tag"), "status", "file", F.lit(1).alias("rows"), "saved_slots", "saved_wasted",
        "structs_total", "structs_improved", "struct_saved_slots",
        ((F.col("saved_slots") > 0) | (F.col("struct_saved_slots") > 0)).cast("int").alias("winners"),
        (total > 0).cast("int").alias("winners_total"))


def _added(columns: list[str]) -> list[F.Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns]


def partial_sums(rows: DataFrame) -> DataFrame:
    """Mergeable sums of some bulk rows: one row per (kind, tag, status), and one with the number of files.

    Partial sums of batches that share no file add up to those of all their rows, so the reports below can
    be kept current from a few rows per batch. ``level`` is the grouping id: DETAIL or WHOLE.
    """
    keys = ["kind", "tag", "status"]
    sums = _tagged(rows).groupingSets([[F.col(k) for k in keys], []], *keys).agg(
        F.grouping_id().cast("int").alias("level"), F.count_distinct("file").cast("bigint").alias("files"), *_added(SUMS))
    return sums.select("level", *keys, "files", *SUMS)


def bulk_summary_of(sums: DataFrame) -> DataFrame:
    """O38 from partial sums."""
    d, ok = F.col("level") == DETAIL, F.col("status") == STATUS_OK
    return sums.agg(
        _sum_if(F.col("level") == WHOLE, "files").alias("files"),
        _sum_if(d & (F.col("status") == STATUS_ERROR), "rows").alias("file_errors"),
        _sum_if(d & ok, "rows").alias("contracts_ok"), _sum_if(d & (F.col("status") == STATUS_ERROR), "rows").alias("contracts_error"),
        _sum_if(d & (F.col("status") == STATUS_EMPTY), "rows").alias("contracts_empty"),
        _sum_if(d & ok & (F.col("tag") == "exact"), "rows").alias("strategy_exact"),
        _sum_if(d & ok & (F.col("tag") == "ffd"), "rows").alias("strategy_ffd"),
        _sum_if(d & ok, "saved_slots").alias("saved_slots"), _sum_if(d & ok, "saved_wasted").alias("saved_bytes"),
        *[_sum_if(d & ok, c).alias(c) for c in ("structs_total", "structs_improved", "struct_saved_slots", "winners")])


def dataset_report_of(sums: DataFrame) -> DataFrame:
    """O40 and O43 from partial sums."""
    d = F.col("level") == DETAIL
    ok, kind, ffd = d & (F.col("status") == STATUS_OK), F.col("kind"), F.col("tag") == "ffd"
    s = sums.withColumn("total", F.col("saved_slots") + F.col("struct_saved_slots"))
    return _with_shares(s.agg(
        _sum_if(d, "rows").alias("contracts_total"), _sum_if(ok, "rows").alias("contracts_ok"),
        _sum_if(d & (F.col("status") == STATUS_ERROR), "rows").alias("contracts_error"),
        _sum_if(ok & (kind == "real"), "rows").alias("real_count"),
        _sum_if(ok & (kind == "synthetic"), "rows").alias("synthetic_count"),
        _sum_if(ok, "total").alias("total_saved_slots"), _sum_if(ok, "saved_wasted").alias("total_saved_bytes"),
        _sum_if(ok & (kind == "real"), "total").alias("real_saved_slots"),
        _sum_if(ok & (kind == "synthetic"), "total").alias("synthetic_saved_slots"),
        _sum_if(ok & ~ffd, "rows").alias("strategy_exact"), _sum_if(ok & ffd, "rows").alias("strategy_ffd"),
        _sum_if(ok, "structs_improved").alias("structs_improved"),
        _sum_if(ok, "struct_saved_slots").alias("struct_saved_slots"), _sum_if(ok, "winners_total").alias("winners")))


def savings_cube(sums: DataFrame) -> DataFrame:
    """Sums by kind, by strategy, by status, by kind and status, and of all rows; ``all`` where a column is not split."""
    keys = ["kind", "tag", "status"]
    k, t, s = (F.col(c) for c in keys)
    cube = sums.where(F.col("level") == DETAIL).groupingSets([[k], [t], [s], [k, s], []], *keys).agg(
        *[F.grouping(c).alias(f"_{c}") for c in keys], *_added(SUMS))
    return cube.select(*[F.when(F.col(f"_{c}") == 1, F.lit("all")).otherwise(F.col(c)).alias(c) for c in keys], *SUMS)


def _place(rows: DataFrame) -> str:
    """Last key of a top list: document order, or the name for rows read from a CSV report."""
    return "contract_ord" if "contract_ord" in rows.columns else "contract"


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("total_saved", (F.col("saved_slots") + F.col("struct_saved_slots")).cast("bigint"))


def top_contracts_cli(rows: DataFrame, n: int = CLI_TOP_N) -> DataFrame:
    """CLI top list: winners (state > 0 or struct > 0) by total desc, saved bytes desc."""
    w = _ranked(rows).where((F.col("status") == STATUS_OK)
                            & ((F.col("saved_slots") > 0) | (F.col("struct_saved_slots") > 0)))
    top = w.orderBy(F.desc("total_saved"), F.desc("saved_wasted"), "file", _place(rows)).limit(n)
    detail = (F.when((F.col("struct_saved_slots") > 0) & (F.col("saved_slots") > 0),
                     F.format_string(DETAIL_BOTH, "total_saved", "saved_slots", "struct_saved_slots"))
              .when(F.col("struct_saved_slots") > 0, F.format_string(DETAIL_STRUCT, "struct_saved_slots"))
              .otherwise(F.format_string(DETAIL_STATE, "saved_slots", "saved_wasted")))
    tag = F.when(F.col("strategy").startswith("First"), F.lit("[FFD]")).otherwise(F.lit("[DP] "))
    return top.select("file", "contract", "total_saved", "saved_slots", "saved_wasted", "struct_saved_slots",
                      tag.alias("strategy_tag"), detail.alias("detail"))


def top_contracts_web(rows: DataFrame, n: int = WEB_TOP_N) -> DataFrame:
    """Web top list: OK rows with state + struct savings > 0."""
    w = _ranked(rows).where((F.col("status") == STATUS_OK) & (F.col("total_saved") > 0))
    top = w.orderBy(F.desc("total_saved"), F.desc("saved_wasted"), "file", _place(rows)).limit(n)
    return top.select(
        "file", "contract",
        F.when(F.col("strategy").startswith("First"), F.lit("FFD")).otherwise(F.lit("DP-bitmask")).alias("strategy"),
        C.kind_of("file").alias("kind"),
        F.col("saved_slots"), F.col("saved_wasted").alias("saved_bytes"), "struct_saved_slots", "total_saved")


def leaderboard(top: DataFrame, kind: str | None = None, page: int = 0, page_size: int = LEADERBOARD_PAGE) -> DataFrame:
    """Filter the top list by kind, sort by saved slots, one page."""
    t = top if kind is None else top.where(F.col("kind") == kind)
    return (t.orderBy(F.desc("saved_slots"), F.desc("total_saved"), F.desc("saved_bytes"), "file", "contract")
            .offset(page * page_size).limit(page_size))


def savings_preview(report: DataFrame, struct_opt: DataFrame) -> DataFrame:
    """Per source file: state savings + positive struct savings x instances, gas, verdict.

    A file fails as a whole when any of its contracts fails, as in the bulk rows.
    """
    failed = report.where(F.col("status") != STATUS_OK).select("file").distinct()
    report = report.join(failed, "file", "left_anti")
    state = (report.where(F.col("status") == STATUS_OK)
             .groupBy("file").agg(F.sum(F.col("current_slots") - F.col("recommended_slots")).alias("_state")))
    ok_contracts = report.where(F.col("status") == STATUS_OK).select("contract_id", "file")
    struct = (struct_opt.where(F.col("saved_per_instance") > 0).join(ok_contracts, "contract_id")
              .groupBy("file").agg(F.sum("total_saved_slots").alias("_struct")))
    p = state.join(struct, "file", "left").fillna(0, ["_struct"])
    slots = (F.col("_state") + F.col("_struct")).cast("bigint")
    return p.select("file", slots.alias("slots_saved"), C.gas(slots).alias("gas_saved"),
                    (slots <= 0).alias("already_optimal"))
