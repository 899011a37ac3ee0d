"""The per-contract analysis pipeline, assembled once and shared by all report queries.

Stages: classify -> pack (exact / FFD) -> number recommended slots -> flatten order -> next-fit
estimate; current metrics and issues; structs; report. The packed bins and the numbered items are
the two intermediate tables every later stage reads, so they are materialised once into the
cluster's checkpoint folder (``spark.checkpoint.dir``): this cuts the lineage (a lost executor
re-reads them instead of re-solving) and keeps the solver UDFs from running once per consumer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotpack.functions import columns as C
from slotpack.operators import colocated, metrics, packing, report, structs
from slotpack.session import materialize as write_table


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (reliable, lineage cut)."""
    return write_table(df, "analysis")


#: Large contracts that one broadcast may hold.
MOST_BROADCAST_IDS = 1_000_000


class Analysis:
    """All analysis tables of one layout corpus (contracts, entries, structs, struct_fields)."""

    def __init__(self, contracts: DataFrame, entries: DataFrame, structs_df: DataFrame | None = None,
                 fields: DataFrame | None = None, materialized: bool = True):
        self.contracts, self.entries = contracts, entries
        self.structs_df, self.fields = structs_df, fields
        self._mat = materialize if materialized else (lambda d: d)
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name: str, build) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    # --- one pass over the entries: counts, strategy inputs, current slots, slot range ------
    def stats(self) -> DataFrame:
        def build():
            c = packing.classify(self.entries)
            per = c.groupBy("contract_id").agg(
                F.count(F.lit(1)).alias("n_vars"),
                F.count_if(F.col("cls") == "packable").alias("n_packable"),
                F.count_if(F.col("cls") == "full").alias("n_full"),
                F.count_if(F.col("cls") == "dynamic").alias("n_dynamic"),
                F.min(F.when(F.col("cls") == "packable", F.col("number_of_bytes"))).alias("min_packable_size"),
                F.max(F.col("slot") + C.slots_needed("number_of_bytes")).cast("bigint").alias("current_slots"))
            # slot texts beyond 64 bits: a filter that is empty on valid input, kept out of the main
            # aggregation so that one stays a hash aggregation (a string min would force a sort)
            bad = (self.entries.where(F.col("slot").isNull()).groupBy("contract_id")
                   .agg(F.min("slot_text").alias("bad_slot")))
            out = (self.contracts.select("contract_id").join(per, "contract_id", "left")
                   .join(bad, "contract_id", "left")
                   .fillna(0, ["n_vars", "n_packable", "n_full", "n_dynamic", "current_slots"]))
            return self._mat(packing.with_strategy(out))
        return self._get("stats", build)

    # --- current layout -------------------------------------------------------------------
    def current_slots(self) -> DataFrame:
        return self._get("cur_slots", lambda: self.stats().select("contract_id", "current_slots"))

    def current_waste(self) -> DataFrame:
        return self._get("cur_waste", lambda: metrics.current_waste(self.entries, self.contracts))

    def issues(self) -> DataFrame:
        return self._get("issues", lambda: metrics.issues(self.entries))

    def issue_counts(self) -> DataFrame:
        return self._get("issue_counts", lambda: self.issues().groupBy("contract_id")
                         .agg(F.count(F.lit(1)).cast("bigint").alias("n_issues")))

    # --- packing ----------------------------------------------------------------------------
    def strategy(self) -> DataFrame:
        return self._get("strategy", lambda: self.stats())

    def bins(self) -> DataFrame:
        """Bins of state variables only."""
        def build():
            state = packing.classify(self.entries).where(F.col("cls") == "packable")
            return self._mat(packing.pack(state.select("contract_id", "ordinal", "number_of_bytes"), ["contract_id"],
                                          "ordinal", "number_of_bytes"))
        return self._get("bins", build)

    def items(self) -> DataFrame:
        """Variables with their recommended slot; contracts that the packer rejects have none."""
        return self._get("items", lambda: packing.placed_items(self.entries))

    def recommended_slots(self) -> DataFrame:
        return self._get("rec_slots", lambda: packing.recommended_slots(self.entries, self.items()))

    def recommended_order(self) -> DataFrame:
        return self._get("rec_order", lambda: packing.recommended_order(self.entries, self.items()))

    def estimate(self) -> DataFrame:
        return self._get("estimate", lambda: packing.next_fit_estimate(
            self.entries, self.contracts, self._mat(self.items().select(
                "contract_id", "ordinal", "slot_index", "number_of_bytes"))))

    # --- structs ----------------------------------------------------------------------------
    def member_bins(self) -> DataFrame:
        """Bins of struct members only."""
        keys = ["contract_id", "type_id"]
        return self._get("member_bins", lambda: self._mat(packing.pack(
            packing.classify(self.fields).where(F.col("cls") == "packable").select(*keys, "ordinal", "number_of_bytes"),
            keys, "ordinal", "number_of_bytes")))

    def struct_optimization(self) -> DataFrame:
        return self._get("struct_opt", lambda: self._mat(structs.struct_optimization(
            self.structs_df, self.fields, self.entries, self.member_bins())))

    def struct_summary(self) -> DataFrame:
        if self.structs_df is None:
            spark = self.entries.sparkSession
            return spark.createDataFrame([], "contract_id string, structs_total bigint, structs_improved bigint, "
                                             "struct_saved_slots bigint, _struct_invalid int, _struct_invalid_size int")
        return self._get("struct_summary", lambda: structs.contract_struct_summary(self.struct_optimization()))

    # --- report -----------------------------------------------------------------------------
    def errors(self) -> DataFrame:
        return self._get("errors", lambda: report.contract_errors(self.stats(), self.struct_summary()))

    def chunked_report(self) -> DataFrame:
        """The report of contracts of any size, from the chunked operators above."""
        return report.contract_report(
            self.contracts, self.strategy(), self.current_slots(), self.current_waste(), self.estimate(),
            self.issue_counts(), self.struct_summary(), self.errors())

    def report(self) -> DataFrame:
        """Contracts of at most ``colocated.SMALL`` rows meet in one exchange, larger ones are chunked."""
        def build():
            tables = [self.contracts, self.entries, self.structs_df, self.fields]
            aside = write_table(colocated.set_aside(*tables), "aside")
            many = aside.count()
            if not many:
                return self._mat(colocated.report(colocated.stacked(*tables)))

            def of(ids: DataFrame, how: str) -> list[DataFrame | None]:
                side = ids.select(F.col("contract_id").alias("_own"))
                side = F.broadcast(side) if many <= MOST_BROADCAST_IDS else side
                return [None if t is None else t.join(side, F.col("contract_id").eqNullSafe(F.col("_own")), how) for t in tables]

            known = (F.col("n") > colocated.SMALL) & F.col("contract_id").isNotNull()
            chunked = Analysis(*of(aside.where(known), "left_semi")).chunked_report()
            lacking = colocated.nested_report(colocated.nested(*of(aside.where(~known), "left_semi")))
            return self._mat(colocated.report(colocated.stacked(*of(aside, "left_anti"))).unionByName(lacking).unionByName(chunked))
        return self._get("report", build)

    def bulk_rows(self, file_errors: DataFrame | None = None, profile: DataFrame | None = None) -> DataFrame:
        return report.bulk_rows(self.report(), file_errors, profile)

