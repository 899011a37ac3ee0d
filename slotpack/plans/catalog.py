"""Named queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables.

Every query reads the whole corpus: ``order`` contracts (one per order, few variables) and ``part``
contracts (about 30 variables, on both sides of the exact packer's limit).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotpack.functions import nextfit
from slotpack.operators import corpus, metrics, packing, profile, structs, widepack
from slotpack.plans.analysis import Analysis
from slotpack.session import materialize, table_path
from slotpack.sources import bulk_csv, files, layout_json, report_json, standin

BOTH = ("order", "part")


def _corpus(spark: SparkSession, sf_dir: str, whole_files: bool = False) -> standin.Corpus:
    return standin.Corpus(spark, sf_dir, whole_files=whole_files)


def _analysis(spark: SparkSession, sf_dir: str, whole_files: bool = False) -> Analysis:
    c = _corpus(spark, sf_dir, whole_files)
    return Analysis(c.contracts, c.entries, c.structs, c.struct_fields)


def q_declared_layout(spark, sf_dir):
    """slot/offset of every stand-in variable under the compiler's sequential rule."""
    typed = _corpus(spark, sf_dir).entries.select("contract_id", "ordinal", "number_of_bytes")
    lost = standin.keyless(spark, sf_dir)
    typed = typed if lost is None else typed.unionByName(lost)
    p = nextfit.positions(typed, ["contract_id"], "ordinal", "number_of_bytes")
    return p.select("contract_id", F.col("ordinal").cast("int").alias("ordinal"),
                    F.col("slot").cast("bigint").alias("slot"), F.col("offset").cast("int").alias("offset"))


def q_current_slots(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return metrics.current_slots(c.entries, c.contracts)


def q_current_waste(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return metrics.current_waste(c.entries, c.contracts)


def q_slot_view(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    v = metrics.slot_view(c.entries)
    return v.select("contract_id", "slot", "used", "slots_spanned", "wasted",
                    F.col("n_vars").cast("bigint").alias("n_vars"),
                    F.array_join(F.col("variables.label"), ",").alias("labels"))


def q_partial_slot_waste(spark, sf_dir):
    return metrics.partial_slot_waste(_corpus(spark, sf_dir).entries)


def q_suboptimal_order(spark, sf_dir):
    return metrics.suboptimal_order(_corpus(spark, sf_dir).entries)


def q_issues(spark, sf_dir):
    return metrics.issues(_corpus(spark, sf_dir).entries)


def q_strategy(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    s = packing.contract_strategy(c.entries, c.contracts)
    return s.select("contract_id", *[F.col(x).cast("bigint").alias(x) for x in
                                     ["n_vars", "n_packable", "n_full", "n_dynamic"]], "strategy")


def q_pack_exact_count(spark, sf_dir):
    """O25 count: slots of the exact packer per contract with 1 to 20 packable variables."""
    a = _analysis(spark, sf_dir)
    b = a.bins()
    s = a.strategy().where(F.col("strategy") == packing.STRATEGY_EXACT).where(F.col("n_packable") > 0)
    return (b.join(s.select("contract_id"), "contract_id")
            .groupBy("contract_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_items"),
                                        F.count_distinct("bin").cast("bigint").alias("bins")))


def q_pack_exact_bins(spark, sf_dir):
    """O25 grouping: slot of every packable variable of contracts on the exact path (reference tie-break)."""
    a = _analysis(spark, sf_dir)
    exact = a.strategy().where(F.col("strategy") == packing.STRATEGY_EXACT).select("contract_id")
    bins = a.bins().join(exact, "contract_id", "left_semi")
    first = bins.groupBy("contract_id", "bin").agg(F.min("ordinal").alias("first_ordinal"))
    return (bins.join(first, ["contract_id", "bin"])
            .select("contract_id", "ordinal", F.col("first_ordinal").cast("int").alias("group_first")))


def q_pack_ffd(spark, sf_dir):
    """First-fit decreasing bin (opening order) of every packable variable of contracts with more than 20."""
    c = _corpus(spark, sf_dir)
    p = packing.classify(c.entries).where(F.col("cls") == "packable").select("contract_id", "ordinal", "number_of_bytes")
    r = packing.pack_ffd(p, ["contract_id"], "ordinal", "number_of_bytes")
    return r.select("contract_id", F.col("ordinal").cast("int").alias("ordinal"), "bin")


#: Orders as shipments: units packed into containers of these capacities.
CONTAINER, PALLET = 5000, 1000


def _items(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (q * 97).alias("volume"), (q * 131).alias("weight"),
        ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 600 + 100).cast("bigint").alias("share"))


def q_pack_ffd_wide(spark, sf_dir):
    """O26 in its general form: every line of a part packed first-fit decreasing into containers of 5000."""
    out = widepack.pack(_items(spark, sf_dir), ["l_partkey"], ["l_orderkey", "l_linenumber"], "volume", CONTAINER, max_exact=0)
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "volume", "bin")


def q_pack_exact_wide(spark, sf_dir):
    """O25 in its general form: least number of pallets of 1000 for the lines of every order."""
    out = widepack.pack(_items(spark, sf_dir), ["l_orderkey"], ["l_linenumber"], "share", PALLET)
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("bin").alias("bins"))


def q_next_fit_wide(spark, sf_dir):
    """O30/O36b in general form: container and offset of every line of a part, filled in order; some lines are larger."""
    at, _ = widepack.next_fit(_items(spark, sf_dir), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"], "weight", CONTAINER)
    return at.select("l_partkey", "l_orderkey", "l_linenumber", "slot", "offset")


def q_next_fit_wide_totals(spark, sf_dir):
    """O30 in general form: containers and wasted room of every part, filled in order."""
    return widepack.next_fit(_items(spark, sf_dir), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"], "weight", CONTAINER)[1]


def q_recommended_slots(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return a.recommended_slots().select("contract_id", "slot_index", "note_code", "used", "wasted", "slots_spanned",
                                        F.col("n_vars").cast("bigint").alias("n_vars"), "labels")


def q_recommended_order(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return a.recommended_order().select("contract_id", "position", "slot_index",
                                        F.col("ordinal").cast("int").alias("ordinal"), "label",
                                        "number_of_bytes", "note_code")


def q_next_fit_estimate(spark, sf_dir):
    return _analysis(spark, sf_dir).estimate()


def q_struct_optimization(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return a.struct_optimization().select("contract_id", "type_id", "n_fields", "current_slots", "optimal_slots",
                                          "direct_instances", "saved_per_instance", "total_saved_slots",
                                          "improved", "struct_strategy")


REPORT_COLUMNS = ["contract_id", "file", "contract_name", "status", "n_vars", "current_slots",
                  "recommended_slots", "current_wasted", "recommended_wasted", "strategy", "n_issues",
                  "structs_total", "structs_improved", "struct_saved_slots"]
BULK_OUT = ["file", "contract", "status", "error", "current_slots", "recommended_slots", "saved_slots",
            "current_wasted", "recommended_wasted", "saved_wasted", "strategy", "imports_removed",
            "functions_removed", "modifiers_removed", "types_replaced", "structs_total", "structs_improved",
            "struct_saved_slots"]


def q_contract_report(spark, sf_dir):
    return _analysis(spark, sf_dir).report().select(*REPORT_COLUMNS)


def q_bulk_rows(spark, sf_dir):
    """O35/O36 with the preprocessing counters of each row's source file (O49, O54 via the profile)."""
    c = _corpus(spark, sf_dir)
    a = Analysis(c.contracts, c.entries, c.structs, c.struct_fields)
    prof = profile.profile(standin.sources(c.contracts, c.entries))
    return a.bulk_rows(profile=prof).select(*BULK_OUT)


def q_bulk_summary(spark, sf_dir):
    return corpus.bulk_summary(_analysis(spark, sf_dir).bulk_rows())


def q_dataset_report(spark, sf_dir):
    return corpus.dataset_report(_analysis(spark, sf_dir).bulk_rows())


def q_top_contracts(spark, sf_dir):
    return corpus.top_contracts_web(_analysis(spark, sf_dir).bulk_rows())


def q_top_contracts_cli(spark, sf_dir):
    return corpus.top_contracts_cli(_analysis(spark, sf_dir).bulk_rows())


def q_savings_cube(spark, sf_dir):
    """O38/O40 by grouping sets, from the partial sums of four batches of files."""
    rows = materialize(_analysis(spark, sf_dir).bulk_rows(), "rows")
    batch = F.pmod(F.xxhash64("file"), F.lit(4))
    sums = [corpus.partial_sums(rows.where(batch == k)) for k in range(4)]
    return corpus.savings_cube(sums[0].unionByName(sums[1]).unionByName(sums[2]).unionByName(sums[3]))


def q_merged_dataset_report(spark, sf_dir):
    """O40/O43 from the partial sums of four batches of files."""
    rows = materialize(_analysis(spark, sf_dir).bulk_rows(), "rows")
    batch = F.pmod(F.xxhash64("file"), F.lit(4))
    sums = [corpus.partial_sums(rows.where(batch == k)) for k in range(4)]
    return corpus.dataset_report_of(sums[0].unionByName(sums[1]).unionByName(sums[2]).unionByName(sums[3]))


def q_savings_preview(spark, sf_dir):
    a = _analysis(spark, sf_dir, whole_files=True)
    return corpus.savings_preview(a.report(), a.struct_optimization())


def q_leaderboard(spark, sf_dir):
    """First page (15 rows) of the synthetic slice of the top list, by saved slots."""
    top = corpus.top_contracts_web(_analysis(spark, sf_dir).bulk_rows())
    return corpus.leaderboard(top, kind="synthetic", page=0)


def _ingested(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    docs = layout_json.to_documents(c.contracts, c.entries, c.struct_fields, c.structs)
    return layout_json.layout_tables(layout_json.parse_documents(docs), keep=lambda d: materialize(d, "layouts"))


def q_first_contracts(spark, sf_dir):
    """The first contract (source unit, then contract order) of every corpus file."""
    c = _corpus(spark, sf_dir)
    return layout_json.first_contract(c.contracts).select("file", "contract_name", "contract_id")


def q_layout_ingest(spark, sf_dir):
    """Layout documents of the whole corpus parsed back into entries."""
    return _ingested(spark, sf_dir)["entries"].select(
        "contract_id", "ordinal", "label", "offset", "slot_text", "slot", "type_id", "number_of_bytes",
        "type_label", "encoding")


def q_layout_structs(spark, sf_dir):
    """Struct definitions and their members from the same documents."""
    t = _ingested(spark, sf_dir)
    return (t["struct_fields"].join(t["structs"].select("contract_id", "type_id", F.col("number_of_bytes")
                                                         .alias("struct_bytes")), ["contract_id", "type_id"])
            .select("contract_id", "type_id", "struct_bytes", "ordinal", "label", "member_type_id", "type_label",
                    "number_of_bytes", "encoding", "slot", "offset"))


def q_bulk_csv_report(spark, sf_dir):
    """Bulk rows written as CSV to the shared folder, read back, dataset report."""
    rows = _analysis(spark, sf_dir).bulk_rows()
    path = table_path(spark, "bulk-csv")
    bulk_csv.write_bulk_csv(rows, path)
    return corpus.dataset_report(bulk_csv.read_bulk_csv(spark, path))


def _documents(spark, sf_dir, keep=lambda d: d):
    """Layout documents of the corpus, some faulty, parsed; ``keep`` may store them parsed."""
    c = _corpus(spark, sf_dir)
    # the names meet the contracts before the texts are built, so that no text is moved for them
    named = c.contracts.join(c.contracts.select("contract_id", F.col("contract_name").alias("_name")), "contract_id")
    docs = layout_json.to_documents(named, c.entries, c.struct_fields, c.structs, carried=["contract_id", "_name"])
    return keep(layout_json.parse_documents(standin.faulty_documents(docs.withColumnRenamed("_name", "contract_name"))))


def q_file_status(spark, sf_dir):
    """Status and error of every layout document."""
    status = layout_json.file_status(_documents(spark, sf_dir))
    return status.select("file", "status", F.coalesce("error", F.lit("")).alias("error"))


def _document_rows(spark, sf_dir):
    t = layout_json.layout_tables(_documents(spark, sf_dir, lambda d: materialize(d, "documents")))
    a = Analysis(t["contracts"], t["entries"], t["structs"], t["struct_fields"])
    return a.bulk_rows(file_errors=t["file_status"].where(F.col("status") == "ERROR").select("file", "error"))


def q_document_bulk_rows(spark, sf_dir):
    """Bulk rows of the layout documents, with one error row per rejected document."""
    return _document_rows(spark, sf_dir).select(*BULK_OUT)


def q_document_bulk_summary(spark, sf_dir):
    """O38 over the bulk rows of the layout documents."""
    return corpus.bulk_summary(_document_rows(spark, sf_dir))


def q_csv_top_contracts(spark, sf_dir):
    """The web top list of a CSV report read back."""
    rows = _analysis(spark, sf_dir).bulk_rows()
    path = table_path(spark, "bulk-csv")
    bulk_csv.write_bulk_csv(rows, path)
    return corpus.top_contracts_web(bulk_csv.read_bulk_csv(spark, path))


def _report_documents(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return report_json.report_documents(a.report(), a.issues(), a.items(), a.struct_optimization(),
                                        structs.struct_field_order(a.fields))


def q_report_documents(spark, sf_dir):
    """The nested report documents, their recommended layouts flattened back to rows."""
    return report_json.document_variables(_report_documents(spark, sf_dir))


def _written_reports(spark, sf_dir):
    path = table_path(spark, "reports")
    report_json.write_reports(_report_documents(spark, sf_dir), path)
    return report_json.read_reports(spark, path)


def q_report_issues(spark, sf_dir):
    """Report documents written as JSON to the shared folder, their issues read back."""
    return report_json.written_issues(_written_reports(spark, sf_dir))


def q_report_structs(spark, sf_dir):
    """Report documents written as JSON, their struct optimisations and member orders read back."""
    return report_json.written_structs(_written_reports(spark, sf_dir)).drop("label")


def q_struct_field_order(spark, sf_dir):
    """Recommended position of every struct member."""
    a = _analysis(spark, sf_dir)
    return structs.struct_field_order(a.fields).select(
        "contract_id", "type_id", "position", "ordinal", "label")


def _sources(spark, sf_dir, whole_files=False):
    c = _corpus(spark, sf_dir, whole_files)
    return standin.sources(c.contracts, c.entries)


def q_source_profile(spark, sf_dir):
    """Per-file preprocessing counters, external types, modified flag, warnings."""
    return profile.profile(_sources(spark, sf_dir))


def q_external_types(spark, sf_dir):
    """(file, type) for every external state-variable type."""
    return profile.external_type_rows(_sources(spark, sf_dir, whole_files=True))


def q_local_declarations(spark, sf_dir):
    """(file, name) for every locally declared identifier."""
    return profile.declarations(_sources(spark, sf_dir))


def q_inheritance_edges(spark, sf_dir):
    """(file, child, parent, position) of every inheritance list."""
    return profile.inheritance_edges(_sources(spark, sf_dir))


def q_normalized_source(spark, sf_dir):
    """Every source text with pragma, tags, imports, using directives and inheritance normalised."""
    return profile.normalized(_sources(spark, sf_dir, whole_files=True))


def q_verified_source(spark, sf_dir):
    """Verified-source payloads normalised to Solidity text; addresses from link and file name."""
    c = _corpus(spark, sf_dir)
    src = standin.sources(c.contracts, c.entries)
    return files.verified_sources(standin.payloads(src, c.contracts))


def q_contract_sources(spark, sf_dir):
    """Every contract's source text looked up by its file path; size and line count."""
    c = _corpus(spark, sf_dir, whole_files=True)
    src = standin.sources(c.contracts, c.entries)
    found = files.sources_for(c.contracts.select("contract_id", "file"), src)
    return found.select("contract_id", "file", F.length("text").cast("bigint").alias("n_chars"),
                        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))


def q_examples(spark, sf_dir):
    """Example index joined to the source texts."""
    c = _corpus(spark, sf_dir, whole_files=True)
    src = standin.sources(c.contracts, c.entries)
    return files.examples(standin.example_index(src, c.contracts), src)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "declared_layout": q_declared_layout,
    "current_slots": q_current_slots,
    "current_waste": q_current_waste,
    "slot_view": q_slot_view,
    "partial_slot_waste": q_partial_slot_waste,
    "suboptimal_order": q_suboptimal_order,
    "issues": q_issues,
    "strategy": q_strategy,
    "pack_exact_count": q_pack_exact_count,
    "pack_exact_bins": q_pack_exact_bins,
    "pack_ffd": q_pack_ffd,
    "pack_ffd_wide": q_pack_ffd_wide,
    "pack_exact_wide": q_pack_exact_wide,
    "next_fit_wide": q_next_fit_wide,
    "next_fit_wide_totals": q_next_fit_wide_totals,
    "recommended_slots": q_recommended_slots,
    "recommended_order": q_recommended_order,
    "next_fit_estimate": q_next_fit_estimate,
    "struct_optimization": q_struct_optimization,
    "contract_report": q_contract_report,
    "bulk_rows": q_bulk_rows,
    "bulk_summary": q_bulk_summary,
    "dataset_report": q_dataset_report,
    "top_contracts": q_top_contracts,
    "top_contracts_cli": q_top_contracts_cli,
    "savings_preview": q_savings_preview,
    "savings_cube": q_savings_cube,
    "merged_dataset_report": q_merged_dataset_report,
    "leaderboard": q_leaderboard,
    "first_contracts": q_first_contracts,
    "layout_ingest": q_layout_ingest,
    "layout_structs": q_layout_structs,
    "bulk_csv_report": q_bulk_csv_report,
    "file_status": q_file_status,
    "document_bulk_rows": q_document_bulk_rows,
    "document_bulk_summary": q_document_bulk_summary,
    "csv_top_contracts": q_csv_top_contracts,
    "report_documents": q_report_documents,
    "report_issues": q_report_issues,
    "report_structs": q_report_structs,
    "struct_field_order": q_struct_field_order,
    "source_profile": q_source_profile,
    "external_types": q_external_types,
    "local_declarations": q_local_declarations,
    "inheritance_edges": q_inheritance_edges,
    "normalized_source": q_normalized_source,
    "verified_source": q_verified_source,
    "examples": q_examples,
    "contract_sources": q_contract_sources,
    # earlier names of the same queries
    "contract_report_all": q_contract_report,
    "bulk_summary_all": q_bulk_summary,
    "dataset_report_all": q_dataset_report,
    "top_contracts_all": q_top_contracts,
}
