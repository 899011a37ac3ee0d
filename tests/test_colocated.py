"""The one-exchange report equals the chunked operators, with errors, ties and contracts on both sides of the bound."""

import random

import pytest
from pyspark.sql import functions as F

from slotpack.operators import colocated
from slotpack.operators import corpus as corpus_ops
from slotpack.plans.analysis import Analysis

CONTRACTS = "contract_id string, file string, source_unit string, contract_name string, source_ord int, contract_ord int"
ENTRIES = ("contract_id string, ordinal int, label string, type_id string, type_label string, encoding string, "
           "number_of_bytes int, slot bigint, slot_text string, offset int")
FIELDS = "contract_id string, type_id string, ordinal int, label string, type_label string, encoding string, number_of_bytes int"
STRUCTS = "contract_id string, type_id string, label string, number_of_bytes int, struct_ord int"


def corpus(spark, sizes):
    r = random.Random(len(sizes))
    contracts, entries, fields, structs = [], [], [], []
    for k, n in enumerate(sizes):
        c = f"c{k}"
        contracts.append((c, f"real/{k}.sol", "u", f"N{k}", 0, 0))
        for i in range(n):
            size = r.choice([1, 2, 4, 8, 20, 31, 32, 64, 33] + ([0] if k % 5 == 0 else []))
            slot = None if k % 7 == 6 and i == 0 else r.randint(0, max(n // 2, 1))
            entries.append((c, i, f"v{i}", r.choice(["t_a", "t_s0", "t_s1"]), "a", r.choice(["inplace", "inplace", "mapping"]), size,
                            slot, "9" * 30 if slot is None else str(slot), r.randint(0, 31)))
        for t in range(r.randint(0, 2)):
            many = r.choice([1, 3, 25])
            for i in range(many):
                fields.append((c, f"t_s{t}", i, f"m{i}", "a", r.choice(["inplace", "bytes"]), r.choice([1, 8, 16, 20, 32] + ([0] if k % 11 == 0 else []))))
            structs.append((c, f"t_s{t}", "S", many * 32, t))
    make = spark.createDataFrame
    return (make(contracts, CONTRACTS), make(entries, ENTRIES), make(structs, STRUCTS), make(fields, FIELDS))


@pytest.mark.parametrize("small", [512, 20])
def test_report_equals_chunked_operators(spark, monkeypatch, small):
    monkeypatch.setattr(colocated, "SMALL", small)
    tables = corpus(spark, [0, 1, 2, 3, 5, 9, 20, 21, 22, 40, 64, 7] * 3)
    got = Analysis(*tables).report()
    want = Analysis(*tables).chunked_report()
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    skip = F.col("status") == "ERROR"  # rejected contracts have no layout
    assert sorted(map(tuple, got.where(~skip).collect()), key=str) == sorted(map(tuple, want.where(~skip).collect()), key=str)
    errors = [{(x.contract_id, x.error) for x in d.where(skip).collect()} for d in (got, want)]
    assert errors[0] == errors[1] and len(errors[0]) > 5


def test_report_without_structs(spark):
    contracts, entries, _, _ = corpus(spark, [3, 30, 0])
    got, want = Analysis(contracts, entries).report(), Analysis(contracts, entries).chunked_report()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_exchange_of_rows(spark):
    rows = colocated.stacked(*corpus(spark, [3, 4]))
    plan = colocated.report(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_savings_preview_leaves_out_failed_files(spark):
    contracts, entries, structs, fields = corpus(spark, [3, 4, 5, 6, 9, 7, 8])
    contracts = contracts.withColumn("file", F.when(F.col("contract_id").isin("c5", "c6"), "real/shared.sol").otherwise(F.col("file")))
    a = Analysis(contracts, entries, structs, fields)
    failed = {r.file for r in a.report().where("status = 'ERROR'").collect()}
    files = {r.file for r in corpus_ops.savings_preview(a.report(), a.struct_optimization()).collect()}
    assert "real/shared.sol" in failed and files == {r.file for r in contracts.collect()} - failed


def test_figures_of_a_batch_equal_those_of_gathered_rows(spark):
    contracts, entries, structs, fields = corpus(spark, [0, 1, 2, 3, 5, 9, 20, 21, 22, 40, 64, 7] * 8)
    twice = contracts.where("contract_id = 'c3'").select(F.lit(None).cast("string").alias("contract_id"), *contracts.columns[1:])
    tables = [contracts.unionByName(twice).unionByName(twice), entries.where("slot is not null"), structs.unionByName(structs), fields]
    rows = colocated.stacked(*tables)
    got = colocated.report(rows)
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    want = colocated.nested_report(colocated.nested(*tables))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    sorted_rows = rows.orderBy("contract_id").toArrow()
    whole = [b for size in (7, 1000) for b in colocated._report_batches(iter(sorted_rows.to_batches(size)))]
    assert sum(b.num_rows for b in whole) == 2 * got.count()


def test_contracts_with_missing_values_are_reported_as_before(spark):
    contracts, entries, structs, fields = corpus(spark, [3, 4, 5, 9, 21, 30])
    gap = F.col("contract_id").isin("c1", "c4") & (F.col("ordinal") == 1)
    entries = entries.withColumn("offset", F.when(~gap, F.col("offset"))).withColumn(
        "slot_text", F.when(F.col("contract_id") == "c3", F.concat(F.lit("0"), F.col("slot_text"))).otherwise(F.col("slot_text")))
    fields = fields.withColumn("ordinal", F.when(F.col("contract_id") != "c2", F.col("ordinal")))
    tables = (contracts, entries, structs, fields)
    want = colocated.nested_report(colocated.nested(*tables)).collect()
    assert sorted(map(str, Analysis(*tables).report().collect())) == sorted(map(str, want))
