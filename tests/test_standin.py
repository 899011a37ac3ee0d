"""Stand-in corpus from own rows: files of a customer, places of variables and members."""

import pytest

import __spark_entry__ as E

WHOLE = ["contract_sources", "examples", "normalized_source", "external_types", "savings_preview"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two customers with orders far apart, three parts; written as the driver's tables are."""
    root = str(tmp_path_factory.mktemp("tables"))
    orders = [(5, 7, "O"), (2500, 7, "O"), (9999, 7, "P"), (6, 8, "F")]
    lines = [(o, 1 + k % 3, k % 7, k, float(k * 10 + 1), float((k * 7 + o) % 50 + 1))
             for o, _, _ in orders for k in range(12)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(k, f"Brand#{k}") for k in (1, 2, 3)], "p_partkey bigint, p_brand string").write.parquet(f"{root}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
                                 "l_quantity double").write.parquet(f"{root}/lineitem.parquet")
    return root


@pytest.mark.parametrize("name", WHOLE)
def test_a_file_holds_every_order_of_its_customer(spark, tables, name):
    rows = E.queries()[name](spark, tables).collect()
    files = {r.description.removeprefix("Contracts of ") if name == "examples" else r.file for r in rows}
    assert {f for f in files if not f.startswith("synthetic/")} <= {"real/c7.sol", "real/c8.sol", "pending/c7.sol"}
    assert "real/c7.sol" in files


def test_the_text_of_a_file_is_looked_up_for_all_of_its_contracts(spark, tables):
    rows = {r.contract_id: r for r in E.queries()["contract_sources"](spark, tables).collect()}
    assert rows["O5"].file == rows["O2500"].file == "real/c7.sol"
    assert rows["O5"].n_chars == rows["O2500"].n_chars > 1.5 * rows["O6"].n_chars


def test_contracts_placed_in_rows_equal_those_placed_by_chunks(spark, tables, monkeypatch):
    from slotpack.sources import standin

    def every():
        c = standin.Corpus(spark, tables)
        return [sorted(map(tuple, t.collect())) for t in (c.entries, c.struct_fields, c.structs)]

    together = every()
    assert standin.placed(spark, tables)[1] is None and len(together[0]) == 96
    monkeypatch.setattr(standin, "GATHERED", 0)
    assert every() == together


def test_contracts_cut_by_the_batches_of_a_task_are_placed_whole(spark, tables, monkeypatch):
    """Batches of three lines: a contract of twelve comes in four of them."""
    from slotpack.sources import standin

    def every():
        return sorted(map(tuple, standin.placed(spark, tables)[0].collect()))

    whole = every()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert every() == whole and len(whole) == 96
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_placing_many_groups_at_once_equals_the_rule():
    import random

    import numpy as np

    from slotpack.functions import nextfit

    r = random.Random(1)
    groups = [[r.choice([-1, 0, 1, 2, 8, 16, 20, 31, 32, 33, 64, 100]) for _ in range(r.randrange(1, 40))] for _ in range(300)]
    slot, offset = nextfit.places(np.array(sum(groups, []), np.int64), np.cumsum([0, *map(len, groups)]))
    want = []
    for g in groups:
        s = u = 0
        for b in g:
            if b >= 32:
                s, u = s + (u > 0), 0
                want.append((s, 0))
                s += (b + 31) // 32
                continue
            if u + b > 32:
                s, u = s + 1, 0
            want.append((s, u))
            s, u = (s + 1, 0) if u + b == 32 else (s, u + b)
    assert list(zip(slot.tolist(), offset.tolist(), strict=True)) == want


def test_declared_layout_keeps_lines_without_a_key(spark, tables, tmp_path):
    schema = spark.read.parquet(f"{tables}/lineitem.parquet").schema
    lines = [(5, None, 3, 0, 1.0, 9.0), (5, None, 4, 1, 2.0, 4.0), (5, 1, 4, 2, 3.0, None), (5, 1, 4, 3, 3.0, 7.0)]
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(E.queries()["declared_layout"](spark, str(tmp_path)).collect(), key=str)
    assert [r.ordinal for r in got if r.contract_id is None] == [0, 1]
    assert sorted(r.ordinal for r in got if r.contract_id == "O5") == [0, 1, 2, 3]
    assert sorted(r.ordinal for r in got if r.contract_id == "P1") == [0, 1]
