"""CSV round trip, verified-source payloads, source profile on a sample, file scan, streaming."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from slotpack.operators import profile
from slotpack.schema import BULK_COLUMNS
from slotpack.sources import bulk_csv, files, layout_json
from slotpack.streaming import layouts


def test_csv_round_trip_and_lenient_scan(spark):
    row = ["a,\"b\".sol", "C", "OK", "", 3, 2, 1, 10, 5, 5, "DP-bitmask (exact optimum)", 0, 0, 0, 0, 1, 1, 2]
    df = spark.createDataFrame([tuple(row)], ", ".join(
        f"{c} {'string' if isinstance(v, str) else 'bigint'}" for c, v in zip(BULK_COLUMNS, row)))
    d = tempfile.mkdtemp(prefix="slotpack-csv-")
    bulk_csv.write_bulk_csv(df, d + "/out")
    back = bulk_csv.read_bulk_csv(spark, d + "/out").collect()
    assert back[0].file == 'a,"b".sol' and back[0].saved_slots == 1
    with open(d + "/manual.csv", "w") as fh:
        fh.write(",".join(BULK_COLUMNS) + "\n")
        fh.write(",".join(["short"] + ["1"] * 16) + "\n")            # 17 fields: dropped
        fh.write(",".join(["long"] + ["x"] * 17 + ["extra"]) + "\n")  # 19 fields: kept, ints -> 0
        fh.write("\n")
        fh.write(",".join(["last empty"] + ["1"] * 16 + [""]) + "\n")  # 18 fields, last one empty: kept
        fh.write('"quoted, short",' + ",".join(["1"] * 16) + "\n")      # 17 fields, one with a comma: dropped
    rows = {r.file: r for r in bulk_csv.read_bulk_csv(spark, d + "/manual.csv").collect()}
    assert set(rows) == {"long", "last empty"} and rows["long"].current_slots == 0
    assert rows["last empty"].struct_saved_slots == 0 and rows["last empty"].structs_improved == 1


def test_top_lists_on_rows_without_document_order(spark):
    from slotpack.operators import corpus
    row = ["real/a.sol", "C", "OK", "", 3, 2, 1, 10, 5, 5, "DP-bitmask (exact optimum)", 0, 0, 0, 0, 1, 1, 2]
    df = spark.createDataFrame([tuple(row)], ", ".join(
        f"{c} {'string' if isinstance(v, str) else 'bigint'}" for c, v in zip(BULK_COLUMNS, row)))
    assert corpus.top_contracts_web(df).collect()[0].total_saved == 3
    assert corpus.top_contracts_cli(df).collect()[0].contract == "C"


def test_verified_payloads(spark):
    src = json.dumps({"sources": {"a.sol": {"content": "contract Foo {}"}, "b.sol": {"content": "contract FooBar {}"}}})
    rows = [("0x1", "Foo", "{" + src + "}"), ("0x2", "Nope", src), ("0x3", "Foo", "contract Foo {}"),
            ("0x4", "", json.dumps({"x.sol": {"content": "A"}, "y.sol": {"content": ""}, "z.sol": {"content": "B"}}))]
    df = spark.createDataFrame(rows, "address string, contract_name string, source_code string")
    out = {r.address: r.solidity for r in files.verified_sources(df).collect()}
    assert out["0x1"] == "contract FooBar {}"           # last substring match wins
    assert out["0x2"] == "contract Foo {}\ncontract FooBar {}\n"
    assert out["0x3"] == "contract Foo {}"
    assert out["0x4"] == "A\nB\n"


def test_payloads_with_outer_white_space_and_odd_entries(spark):
    src = json.dumps({"sources": {"a.sol": {"content": "contract Foo {}"}, "n.sol": "text", "m.sol": 7, "k.sol": None}})
    rows = [("0x1", "Foo", "{" + src + "}\r\n"), ("0x2", "Foo", "\n\t" + src), ("0x3", "Foo", "\ncontract Foo {}\n"),
            ("0x4", None, None)]
    df = spark.createDataFrame(rows, "address string, contract_name string, source_code string")
    out = {r.address: r for r in files.verified_sources(df).collect()}
    assert out["0x1"].solidity == out["0x2"].solidity == "contract Foo {}"
    assert out["0x3"].solidity == "\ncontract Foo {}\n" and not out["0x3"].multi_file and out["0x4"].solidity is None


SAMPLE = """// SPDX-License-Identifier: MIT
pragma solidity 0.8.20;
import "./Ownable.sol";
import {IERC20} from "./IERC20.sol";
contract Vault is Ownable, Pausable("x") {
    using SafeERC20 for IERC20;
    enum State { Open, Closed }
    struct Pos { uint64 a; }
    IERC20 public token;
    Oracle[] public oracles;
    State public state;
    Pos internal pos;
    uint256 public total;
    /// @inheritdoc Ownable
    constructor(address a) Ownable(a) Pausable("x") {}
    function f() external {}
}
"""


def test_profile_sample(spark):
    df = spark.createDataFrame([("v.sol", SAMPLE)], "file string, text string")
    p = profile.profile(df).collect()[0]
    assert p.pragma_relaxed and p.imports_removed == 2 and p.usings_removed == 1
    assert p.inheritance_removed == 1 and p.parent_calls_removed == 2 and p.inheritdoc_removed == 1
    assert p.external_types == "IERC20, Oracle" and p.types_replaced == 2 and p.modified
    edges = [(r.child, r.parent) for r in profile.inheritance_edges(df).orderBy("position").collect()]
    assert edges == [("Vault", "Ownable"), ("Vault", "Pausable")]


ODD = """pragma solidity ^0.8.0;
/* function ghost() {} */
string constant NOTE = "function { in } a string";
contract A is B(f(x), y), ERC20("My (x) Token", "TKN") {
    enum Mode {
        Idle,
        Busy
    }
    mapping(address owner => mapping(uint256 => IERC20 token)) public held;
    Mode public mode;
    modifier only() { require(msg.sender != address(0), "}"); _; }
    function run(uint a) external returns (uint) { if (a > 0) { return a; } Local public x; }
    function open() external;
    receive() external payable {}
}
"""


def test_profile_of_odd_source(spark):
    df = spark.createDataFrame([("a.sol", ODD)], "file string, text string")
    p = profile.profile(df).collect()[0]
    assert p.functions_removed == 4 and p.modified and "4 function bodies stripped" in p.warning
    assert p.external_types == "IERC20"
    assert {r.name for r in profile.declarations(df).collect()} == {"A", "Mode", "Idle", "Busy", "only"}
    assert [r.parent for r in profile.inheritance_edges(df).orderBy("position").collect()] == ["B", "ERC20"]
    plain = spark.createDataFrame([("f.sol", "contract F { function f() external {} }")], "file string, text string")
    q = profile.profile(plain).collect()[0]
    assert q.modified and q.functions_removed == 1 and q.warning


def test_normalized_source(spark):
    df = spark.createDataFrame([("v.sol", SAMPLE)], "file string, text string")
    text = profile.normalized(df).collect()[0].normalized
    assert "pragma solidity ^0.8.20;" in text and "@inheritdoc" not in text
    assert '// removed: import "./Ownable.sol";' in text and "// removed: using SafeERC20 for IERC20;" in text
    assert 'contract Vault /* removed: is Ownable, Pausable("x") */ {' in text


def test_scan_paths_with_spaces(spark):
    d = tempfile.mkdtemp(prefix="slotpack src ")
    os.makedirs(d + "/real")
    for name in ("a b.sol", "c+d%20e.sol"):
        with open(f"{d}/real/{name}", "w") as fh:
            fh.write("contract A {}")
    for root in (d, "file:" + d, "file://" + d + "/"):
        assert sorted(r.file for r in files.scan_sources(spark, root).collect()) == ["real/a b.sol", "real/c+d%20e.sol"]


def test_scan_sources(spark):
    d = tempfile.mkdtemp(prefix="slotpack-src-")
    os.makedirs(d + "/real/sub")
    for p, t in [("real/sub/A.sol", "contract A {}"), ("B.sol", "contract B {}"), ("B.preprocessed.sol", "x"),
                 ("notes.txt", "y")]:
        with open(f"{d}/{p}", "w") as fh:
            fh.write(t)
    got = sorted((r.file, r.text) for r in files.scan_sources(spark, d).collect())
    assert got == [("B.sol", "contract B {}"), ("real/sub/A.sol", "contract A {}")]


def test_streaming_available_now(spark):
    d = tempfile.mkdtemp(prefix="slotpack-stream-")
    os.makedirs(d + "/in")
    layout = {"contracts": {"A.sol": {"A": {"storageLayout": {
        "storage": [{"astId": 1, "contract": "A", "label": "x", "offset": 0, "slot": "0", "type": "t_u8"},
                    {"astId": 2, "contract": "A", "label": "y", "offset": 0, "slot": "1", "type": "t_u256"},
                    {"astId": 3, "contract": "A", "label": "z", "offset": 0, "slot": "2", "type": "t_u8"}],
        "types": {"t_u8": {"encoding": "inplace", "label": "uint8", "numberOfBytes": "1"},
                  "t_u256": {"encoding": "inplace", "label": "uint256", "numberOfBytes": "32"}}}}}}}
    with open(d + "/in/a.json", "w") as fh:
        json.dump(layout, fh)
    with open(d + "/in/bad.json", "w") as fh:
        fh.write("{")
    q = layouts.start(spark, d + "/in", d + "/out", d + "/progress", trigger_once=True)
    q.awaitTermination(120)
    rows = {r.status: r for r in spark.read.parquet(d + "/out").collect()}
    assert rows["OK"].current_slots == 3 and rows["OK"].recommended_slots == 2
    assert "ERROR" in rows


def test_report_json_sink(spark):
    from fixture_contracts import tables
    from slotpack.operators import structs
    from slotpack.plans.analysis import Analysis
    from slotpack.sources import report_json
    c, e, s, f = tables(spark)
    a = Analysis(c, e, s, f)
    docs = report_json.report_documents(a.report(), a.issues(), a.items(), a.struct_optimization(),
                                        structs.struct_field_order(a.fields, a.member_bins()))
    d = tempfile.mkdtemp(prefix="slotpack-json-")
    report_json.write_reports(docs, d + "/reports", buckets=4)
    back = spark.read.json(d + "/reports")
    assert back.count() == 12
    loan = back.where(F.col("contract_name") == "StructLoan").collect()[0]
    assert len(loan.recommended_layout) == 3 and loan.struct_optimizations[0].optimal_slots == 2
    assert {r.bucket for r in back.select("bucket").distinct().collect()} <= {0, 1, 2, 3}


def _nested_source(depth):
    body = "{ if (a) " * (depth - 1) + "{ x(); }" + " }" * (depth - 1)
    return (f"contract C is A, B(f({'(' * depth}1{')' * depth})) {{\n    Token public t;\n"
            f"    function f(uint a) external {body}\n    modifier m() {body}\n    constructor(uint a) A(a) {body}\n"
            f"    function g() external;\n    Vault public v;\n    receive() external payable {{ }}\n}}\n")


@pytest.mark.parametrize("depth", [1, 13, 200])
def test_bodies_of_any_depth(spark, depth):
    src = spark.createDataFrame([("a", _nested_source(depth))], "file string, text string")
    p = profile.profile(src).first()
    assert (p.functions_removed, p.types_replaced, p.external_types) == (5, 2, "Token, Vault")
    assert [(r.child, r.parent) for r in profile.inheritance_edges(src).collect()] == [("C", "A"), ("C", "B")]
    assert {r.name for r in profile.declarations(src).collect()} == {"C", "m"}


def _by_scan(code):
    """Number of bodies and the rest of the code, by one scan over the characters."""
    import re
    out, cursor, count = [], 0, 0
    for _ in range(10 ** 6):
        m = re.compile(r"\b(?:function|constructor|modifier|fallback|receive)\b").search(code, cursor)
        if not m:
            break
        depth, at = 0, m.end()
        while at < len(code) and not (depth == 0 and code[at] in "{;"):
            depth += (code[at] == "(") - (code[at] == ")")
            at += 1
        if at == len(code):
            break
        end, level = at, 0
        if code[at] == "{":
            while end < len(code):
                level += (code[end] == "{") - (code[end] == "}")
                if level == 0:
                    break
                end += 1
            if end == len(code):
                break
        whole = m.group() == "function"
        if code[at] == ";" and not whole:
            out.append(code[cursor:at + 1])
        else:
            out.append(code[cursor:m.start()] + " " if whole else code[cursor:at + 1] + "}")
            count += 1
        cursor = end + 1
    return count, "".join(out) + code[cursor:]


def test_bodies_equal_a_scan(spark):
    import random
    r = random.Random(8)
    bits = ["function f", "constructor", "modifier m", "receive", "(", ")", "{", "}", ";", " x ", "functional", "uint public a;", "{ }"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(400)]
    src = spark.createDataFrame(list(enumerate(texts)), "file int, text string")
    got = {x.file: (x._bodies, x._declared) for x in profile.staged(src).collect()}
    assert all(got[k] == _by_scan(t) for k, t in enumerate(texts))


def test_written_reports_are_compressed(spark, tmp_path):
    from slotpack.sources import report_json
    rows = spark.range(200).select(F.concat(F.lit("O"), "id").alias("contract_id"), F.struct(F.lit("one issue " * 50).alias("note")).alias("document"))
    report_json.write_reports(rows, f"{tmp_path}/reports", buckets=2)
    size = sum(p.stat().st_size for p in tmp_path.rglob("part-*"))
    assert 0 < size < 200 * 500 / 10
    back = spark.read.json(f"{tmp_path}/reports")
    assert back.count() == 200 and {r.note for r in back.select("note").distinct().collect()} == {"one issue " * 50}


def test_payloads_are_read_once(spark):
    df = spark.createDataFrame([("0x1", "Foo", '{"sources":{"a":{"content":"contract Foo {}"}}}'), ("0x2", "Foo", " \t\n"), ("0x3", None, "{cut")],
                               "address string, contract_name string, source_code string")
    out = files.verified_sources(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 3
    assert {r.address: (r.multi_file, r.solidity) for r in out.collect()} == {
        "0x1": (True, "contract Foo {}"), "0x2": (False, " \t\n"), "0x3": (True, None)}


def test_bodies_are_found_from_matched_tokens_only(spark):
    # every statement adds a token; only those of heads and bodies change the fold's state
    fold = spark.range(1).select(F.split(F.lit("a"), "b").alias("t")).select(profile.body_ranges("t").alias("x"))
    assert "filter(" in fold._jdf.queryExecution().analyzed().toString()
    text = "contract C {\n" + "    uint256 public a;\n" * 3000 + "    function f() external { g(); }\n    enum E { X, Y }\n}\nabstract  contract D{}"
    got = profile.profile(spark.createDataFrame([("a", text)], "file string, text string")).first()
    assert (got.functions_removed, got.types_replaced) == (1, 0)
    names = profile.declarations(spark.createDataFrame([("a", text)], "file string, text string"))
    assert {r.name for r in names.collect()} == {"C", "D", "E", "X", "Y"}
