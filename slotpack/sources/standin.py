"""Stand-in layout corpus built from the driver's TPC-H-like tables.

The driver tables hold no compiler output, so ``lineitem`` rows play the state variables of a
corpus of contracts (SURVEY 7.2): one contract per order (few variables: the exact packer) and one
per part (about 30 variables: first-fit decreasing). This module only produces rows in the schema
of the ``contracts`` / ``entries`` / ``structs`` / ``struct_fields`` tables; every analysis step runs
in the operators on top of them.

Mapping (fixed, also written in the oracle SQL):
* variable type from ``cast(l_quantity as int) % 10`` through the ten-entry type list below
  (code 9 is the struct type: its size is that of the contract's struct definition);
* struct members (struct ``Pair``, one per contract) from ``(l_linenumber + l_suppkey) % 9``;
* ordinal = position under the unique key (l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_extendedprice) inside the contract;
* slot/offset of variables and members: the compiler's sequential rule (``declared_layout``);
* file: ``real/c<custkey>-<orderkey div 1000>.sol`` (``pending/`` for status P) for orders, ``synthetic/<brand>-<partkey
  div 100>.sol`` for parts (a bounded number of contracts per file); with ``whole_files`` one file
  ``c<custkey>.sol`` holds all orders of a customer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotpack.functions import nextfit, ordered

# Fixed stand-in type list: (type id, type label, bytes, encoding), indexed by code 0..9.
TYPE_LIST = [
    ("t_bool", "bool", 1, "inplace"),
    ("t_uint16", "uint16", 2, "inplace"),
    ("t_uint32", "uint32", 4, "inplace"),
    ("t_uint64", "uint64", 8, "inplace"),
    ("t_uint96", "uint96", 12, "inplace"),
    ("t_uint128", "uint128", 16, "inplace"),
    ("t_address", "address", 20, "inplace"),
    ("t_uint256", "uint256", 32, "inplace"),
    ("t_mapping(t_address,t_uint256)", "mapping(address => uint256)", 32, "mapping"),
    ("t_struct(Pair)_storage", "struct Pair", 0, "inplace"),  # size: the contract's struct definition
]
STRUCT_TYPE_ID = "t_struct(Pair)_storage"
STRUCT_LABEL = "struct Pair"

CORPORA = {
    # name: (group column, contract id prefix, contract name prefix)
    "order": ("l_orderkey", "O", "Order"),
    "part": ("l_partkey", "P", "Part"),
}
SORT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _lookup(code: F.Column, idx: int) -> F.Column:
    return F.element_at(F.array(*[F.lit(t[idx]) for t in TYPE_LIST]), code + 1)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _codes() -> list[F.Column]:
    return [(F.col("l_quantity").cast("int") % 10).alias("_code"),
            ((F.col("l_linenumber") + F.col("l_suppkey")) % 9).cast("int").alias("_mcode")]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(*SORT_KEY, "l_quantity")


def variables(spark: SparkSession, sf_dir: str, corpora=("order", "part"), lines: DataFrame | None = None) -> DataFrame:
    """Stand-in variables without positions: contract_id, ordinal, label, type columns, member code."""
    li = lines if lines is not None else _lines(spark, sf_dir)
    parts = []
    for name in corpora:
        key, id_prefix, _ = CORPORA[name]
        w = Window.partitionBy(key).orderBy(*SORT_KEY)
        parts.append(li.select(
            F.concat(F.lit(id_prefix), F.col(key).cast("string")).alias("contract_id"),
            (F.row_number().over(w) - 1).cast("int").alias("ordinal"),
            *_codes(),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keyless(spark: SparkSession, sf_dir: str, corpora=("order", "part")) -> DataFrame | None:
    """Variables (contract_id, ordinal, number_of_bytes) of the lines without a contract's key, which have no struct
    definition; None without any."""
    lines = _lines(spark, sf_dir)
    lost = {name: lines.where(F.col(CORPORA[name][0]).isNull()) for name in corpora}
    found = [variables(spark, sf_dir, (name,), rows) for name, rows in lost.items() if not rows.isEmpty()]
    if not found:
        return None
    size = F.when(_lookup(F.col("_code"), 0) != STRUCT_TYPE_ID, _lookup(F.col("_code"), 2))
    return reduce(DataFrame.unionByName, found).select("contract_id", "ordinal", size.cast("int").alias("number_of_bytes"))


def entries(spark: SparkSession, sf_dir: str, corpora=("order", "part"),
            base: DataFrame | None = None, structs_df: DataFrame | None = None) -> DataFrame:
    """``entries`` table with slots assigned by the compiler's sequential rule.

    Variables of the struct type take the size of their contract's struct definition.
    """
    v = base if base is not None else variables(spark, sf_dir, corpora)
    if structs_df is None:
        structs_df = structs(struct_fields(spark, sf_dir, corpora, base=v))
    sizes = structs_df.select("contract_id", F.col("number_of_bytes").alias("_struct_bytes"))
    typed = v.join(sizes, "contract_id", "left").select(
        "contract_id", "ordinal",
        F.col("ordinal").alias("ast_id"),
        F.col("contract_id").alias("contract"),
        F.concat(F.lit("v"), F.col("ordinal").cast("string")).alias("label"),
        _lookup(F.col("_code"), 0).alias("type_id"),
        F.when(_lookup(F.col("_code"), 0) == STRUCT_TYPE_ID, F.col("_struct_bytes"))
        .otherwise(_lookup(F.col("_code"), 2)).cast("int").alias("number_of_bytes"),
        _lookup(F.col("_code"), 1).alias("type_label"),
        _lookup(F.col("_code"), 3).alias("encoding"),
    )
    placed = nextfit.positions(typed, ["contract_id"], "ordinal", "number_of_bytes")
    return (
        typed.join(placed.withColumn("ordinal", F.col("ordinal").cast("int")), ["contract_id", "ordinal"])
        .select(
            "contract_id", "ordinal", "ast_id", "contract", "label", "offset",
            F.col("slot").cast("string").alias("slot_text"), F.col("slot").cast("bigint").alias("slot"),
            "type_id", "number_of_bytes", "type_label", "encoding",
        )
    )


def struct_fields(spark: SparkSession, sf_dir: str, corpora=("order", "part"),
                  base: DataFrame | None = None) -> DataFrame:
    """Members of struct ``Pair`` of every contract, slots by the sequential rule."""
    v = base if base is not None else variables(spark, sf_dir, corpora)
    typed = v.select(
        "contract_id", F.lit(STRUCT_TYPE_ID).alias("type_id"), "ordinal",
        F.concat(F.lit("f"), F.col("ordinal").cast("string")).alias("label"),
        _lookup(F.col("_mcode"), 0).alias("member_type_id"),
        _lookup(F.col("_mcode"), 1).alias("type_label"),
        _lookup(F.col("_mcode"), 2).cast("int").alias("number_of_bytes"),
        _lookup(F.col("_mcode"), 3).alias("encoding"),
    )
    placed = nextfit.positions(typed, ["contract_id", "type_id"], "ordinal", "number_of_bytes")
    return (
        typed.join(placed.withColumn("ordinal", F.col("ordinal").cast("int")), ["contract_id", "type_id", "ordinal"])
        .select("contract_id", "type_id", "ordinal", "label", "member_type_id", "type_label",
                "number_of_bytes", "encoding", F.col("slot").cast("int").alias("slot"), "offset")
    )


def structs(fields: DataFrame) -> DataFrame:
    """Struct definitions: size = 32 x the slots its members span."""
    return (
        fields.groupBy("contract_id", "type_id")
        .agg(F.max(F.col("slot") + F.greatest(F.lit(1), F.expr("(number_of_bytes + 31) div 32"))).alias("_slots"))
        .select("contract_id", F.lit(0).alias("struct_ord"), "type_id", F.lit(STRUCT_LABEL).alias("label"),
                (F.col("_slots") * 32).cast("int").alias("number_of_bytes"))
    )


#: Order keys of one file: a file holds at most so many contracts, whatever one customer has.
FILE_ORDERS = 1000


def contracts(spark: SparkSession, sf_dir: str, corpora=("order", "part"), whole_files: bool = False) -> DataFrame:
    """``contracts`` table: file, source unit, name and order of every stand-in contract."""
    outs = []
    cut = [] if whole_files else [F.lit("-"), F.expr(f"o_orderkey div {FILE_ORDERS}").cast("string")]
    if "order" in corpora:
        o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        outs.append(o.select(
            F.concat(F.when(F.col("o_orderstatus") == "P", F.lit("pending/")).otherwise(F.lit("real/")),
                     F.lit("c"), F.col("o_custkey").cast("string"), *cut, F.lit(".sol")).alias("file"),
            F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")).alias("contract_name"),
            F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("contract_id"),
            F.col("o_orderkey").alias("_k"),
        ))
    if "part" in corpora:
        p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
        outs.append(p.select(
            F.concat(F.lit("synthetic/"), F.regexp_replace("p_brand", "#", "_"), F.lit("-"),
                     F.expr("p_partkey div 100").cast("string"), F.lit(".sol")).alias("file"),
            F.concat(F.lit("Part"), F.col("p_partkey").cast("string")).alias("contract_name"),
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("contract_id"),
            F.col("p_partkey").alias("_k"),
        ))
    c = outs[0]
    for x in outs[1:]:
        c = c.unionByName(x)
    w = Window.partitionBy("file").orderBy("_k")
    return c.select(
        "file", F.col("file").alias("source_unit"), "contract_name",
        F.lit(0).alias("source_ord"), (F.row_number().over(w) - 1).cast("int").alias("contract_ord"),
        "contract_id",
    )


#: Variables of a contract that one batch may hold while they are placed; those of larger ones are placed by chunks.
GATHERED = 512
_SIZES = "array(" + ", ".join(str(t[2]) for t in TYPE_LIST) + ")"


def placed(spark: SparkSession, sf_dir: str, corpora=("order", "part")) -> tuple[DataFrame, DataFrame | None]:
    """Variables and struct members of the contracts with their places: one exchange and sort of each corpus' lines.

    One row per line of a contract: ordinal, codes of the variable's and the member's type, slot and offset of
    both, and the bytes of the contract's struct. Lines without a contract's key are in no contract. Second, the
    ``variables`` of the contracts that take the folds by chunks: those of over GATHERED lines or with unknown codes.
    """
    rows, rest = [], []
    unknown = F.col("l_quantity").isNull() | F.col("l_linenumber").isNull() | F.col("l_suppkey").isNull()
    for name in corpora:
        key, id_prefix, _ = CORPORA[name]
        contract = F.concat(F.lit(id_prefix), F.col(key).cast("string")).alias("contract_id")
        small, other = ordered.split(_lines(spark, sf_dir).where(F.col(key).isNotNull()), [key], GATHERED, unknown)
        rows.append(_placed_in_rows(small.select(*SORT_KEY, *_codes()), key, contract))
        if other is not None:
            rest.append(variables(spark, sf_dir, (name,), other))
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, rest) if rest else None


def _placed_in_rows(lines: DataFrame, key: str, contract: F.Column) -> DataFrame:
    """``placed`` of contracts of bounded size: a contract's lines meet in order in one task, placed batch by batch."""
    struct_code = next(i for i, t in enumerate(TYPE_LIST) if t[0] == STRUCT_TYPE_ID)
    order = [*SORT_KEY, "_code", "_mcode"]
    rows = (lines.repartition(key).sortWithinPartitions(key, *order)
            .select(key, "_code", "_mcode", F.expr(f"if(_code = {struct_code}, null, element_at({_SIZES}, _code + 1))").alias("b"),
                    F.expr(f"element_at({_SIZES}, _mcode + 1)").alias("mb")))
    out = rows.mapInArrow(_place_batches, f"{key} {rows.schema[key].dataType.simpleString()}, ordinal int, _code int, _mcode int, "
                          "number_of_bytes int, slot bigint, offset int, member_slot bigint, member_offset int, struct_bytes int")
    return out.select(contract, *out.columns[1:])


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of sorted lines; the last contract of a batch waits for the next batch."""
    kept = None
    for b in batches:
        held = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks().to_batches()
        if held:
            starts = _starts(held[0])
            if len(starts) > 1:
                yield _placed_batch(held[0].slice(0, starts[-1]), starts)
            kept = held[0].slice(starts[-1])
    if kept is not None:
        yield _placed_batch(kept, np.array([0, kept.num_rows]))


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    key = batch.column(0)
    return np.append(0, 1 + np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)))


def _placed_batch(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
    """Lines of whole contracts with their places; variables without a size are of the contract's struct."""
    count = np.diff(bounds)
    member = batch.column("mb").to_numpy().astype(np.int64)
    member_slot, member_offset = nextfit.places(member, bounds)
    struct = np.repeat(32 * np.maximum.reduceat(member_slot + np.maximum(1, (member + 31) // 32), bounds[:-1]), count)
    own = batch.column("b")
    size = np.where(own.is_null().to_numpy(zero_copy_only=False), struct, pc.fill_null(own, 0).to_numpy())
    slot, offset = nextfit.places(size, bounds)
    ordinal = np.arange(len(size)) - np.repeat(bounds[:-1], count)
    ints = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), ints(ordinal), batch.column("_code"), batch.column("_mcode"), ints(size), pa.array(slot), ints(offset),
         pa.array(member_slot), ints(member_offset), ints(struct)],
        [batch.schema.names[0], "ordinal", "_code", "_mcode", "number_of_bytes", "slot", "offset", "member_slot", "member_offset",
         "struct_bytes"])


class Corpus:
    """The four layout tables of the stand-in corpus, built lazily from one sf directory.

    The placed variables and the contracts are written once to the checkpoint folder on first use: they are
    the corpus input, of which the other tables are views. Contracts placed by chunks have tables of their own.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, corpora=("order", "part"), materialized: bool = True,
                 whole_files: bool = False):
        self.spark, self.sf_dir, self.corpora, self.whole_files = spark, sf_dir, tuple(corpora), whole_files
        self._keep = _materialize if materialized else (lambda d: d)
        self._t: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._t:
            self._t[name] = build()
        return self._t[name]

    def _both(self) -> tuple[DataFrame, DataFrame | None]:
        def build():
            rows, rest = placed(self.spark, self.sf_dir, self.corpora)
            return self._keep(rows), None if rest is None else self._keep(rest)
        return self._get("placed", build)

    @property
    def _placed(self) -> DataFrame:
        return self._both()[0]

    def _with_rest(self, view: DataFrame, name: str, build) -> DataFrame:
        """``view`` and the same table of the contracts placed by chunks, built from their variables."""
        v = self._both()[1]
        return view if v is None else view.unionByName(self._get(name, lambda: self._keep(build(v))))

    @property
    def entries(self) -> DataFrame:
        code = F.col("_code")
        view = self._placed.select(
            "contract_id", "ordinal", F.col("ordinal").alias("ast_id"), F.col("contract_id").alias("contract"),
            F.concat(F.lit("v"), F.col("ordinal").cast("string")).alias("label"), "offset",
            F.col("slot").cast("string").alias("slot_text"), "slot", _lookup(code, 0).alias("type_id"), "number_of_bytes",
            _lookup(code, 1).alias("type_label"), _lookup(code, 3).alias("encoding"))
        return self._with_rest(view, "entries", lambda v: entries(self.spark, self.sf_dir, base=v))

    @property
    def struct_fields(self) -> DataFrame:
        code = F.col("_mcode")
        view = self._placed.select(
            "contract_id", F.lit(STRUCT_TYPE_ID).alias("type_id"), "ordinal",
            F.concat(F.lit("f"), F.col("ordinal").cast("string")).alias("label"), _lookup(code, 0).alias("member_type_id"),
            _lookup(code, 1).alias("type_label"), _lookup(code, 2).cast("int").alias("number_of_bytes"),
            _lookup(code, 3).alias("encoding"), F.col("member_slot").cast("int").alias("slot"),
            F.col("member_offset").alias("offset"))
        return self._with_rest(view, "fields", lambda v: struct_fields(self.spark, self.sf_dir, base=v))

    @property
    def structs(self) -> DataFrame:
        view = self._placed.where(F.col("ordinal") == 0).select(
            "contract_id", F.lit(0).alias("struct_ord"), F.lit(STRUCT_TYPE_ID).alias("type_id"),
            F.lit(STRUCT_LABEL).alias("label"), F.col("struct_bytes").alias("number_of_bytes"))
        return self._with_rest(view, "structs", lambda v: structs(struct_fields(self.spark, self.sf_dir, base=v)))

    @property
    def contracts(self) -> DataFrame:
        return self._get("contracts", lambda: self._keep(contracts(self.spark, self.sf_dir, self.corpora,
                                                                     self.whole_files)))


def _materialize(df: DataFrame) -> DataFrame:
    """The stand-in tables are the corpus input: write them once to the checkpoint folder."""
    from slotpack.session import materialize
    return materialize(df, "standin")


# ---------------------------------------------------------------------------
# Source texts (stand-in for the Solidity files of the corpus)
# ---------------------------------------------------------------------------
FILE_HEADER_FIXED = "pragma solidity 0.8.19;"
FILE_HEADER_CARET = "pragma solidity ^0.8.19;"
FILE_PRELUDE = ['import "./Base.sol";', 'import {Token, Vault} from "./Deps.sol";',
                "interface IHook { function hook() external; }"]


def _decl_type() -> F.Column:
    odd = (F.col("ordinal") % 2) == 1
    return (F.when((F.col("type_id") == "t_address") & odd, F.lit("Token"))
            .when((F.col("type_id") == "t_uint128") & odd, F.lit("Vault[]"))
            .when(F.col("type_id") == STRUCT_TYPE_ID, F.lit("Pair"))
            .when(F.col("type_id").startswith("t_mapping") & odd, F.lit("mapping(address owner => IERC20 token)"))
            .otherwise(F.col("type_label")))


def sources(contracts_df: DataFrame, entries_df: DataFrame) -> DataFrame:
    """(file, text): one Solidity-like file per corpus file, declaring its contracts' variables.

    Real files pin the compiler version, every contract inherits ``Base`` (and ``Ownable`` and ``Named``
    from four variables on), odd-sized contracts use a library, contracts with a mapping carry an
    @inheritdoc tag, odd positions of address/uint128/mapping variables use the external types Token,
    Vault[] and IERC20. Comments and strings hold brackets.
    """
    nl = F.lit("\n")
    decls = (entries_df.select("contract_id", "ordinal", "type_id",
                               F.concat(F.lit("    "), _decl_type(), F.lit(" public "), F.col("label"), F.lit(";"))
                               .alias("line"))
             .groupBy("contract_id")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "line"))),
                                           lambda x: x["line"]), "\n").alias("decls"),
                  F.count(F.lit(1)).alias("n"),
                  F.max(F.col("type_id").startswith("t_mapping").cast("int")).alias("hm")))
    many = F.col("n") >= 4
    ctext = F.concat(
        F.lit("contract "), F.col("contract_name"), F.lit(" is Base"),
        F.when(many, F.lit(', Ownable(msg.sender), Named("My (x) Token", key(1, 2))')).otherwise(F.lit("")),
        F.lit(" {"), nl, F.lit("    // note: (a) => b {\n"),
        F.when(F.col("n") % 2 == 1, F.lit("    using SafeMath for uint256;\n")).otherwise(F.lit("")),
        F.lit("    enum Mode {\n        Idle,\n        Busy\n    }\n"),
        F.lit("    struct Pair { uint64 a; bool b; }\n"),
        F.col("decls"), nl,
        F.when(F.col("hm") == 1, F.lit("    /// @inheritdoc Base\n")).otherwise(F.lit("")),
        F.lit("    constructor(uint256 a) Base(a)"),
        F.when(many, F.lit(" Ownable(msg.sender)")).otherwise(F.lit("")), F.lit(" {}\n"),
        F.lit('    function touch() external {\n        if (true) { emit Log("}"); }\n    }\n'),
        F.lit("}"))
    per_contract = contracts_df.join(decls, "contract_id").select("file", "contract_ord", ctext.alias("ctext"))
    header = F.concat(
        F.lit("// SPDX-License-Identifier: MIT\n"),
        F.when(F.col("file").startswith("real/"), F.lit(FILE_HEADER_FIXED)).otherwise(F.lit(FILE_HEADER_CARET)), nl,
        F.lit("\n".join(FILE_PRELUDE)), nl)
    return (per_contract.groupBy("file")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("contract_ord", "ctext"))),
                                          lambda x: x["ctext"]), "\n").alias("_body"))
            .select("file", F.concat(header, F.col("_body")).alias("text")))


def payloads(sources_df: DataFrame, contracts_df: DataFrame) -> DataFrame:
    """Verified-source payloads, one per source file.

    ``pending/`` files are plain text; ``real/`` files are multi-file JSON with a ``sources`` key,
    wrapped in a second pair of braces when the path length is odd. The named contract is the
    file's last contract, or ``Vault`` (declared nowhere) when the path length is a multiple of 3.
    The address is the SHA-1 of the path.
    """
    last = (contracts_df.groupBy("file")
            .agg(F.max_by("contract_name", "contract_ord").alias("_last")))
    d = sources_df.join(last, "file")
    files = F.create_map(F.lit("Base.sol"), F.struct(F.lit("contract Base {}").alias("content")),
                         F.col("file"), F.struct(F.col("text").alias("content")),
                         F.lit("Deps.sol"), F.struct(F.lit("").alias("content")))
    obj = F.to_json(F.struct(F.lit("Solidity").alias("language"), files.alias("sources")))
    address = F.concat(F.lit("0x"), F.sha1(F.col("file")))
    code = (F.when(F.col("file").startswith("pending/"), F.col("text"))
            .when(F.length("file") % 2 == 1, F.concat(F.lit("{"), obj, F.lit("}"))).otherwise(obj))
    name = F.when(F.length("file") % 3 == 0, F.lit("Vault")).otherwise(F.col("_last"))
    return d.select(address.alias("address"), name.alias("contract_name"), code.alias("source_code"),
                    F.concat(F.lit("https://explorer.example/address/"), address, F.lit("#code")).alias("link"),
                    F.concat(F.sha1(F.col("file")), F.lit("_"), name, F.lit(".sol")).alias("file_name"))


#: Remainders (contract key modulo FAULT_MODULUS) of documents with a planted fault.
FAULT_MODULUS = 40
COMPILE_ERROR, CORRUPT, NO_CONTRACTS, NO_LAYOUT, WARNING, HUGE_SLOT, TEXT_NUMBERS, OTHER_SHAPES = 7, 8, 9, 10, 11, 12, 13, 14


def faulty_documents(docs: DataFrame) -> DataFrame:
    """Layout documents (one per contract, with its contract_id and contract_name) some of which are faulty.

    By the contract's key: a compile error, a text cut in half, no contracts, no layout, a mere warning,
    slot numbers beyond 64 bits, and two harmless ones: numbers as text or beyond 32 bits, parts of other shapes.
    """
    case = F.substring("contract_id", 2, 30).cast("bigint") % FAULT_MODULUS
    message = F.concat(F.lit('{"severity":"%s","formattedMessage":"Stand-in message for '), F.col("contract_name"),
                       F.lit('\\nsecond line"}'))
    errors = lambda kind: F.concat(F.lit('"errors":['), F.replace(message, F.lit("%s"), F.lit(kind)), F.lit("]"))
    none = F.lit('"errors":[]')
    text = (F.when(case == COMPILE_ERROR, F.replace("json", none, errors("error")))
            .when(case == CORRUPT, F.substring("json", F.lit(1), F.floor(F.length("json") / 2).cast("int")))
            .when(case == NO_CONTRACTS, F.lit('{"contracts":{},"errors":[]}'))
            .when(case == NO_LAYOUT, F.lit('{"contracts":{"A.sol":{"A":{}}},"errors":[]}'))
            .when(case == WARNING, F.replace("json", none, errors("warning")))
            .when(case == HUGE_SLOT, F.replace("json", F.lit('"slot":"0"'), F.lit('"slot":"99999999999999999999"')))
            .when(case == TEXT_NUMBERS, F.regexp_replace(F.regexp_replace("json", r'"offset":(\d+)', '"offset":"$1"'),
                                                         r'"astId":\d+', '"astId":99999999999'))
            .when(case == OTHER_SHAPES, F.replace(F.replace("json", none, F.lit('"errors":{}')), F.lit('"types":{'),
                                                  F.lit('"types":{"t_odd":7,')))
            .otherwise(F.col("json")))
    return docs.select("file", text.alias("json"))


def example_index(sources_df: DataFrame, contracts_df: DataFrame) -> DataFrame:
    """Example index rows (id, title, tag, kind, description, file), one per source file."""
    from slotpack.functions.columns import kind_of
    first = contracts_df.groupBy("file").agg(F.min_by("contract_name", "contract_ord").alias("title"))
    return first.select(F.concat(F.lit("ex-"), F.substring(F.sha1("file"), 1, 8)).alias("id"), "title",
                        F.upper(kind_of("file")).alias("tag"), kind_of("file").alias("kind"),
                        F.concat(F.lit("Contracts of "), F.col("file")).alias("description"), "file")
