"""The contract report (O34) of contracts of bounded size from one exchange of rows.

Variables, struct members, structs and the contract's own row are stacked as flat rows of a few numbers and meet
once, sorted by contract. All figures of the report then follow for the contracts of an Arrow batch at once.
Contracts of at most SMALL rows of which some lack a value (``set_aside``) are gathered in one row each, where null
has the meaning that SQL gives it, with built-in array functions. Contracts with more rows take the chunked
operators (``plans.analysis``), so nothing held at once grows with a contract.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotpack.functions import binpack, nextfit
from slotpack.functions import columns as C
from slotpack.operators.report import ERR_INVALID_SIZE, ERR_SLOT_RANGE
from slotpack.schema import MAX_EXACT_ITEMS, SLOT_SIZE, STATUS_ERROR, STATUS_OK, STRATEGY_EXACT, STRATEGY_FFD

#: Variables, members and structs of a contract that one row may hold.
SMALL = 512
_NEED = "if({0} <= 0, 1, ({0} + 31) div 32)"


#: Kinds of stacked rows; ``k`` is 8 times the kind, twice the class rank and whether the variable is packable.
CONTRACT, STRUCT, MEMBER, VARIABLE = range(4)
_OWN = ("file", "source_unit", "contract_name", "source_ord", "contract_ord")


def _long(column: str) -> Column:
    return F.col(column).cast("bigint")


def stacked(contracts: DataFrame, entries: DataFrame, structs: DataFrame | None, fields: DataFrame | None) -> DataFrame:
    """One flat row per contract, variable, member and struct: contract_id, k, b, ordinal, slot, offset, type_id, c."""
    rank = C.class_rank(C.item_class("encoding", "number_of_bytes"))
    packable = F.coalesce(C.is_packable("encoding", "number_of_bytes"), F.lit(False)).cast("int")
    shape = {"k": "int", "b": "bigint", "ordinal": "bigint", "slot": "bigint", "offset": "bigint", "type_id": "string",
             "c": contracts.select(F.struct(*_OWN).alias("c")).schema["c"].dataType}
    size = {"b": _long("number_of_bytes"), "type_id": F.col("type_id")}
    parts = [(contracts, {"k": F.lit(8 * CONTRACT), "c": F.struct(*_OWN)}),
             (structs, {"k": F.lit(8 * STRUCT), **size}),
             (fields, {"k": 8 * MEMBER + 2 * rank, "ordinal": _long("ordinal"), **size}),
             (entries, {"k": 8 * VARIABLE + 2 * rank + packable, **{x: _long(x) for x in ("ordinal", "slot", "offset")}, **size})]
    out = None
    for d, own in parts:
        if d is not None:
            one = d.select("contract_id", *[own.get(x, F.lit(None)).cast(kind).alias(x) for x, kind in shape.items()])
            out = one if out is None else out.unionByName(one)
    return out


def set_aside(contracts: DataFrame, entries: DataFrame, structs: DataFrame | None, fields: DataFrame | None) -> DataFrame:
    """(contract_id, n) of the contracts with more than SMALL rows or with a value that is null, negative or, for a
    slot, not written as its number; counts are combined before they move."""
    lacking = lambda names: reduce(Column.__or__, [F.coalesce(_long(x) < 0, F.lit(True)) for x in names]) | F.col("type_id").isNull()
    other = ~F.col("slot_text").eqNullSafe(F.col("slot").cast("string"))
    ids = entries.select("contract_id", (lacking(["number_of_bytes", "ordinal", "slot", "offset"]) | other).alias("odd"))
    for d, names in ((structs, ["number_of_bytes"]), (fields, ["number_of_bytes", "ordinal"])):
        if d is not None:
            ids = ids.unionByName(d.select("contract_id", lacking(names).alias("odd")))
    return (ids.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("odd").alias("odd"))
            .where((F.col("n") > SMALL) | F.col("odd")).select("contract_id", "n"))


@lru_cache(maxsize=50_000)
def _first_of_bin(sizes: tuple[int, ...]) -> list[int]:
    """For each packed item the index of the first item in its bin; nothing where the exact packer rejects a size."""
    first: dict[int, int] = {}
    return [first.setdefault(b, i) for i, b in enumerate(binpack.bins_of(sizes))]


#: Numbers of a contract that a batch yields.
FIGURES = ["n_vars", "n_packable", "current_slots", "recommended_slots", "current_wasted", "recommended_wasted", "n_issues",
           "structs_total", "structs_improved", "struct_saved_slots", "bad_size", "bad_member"]


def report(rows: DataFrame) -> DataFrame:
    """One row per contract of the ``stacked`` rows; each contract has at most SMALL of them, and none lacks a value."""
    own = [rows.schema["contract_id"], rows.schema["c"]]
    shape = T.StructType([*own, *[T.StructField(x, T.LongType()) for x in FIGURES]])
    g = rows.repartition("contract_id").sortWithinPartitions("contract_id").mapInArrow(_report_batches, shape)
    return _reported(g, [F.when(F.col(x).isNotNull(), F.format_string(ERR_INVALID_SIZE, F.col(x))) for x in ("bad_size", "bad_member")])


def _reported(g: DataFrame, messages: list[Column]) -> DataFrame:
    """The report's columns from the figures of each contract and its errors, of which the least counts."""
    error = F.least(*messages)
    strategy = F.when(F.col("n_packable") > MAX_EXACT_ITEMS, F.lit(STRATEGY_FFD)).otherwise(F.lit(STRATEGY_EXACT))
    longs = [_long(x).alias(x) for x in FIGURES[:-2]]
    return g.select(
        "contract_id", *[f"c.{x}" for x in _OWN],
        F.when(error.isNull(), F.lit(STATUS_OK)).otherwise(F.lit(STATUS_ERROR)).alias("status"),
        F.coalesce(error, F.lit("")).alias("error"), longs[0], *longs[2:6], strategy.alias("strategy"), *longs[6:])


def _report_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of sorted rows; the last contract of a batch waits for the next batch."""
    kept = None
    for b in batches:
        held = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks().to_batches()
        if held:
            starts = _starts(held[0].column(0))
            if len(starts) > 1:
                yield _figures(held[0].slice(0, starts[-1]), starts)
            kept = _once(held[0].slice(starts[-1]))
    if kept is not None:
        yield _figures(kept, np.array([0, kept.num_rows]))


def _starts(key: pa.Array) -> np.ndarray:
    known, codes = pc.is_valid(key), pc.fill_null(key, "")
    same = pc.and_(pc.equal(codes.slice(1), codes.slice(0, len(key) - 1)), pc.equal(known.slice(1), known.slice(0, len(key) - 1)))
    return np.append(0, 1 + np.flatnonzero(~same.to_numpy(zero_copy_only=False)))


def _once(contract: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of one contract with the first of its own rows only, however often it is listed."""
    own = np.flatnonzero(contract.column("k").to_numpy() < 8)
    return contract if len(own) < 2 else contract.take(np.delete(np.arange(contract.num_rows), own[1:]))


def _need(b: np.ndarray) -> np.ndarray:
    return np.where(b <= 0, 1, (b + 31) // 32)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    n = len(keys[0])
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([np.zeros(min(n, 1), np.int64), 1 + np.flatnonzero(new), [n]])


def _added(n: int, group: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, group, values)
    return out


def _packed(sizes: np.ndarray, bounds: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """``_first_of_bin`` of every run, and whether the exact packer rejects a size of it."""
    each = sizes.tolist()
    firsts = [_first_of_bin(tuple(each[a:e])) for a, e in zip(bounds[:-1], bounds[1:], strict=True)]
    return firsts, np.array([len(f) == 0 for f in firsts], bool)


def _of(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key from sorted distinct ``keys``; 0 without any."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _figures(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
    """The figures of whole contracts that lie between ``bounds``."""
    n = len(bounds) - 1
    group = np.repeat(np.arange(n), np.diff(bounds))
    k = batch.column("k").to_numpy().astype(np.int64)
    kind, rank, packable = k >> 3, k >> 1 & 3, (k & 1) == 1
    b, ordinal, slot, offset = (pc.fill_null(batch.column(x), 0).to_numpy() for x in ("b", "ordinal", "slot", "offset"))
    types = pc.fill_null(pc.dictionary_encode(batch.column("type_id")).indices, -1).to_numpy().astype(np.int64)
    typed = group * (types.max(initial=0) + 2) + types + 1
    # the current layout: variables by slot and offset
    v = np.flatnonzero(kind == VARIABLE)
    v = v[np.lexsort((packable[v], rank[v], b[v], ordinal[v], offset[v], slot[v], group[v]))]
    gv, runs = group[v], _runs(group[v], slot[v])
    current = np.zeros(n, np.int64)
    np.maximum.at(current, gv, slot[v] + _need(b[v]))
    used, of_run = np.add.reduceat(b[v], runs[:-1]) if len(v) else b[:0], gv[runs[:-1]]
    stranded = (b[v][1:-1] >= SLOT_SIZE) & packable[v][:-2] & packable[v][2:] & (gv[:-2] == gv[2:])
    issues = _added(n, of_run, used < SLOT_SIZE) + _added(n, gv[1:-1], stranded)
    # the recommended order: full, packed by first member, dynamic
    pk = np.flatnonzero((kind == VARIABLE) & (rank == 1))
    pk = pk[np.lexsort((b[pk], ordinal[pk], group[pk]))]
    at = _runs(group[pk])
    firsts, rejected = _packed(b[pk], at)
    bad_size, smallest = np.zeros(n, bool), np.zeros(n, np.int64)
    bad_size[group[pk[at[:-1]]]] = rejected
    first = ordinal.copy()
    if len(pk):
        smallest[group[pk[at[:-1]]]] = np.minimum.reduceat(b[pk], at[:-1])
        member = [a + i for a, e, f in zip(at[:-1].tolist(), at[1:].tolist(), firsts, strict=True) for i in (f or range(e - a))]
        first[pk] = ordinal[pk][member]
    listed = v[~bad_size[gv]]
    listed = listed[np.lexsort((b[listed], ordinal[listed], first[listed], rank[listed], group[listed]))]
    ends = np.searchsorted(group[listed], np.arange(n + 1))
    place, fill = nextfit.places(b[listed], ends)
    last, some = ends[1:] - 1, np.diff(ends) > 0
    recommended = np.zeros(n, np.int64)
    size = b[listed][last[some]]
    recommended[some] = place[last[some]] + np.where(size >= SLOT_SIZE, (size + 31) // 32, fill[last[some]] + size > 0)
    # structs: members of a type packed again, times the variables of that type
    s = np.flatnonzero(kind == STRUCT)
    m = np.flatnonzero(kind == MEMBER)
    m = m[np.lexsort((b[m], ordinal[m], typed[m]))]
    alone = np.where(rank[m] == 0, (b[m] + 31) // 32, rank[m] == 2)
    keys, number = np.unique(typed[m], return_inverse=True)
    whole = _of(keys, _added(len(keys), number, alone), typed[s])
    pm = m[rank[m] == 1]
    at = _runs(typed[pm])
    firsts, rejected = _packed(b[pm], at)
    keys = typed[pm[at[:-1]]]
    saved = (b[s] + 31) // 32 - whole - _of(keys, np.array([len(set(f)) for f in firsts], np.int64), typed[s])
    of_type = np.sort(typed[v])
    instances = np.searchsorted(of_type, typed[s], "right") - np.searchsorted(of_type, typed[s], "left")
    bad = _of(keys, rejected, typed[s]) > 0
    least = _of(keys, np.minimum.reduceat(b[pm], at[:-1]) if len(pm) else b[:0], typed[s])
    bad_member, worst = np.zeros(n, bool), np.full(n, np.iinfo(np.int64).max)
    bad_member[group[s[bad]]] = True
    np.minimum.at(worst, group[s[bad]], least[bad])
    own = np.flatnonzero(kind == CONTRACT)
    listed_once, place_of = np.unique(group[own], return_index=True)
    values = [np.bincount(gv, minlength=n), np.bincount(group[pk], minlength=n), current, recommended,
              _added(n, of_run, _need(used) * SLOT_SIZE - used), recommended * SLOT_SIZE - _added(n, group[listed], b[listed]), issues,
              np.bincount(group[s], minlength=n), _added(n, group[s], saved > 0), _added(n, group[s], np.maximum(saved, 0) * instances)]
    figures = [pa.array(x[listed_once].astype(np.int64)) for x in values]
    errors = [pa.array(x[listed_once], mask=~found[listed_once]) for x, found in ((smallest, bad_size), (worst, bad_member))]
    held = batch.select(["contract_id", "c"]).take(pa.array(own[place_of]))
    return pa.RecordBatch.from_arrays([*held.columns, *figures, *errors], ["contract_id", "c", *FIGURES])


# ---------------------------------------------------------------------------
# Contracts with missing values: one row each
# ---------------------------------------------------------------------------
def nested(contracts: DataFrame, entries: DataFrame, structs: DataFrame | None, fields: DataFrame | None) -> DataFrame:
    """One row per contract, variable, member and struct: contract_id and one of the structs c, v, m, s."""
    rank = C.class_rank(C.item_class("encoding", "number_of_bytes"))
    size, own = F.col("number_of_bytes").cast("bigint").alias("b"), F.col("ordinal").cast("bigint").alias("ordinal")
    parts = {
        "c": (contracts, F.struct(*_OWN)),
        "v": (entries, F.struct(F.col("slot").cast("bigint").alias("slot"), F.col("offset").cast("bigint").alias("offset"), own,
                                size, rank.alias("r"), C.is_packable("encoding", "number_of_bytes").alias("p"), "type_id",
                                "slot_text")),
        "m": (fields, F.struct("type_id", own, size, rank.alias("r"))),
        "s": (structs, F.struct("type_id", size)),
    }
    kinds = {k: d.select(s.alias("x")).schema["x"].dataType for k, (d, s) in parts.items() if d is not None}
    kinds = {"m": T.StructType.fromDDL("type_id string, ordinal bigint, b bigint, r int"),
             "s": T.StructType.fromDDL("type_id string, b bigint")} | kinds
    out = None
    for kind, (d, value) in parts.items():
        if d is None:
            continue
        one = d.select("contract_id", *[(value if k == kind else F.lit(None).cast(kinds[k])).alias(k) for k in "cvms"])
        out = one if out is None else out.unionByName(one)
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _firsts(vectors: pd.Series) -> pd.Series:
    """``_first_of_bin`` of every size vector of a row."""
    return vectors.map(lambda row: [_first_of_bin(tuple(int(b) for b in v)) for v in row])


def _per_slot(pairs: str, of_slot: str) -> str:
    """Sum over the runs of equal ``k`` in the sorted array ``pairs`` of (k, b) of ``of_slot``, an SQL text on the run's ``used``."""
    closed = "a.t + if(a.n = 0, 0, " + of_slot.replace("used", "a.u") + ")"
    state = "named_struct('k', {k}, 'n', {n}, 'u', {u}, 't', {t})"
    zero = state.format(k="cast(null as {kind})", n="0", u="0L", t="0L")
    same = state.format(k="x.k", n="1", u="a.u + x.b", t="a.t")
    new = state.format(k="x.k", n="1", u="x.b", t=f"cast({closed} as bigint)")
    return (f"aggregate({pairs}, {zero}, (a, x) -> if(a.n = 1 and a.k <=> x.k, {same}, {new}), "
            f"a -> cast({closed} as bigint))")


def nested_report(rows: DataFrame) -> DataFrame:
    """``report`` of ``nested`` rows, any value of which may be missing."""
    g = rows.groupBy("contract_id").agg(
        F.first("c", ignorenulls=True).alias("c"), F.array_sort(F.collect_list("v")).alias("v"),
        F.collect_list("m").alias("m"), F.collect_list("s").alias("s")).where(F.col("c").isNotNull())
    g = g.withColumn("pk", F.expr("array_sort(transform(filter(v, x -> x.r = 1), x -> named_struct('o', x.ordinal, 'b', x.b)))"))
    g = g.withColumn("t", F.expr(
        "transform(s, k -> named_struct('b', k.b, 'inst', size(filter(v, x -> x.type_id = k.type_id)), "
        "'own', filter(m, y -> y.type_id = k.type_id)))"))
    g = g.withColumn("t", F.expr(
        "transform(t, k -> named_struct('b', k.b, 'inst', k.inst, "
        "'whole', aggregate(k.own, 0L, (a, y) -> a + case y.r when 0 then (y.b + 31) div 32 when 2 then 1 else 0 end), "
        "'sizes', transform(array_sort(transform(filter(k.own, y -> y.r = 1), y -> named_struct('o', y.ordinal, 'b', y.b))), "
        "y -> y.b)))"))
    g = g.withColumn("f", _firsts(F.expr("concat(array(transform(pk, x -> x.b)), transform(t, k -> k.sizes))")))
    exact = f"<= {MAX_EXACT_ITEMS}"
    g = g.withColumn("bad_size", F.expr(f"if(size(pk) {exact}, array_min(transform(filter(pk, x -> x.b <= 0), x -> x.b)), null)"))
    order = ("array_sort(concat(transform(filter(v, x -> x.r <> 1), x -> named_struct('r', x.r, 'g', x.ordinal, 'o', x.ordinal, 'b', x.b)), "
             "transform(pk, (x, i) -> named_struct('r', 1, 'g', pk[f[0][i]].o, 'o', x.o, 'b', x.b))))")
    start = "named_struct('s', 0L, 'u', 0, 'w', 0L)"
    g = g.withColumn("e", F.expr(f"if(bad_size is not null, {start}, "
                                 f"aggregate({order}, {start}, (st, x) -> {nextfit.step_sql('st', 'x.b')}))"))
    g = g.withColumn("o", F.expr(
        "transform(t, (k, i) -> named_struct('saved', (k.b + 31) div 32 - k.whole - size(array_distinct(f[i + 1])), 'inst', k.inst, "
        f"'bad', if(size(k.sizes) {exact}, array_min(filter(k.sizes, b -> b <= 0)), null)))"))
    pairs = "array_sort(transform(v, x -> named_struct('k', x.{0}, 'b', x.b)))"
    waste = _per_slot(pairs.format("slot"), f"{_NEED.format('used')} * {SLOT_SIZE} - used").replace("{kind}", "bigint")
    partial = _per_slot(pairs.format("slot_text"), f"if(used < {SLOT_SIZE}, 1, 0)").replace("{kind}", "string")
    stranded = (f"if(size(v) < 3, 0, size(filter(sequence(1, size(v) - 2), "
                f"i -> v[i].b >= {SLOT_SIZE} and v[i - 1].p and v[i + 1].p)))")
    bad_slot = "array_min(transform(filter(v, x -> x.slot is null), x -> x.slot_text))"
    bad_member = "array_min(transform(filter(o, k -> k.bad is not null), k -> k.bad))"
    message = [F.when(F.expr(bad_slot).isNotNull(), F.format_string(ERR_SLOT_RANGE, F.expr(bad_slot))),
               F.when(F.col("bad_size").isNotNull(), F.format_string(ERR_INVALID_SIZE, F.col("bad_size"))),
               F.when(F.expr(bad_member).isNotNull(), F.format_string(ERR_INVALID_SIZE, F.expr(bad_member)))]
    figures = {
        "n_vars": F.size("v"), "n_packable": F.size("pk"),
        "current_slots": F.expr(f"coalesce(array_max(transform(v, x -> x.slot + {_NEED.format('x.b')})), 0L)"),
        "recommended_slots": F.expr("e.s + if(e.u > 0, 1, 0)"), "current_wasted": F.expr(waste),
        "recommended_wasted": F.expr(f"e.w + if(e.u > 0, {SLOT_SIZE} - e.u, 0)"), "n_issues": F.expr(f"{partial} + {stranded}"),
        "structs_total": F.size("s"), "structs_improved": F.expr("size(filter(o, k -> k.saved > 0))"),
        "struct_saved_slots": F.expr("aggregate(o, 0L, (a, k) -> a + if(k.saved > 0, k.saved * k.inst, 0L))")}
    return _reported(g.select("contract_id", "c", *[x.alias(name) for name, x in figures.items()], *[
        x.alias(f"_error{i}") for i, x in enumerate(message)]), [F.col(f"_error{i}") for i in range(len(message))])
