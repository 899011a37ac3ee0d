"""Sequential slot filling (next-fit) as a chunked, skew-safe Spark fold.

Both the compiler's declared-order slot assignment (O36b) and the reference's estimate over a
recommended order (O30) are the same automaton over the ordered sizes of one group:

    state (s, u, w) = (closed slots, bytes used in the open slot, wasted bytes)
    size b >= 32 : close the open slot if used, then take ceil(b/32) whole slots
                   (waste 32 - b % 32 when b is not a multiple of 32); the next item starts fresh
    size b <  32 : if it does not fit, close the open slot (waste 32 - u); place at offset u;
                   an exactly full slot closes
    end          : an open slot with u > 0 is closed (waste 32 - u)

The open-slot fill u is one of 32 values, so a run of items is a function of u alone. A group is
cut into chunks of ``chunk_size`` consecutive positions; the first chunk of every group starts at
u = 0 and is folded once, later chunks (only groups larger than one chunk) are folded for all 32
starting fills. Summaries are then composed through a tree whose nodes hold at most ``fanout``
children, so no group is ever gathered into one array: every array is bounded by ``chunk_size``
items or ``fanout`` summaries (the top fold holds n / (chunk_size * fanout ** levels) summaries).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotpack.functions import ordered

DEFAULT_CHUNK = 1024
DEFAULT_FANOUT = 1024
DEFAULT_LEVELS = 3  # 1024 items x 1024^3 summaries: ~10^12 items per group with bounded rows


def _state(s: str, u: str, w: str) -> str:
    return f"named_struct('s', cast({s} as bigint), 'u', cast({u} as int), 'w', cast({w} as bigint))"


def step_sql(st: str, b: str) -> str:
    """SQL for one automaton step from state ``st`` with item size ``b``."""
    return (
        f"case when {b} >= 32 then "
        + _state(f"{st}.s + if({st}.u > 0, 1, 0) + ({b} + 31) div 32", "0",
                 f"{st}.w + if({st}.u > 0, 32 - {st}.u, 0) + if({b} % 32 != 0, 32 - {b} % 32, 0)")
        + f" when {st}.u + {b} > 32 then "
        + _state(f"{st}.s + 1", b, f"{st}.w + 32 - {st}.u")
        + f" when {st}.u + {b} = 32 then "
        + _state(f"{st}.s + 1", "0", f"{st}.w")
        + " else " + _state(f"{st}.s", f"{st}.u + {b}", f"{st}.w") + " end"
    )


def place_sql(st: str, b: str) -> str:
    """SQL for the (slot, offset) an item of size ``b`` receives in state ``st``."""
    return (
        f"case when {b} >= 32 then named_struct('slot', {st}.s + if({st}.u > 0, 1, 0), 'offset', 0) "
        f"when {st}.u + {b} > 32 then named_struct('slot', {st}.s + 1, 'offset', 0) "
        f"else named_struct('slot', {st}.s, 'offset', {st}.u) end"
    )


def places(sizes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, offset) of every item of many groups at once; ``bounds`` are the groups' bounds in ``sizes``.

    Step i fills the i-th item of all groups that have one, so a batch costs as many steps as its longest group.
    """
    count = np.diff(bounds)
    longest = np.argsort(-count, kind="stable")
    many = np.searchsorted(-count[longest], -np.arange(count.max(initial=0)), side="left")
    slot, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    s, u = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    for i, n in enumerate(many):
        at = bounds[longest[:n]] + i
        b, closed, fill = sizes[at], s[:n], u[:n]
        whole = b >= 32
        new = whole & (fill > 0) | ~whole & (fill + b > 32)
        slot[at] = closed = closed + new
        offset[at] = fill = np.where(whole | new, 0, fill)
        full = ~whole & (fill + b == 32)
        s[:n] = closed + np.where(whole, (b + 31) // 32, full)
        u[:n] = np.where(whole | full, 0, fill + b)
    return slot, offset


def _fold_sql(items: str, start_u: str) -> str:
    return f"aggregate({items}, {_state('0', start_u, '0')}, (st, x) -> {step_sql('st', 'x.b')})"


def chunk_summaries(df: DataFrame, keys: list[str], pos: str, size: str,
                    chunk_size: int = DEFAULT_CHUNK, keep_items: bool = False,
                    tiebreak: str | None = None) -> DataFrame:
    """Per (keys, chunk): the fold of the chunk's items.

    ``pos`` is a dense 0-based position inside the group (chunk = pos div chunk_size); with
    ``tiebreak`` it may repeat (items ordered by (pos, tiebreak), e.g. slot then declared order).
    Output ``summary``: one state for chunk 0 (start fill 0), 32 states (start fill 0..31) otherwise.
    """
    tb = F.col(tiebreak).cast("bigint") if tiebreak else F.lit(0).cast("bigint")
    grouped = (
        df.select(*keys, F.col(pos).cast("bigint").alias("_pos"), tb.alias("_t"), F.col(size).cast("int").alias("_b"))
        .withColumn("_chunk", F.expr(f"_pos div {chunk_size}"))
        .groupBy(*keys, "_chunk")
        .agg(F.expr("array_sort(collect_list(named_struct('p', _pos, 't', _t, 'b', _b)))").alias("_items"))
    )
    summary = F.expr(
        f"if(_chunk = 0, array({_fold_sql('_items', '0')}), "
        f"transform(sequence(0, 31), u0 -> {_fold_sql('_items', 'u0')}))"
    )
    out = grouped.withColumn("_summary", summary)
    return out if keep_items else out.drop("_items")


def _compose_sql(lst: str, start: str) -> str:
    """Fold summaries ``lst`` (array of struct(c, sm), sorted by c) from state ``start``.

    A summary holds one state (it starts the group, fill 0) or 32 (indexed by the incoming fill).
    """
    pick = "element_at(x.sm, if(size(x.sm) = 1, 1, st.u + 1))"
    return (f"aggregate({lst}, {start}, "
            f"(st, x) -> {_state(f'st.s + {pick}.s', f'{pick}.u', f'st.w + {pick}.w')})")


def _summary_sql(lst: str, first: str) -> str:
    """Summary of a run of summaries: one state for the group's first run, else 32."""
    return (f"if({first}, array({_compose_sql(lst, _state('0', '0', '0'))}), "
            f"transform(sequence(0, 31), u0 -> {_compose_sql(lst, _state('0', 'u0', '0'))}))")


def _levels(chunks: DataFrame, keys: list[str], fanout: int, levels: int) -> list[DataFrame]:
    """Tree of summaries: level 0 = chunks (keys, _i, _summary); level l groups ``fanout`` children.

    Every group holds at most ``fanout`` children, so no row grows with the group size; ``levels``
    fixes the depth (capacity chunk_size * fanout ** levels items per group before the top fold).
    """
    out = [chunks.select(*keys, F.col("_chunk").alias("_i"), "_summary")]
    for _ in range(levels):
        prev = out[-1]
        nxt = (prev.groupBy(*keys, F.expr(f"_i div {fanout}").alias("_i"))
               .agg(F.expr("array_sort(collect_list(named_struct('c', _i, 'sm', _summary)))").alias("_lst"))
               .withColumn("_summary", F.expr(_summary_sql("_lst", "_i = 0")))
               .drop("_lst"))
        out.append(nxt)
    return out


def fold_totals(df: DataFrame, keys: list[str], pos: str, size: str,
                chunk_size: int = DEFAULT_CHUNK, fanout: int = DEFAULT_FANOUT,
                levels: int = DEFAULT_LEVELS, tiebreak: str | None = None) -> DataFrame:
    """O30 fold: per group (slots, wasted) after closing the last open slot.

    Groups within one chunk take their chunk's summary; only groups spanning several chunks go
    through the summary tree.
    """
    chunks = chunk_summaries(df, keys, pos, size, chunk_size, tiebreak=tiebreak)
    multi = chunks.where(F.col("_chunk") > 0).select(*keys).distinct()
    single = (chunks.join(multi, keys, "left_anti")
              .select(*keys, F.expr("element_at(_summary, 1)").alias("_st")))
    top = _levels(chunks.join(multi, keys, "left_semi"), keys, fanout, levels)[-1]
    spanning = (
        top.groupBy(*keys)
        .agg(F.expr("array_sort(collect_list(named_struct('c', _i, 'sm', _summary)))").alias("_lst"))
        .select(*keys, F.expr(_compose_sql("_lst", _state("0", "0", "0"))).alias("_st"))
    )
    per_group = single.unionByName(spanning)
    return per_group.select(
        *keys,
        (F.col("_st.s") + F.when(F.col("_st.u") > 0, 1).otherwise(0)).cast("bigint").alias("slots"),
        (F.col("_st.w") + F.when(F.col("_st.u") > 0, 32 - F.col("_st.u")).otherwise(0)).cast("bigint").alias("wasted"),
    )


def _incoming_sql(lst: str, s0: str, u0: str) -> str:
    """Incoming state (s, u) of every summary in ``lst`` when the run starts at (s0, u0)."""
    pick = "element_at(x.sm, if(size(x.sm) = 1, 1, acc.st.u + 1))"
    return (
        "aggregate(" + lst + ", named_struct('st', " + _state(s0, u0, "0") + ", "
        "'inc', cast(array() as array<struct<c: bigint, s: bigint, u: int>>)), "
        "(acc, x) -> named_struct("
        "'st', " + _state(f"acc.st.s + {pick}.s", f"{pick}.u", f"acc.st.w + {pick}.w") + ", "
        "'inc', concat(acc.inc, array(named_struct('c', x.c, 's', acc.st.s, 'u', acc.st.u))))).inc"
    )


def placed_sql(items: str, s0: str, u0: str) -> str:
    """SQL array of (p, b, slot, offset) of ``items``, an array of structs with p and b in order, from the state (s0, u0)."""
    return (
        f"aggregate({items}, named_struct('st', " + _state(s0, u0, "0") + ", "
        "'out', cast(array() as array<struct<p: bigint, b: int, slot: bigint, offset: int>>)), "
        "(acc, x) -> named_struct('st', " + step_sql("acc.st", "x.b") + ", "
        "'out', concat(acc.out, array(named_struct('p', x.p, 'b', x.b, 'slot', " + place_sql("acc.st", "x.b") + ".slot, "
        "'offset', cast(" + place_sql("acc.st", "x.b") + ".offset as int)))))).out"
    )


def positions(df: DataFrame, keys: list[str], pos: str, size: str,
              chunk_size: int = DEFAULT_CHUNK, fanout: int = DEFAULT_FANOUT,
              levels: int = DEFAULT_LEVELS) -> DataFrame:
    """(slot, offset) of every item under sequential placement; returns keys, pos, slot, offset.

    Groups within their first chunk are placed from one exchange. Others: bottom-up, chunk summaries are
    composed through a tree of bounded fan-out; top-down, each tree node's incoming state is handed to its children
    (a fold over at most ``fanout`` siblings), down to the chunks, whose items are then placed from their incoming state.
    """
    small, large = ordered.split(df, keys, also=F.expr(f"{pos} div {chunk_size} <> 0"))
    first = chunk_summaries(small, keys, pos, size, chunk_size, keep_items=True).where(F.col("_chunk") == 0)
    out = _placed(first.select(*keys, "_items", F.lit(0).cast("bigint").alias("_s0"), F.lit(0).alias("_u0")), keys, pos)
    return out if large is None else out.unionByName(_spanning_positions(large, keys, pos, size, chunk_size, fanout, levels))


def _placed(chunks: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The items of chunks placed from their incoming state."""
    return (chunks.select(*keys, F.explode(F.expr(placed_sql("_items", "_s0", "_u0"))).alias("_o"))
            .select(*keys, F.col("_o.p").alias(pos), F.col("_o.slot").alias("slot"), F.col("_o.offset").alias("offset")))


def _spanning_positions(df: DataFrame, keys: list[str], pos: str, size: str, chunk_size: int, fanout: int, levels: int) -> DataFrame:
    """``positions`` of groups that span chunks."""
    chunks = chunk_summaries(df, keys, pos, size, chunk_size, keep_items=True)
    # chunk 0 always starts from an empty slot; only groups spanning several chunks need the tree
    multi = chunks.where(F.col("_chunk") > 0).select(*keys).distinct()
    tree = _levels(chunks.join(multi, keys, "left_semi").drop("_items"), keys, fanout, levels)
    top = tree[-1]
    inc = (top.groupBy(*keys)
           .agg(F.expr("array_sort(collect_list(named_struct('c', _i, 'sm', _summary)))").alias("_lst"))
           .select(*keys, F.explode(F.expr(_incoming_sql("_lst", "0", "0"))).alias("_in"))
           .select(*keys, F.col("_in.c").alias("_i"), F.col("_in.s").alias("_s0"), F.col("_in.u").alias("_u0")))
    for level in reversed(tree[:-1]):
        kids = (level.withColumn("_p", F.expr(f"_i div {fanout}"))
                .groupBy(*keys, "_p")
                .agg(F.expr("array_sort(collect_list(named_struct('c', _i, 'sm', _summary)))").alias("_lst")))
        inc = (kids.join(inc.withColumnRenamed("_i", "_p"), [*keys, "_p"])
               .select(*keys, F.explode(F.expr(_incoming_sql("_lst", "_s0", "_u0"))).alias("_in"))
               .select(*keys, F.col("_in.c").alias("_i"), F.col("_in.s").alias("_s0"), F.col("_in.u").alias("_u0")))
    first = chunks.where(F.col("_chunk") == 0).withColumn("_s0", F.lit(0).cast("bigint")).withColumn("_u0", F.lit(0))
    later = chunks.where(F.col("_chunk") > 0).join(inc.withColumnRenamed("_i", "_chunk"), [*keys, "_chunk"])
    return _placed(first.unionByName(later.select(*first.columns)), keys, pos)
