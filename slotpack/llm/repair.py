"""Conversation structure repair: faults of damaged conversations and their cheapest edits.

Rows are damaged by a hash of conversation and turn, then each conversation is read by turn: blank,
duplicate and truncated rows, gaps and illegal role neighbours are counted, and iterative-deepening A*
(``astar.py``) finds the cheapest edits to a legal order of roles, of ties the least in ASCII order.

Conversations of at most CHUNK rows are solved whole, after one shuffle by conversation. Longer ones are
put in order by a range exchange and cut into chunks of CHUNK rows, each searched between all pairs of the
four automaton states; a fold over the chunks picks the states at the cuts, last chunk first, and within
equal cost the chunk's ASCII-least edits (no edit string of a chunk is a prefix of another, so the choices
agree with the whole). Repaired text is rendered chunk by chunk; only the digest, which SHA-256 defines as
one sequence, and the audit, which is one cell, pass through one task per conversation, in pieces.

Defined results: a null role or text is one space, and a null conversation or turn one space in the hash;
a null conv_id is one conversation; rows are ordered by turn (null first), then by a digest of role and
text; rows repeated in full are rows of their own (the later ones duplicates); conversations without rows
after the damage have zeros, an empty audit and the digest of the empty text; texts may be of any length;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotpack.functions.ordered import sequence
from slotpack.llm import astar
from slotpack.llm.common import MOST_BROADCAST_IDS, lookup, store

CHUNK = 64
WHITE = " \t\n\x0b\x0c\r"
#: Rows of a batch that are turned into Python values at once.
PIECE = 256
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(["ckey string", *[f"{c} bigint" for c in COUNTS], "audit string", "repaired_sha256 string"])


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _code() -> Column:
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    return F.crc32(key.cast("binary")) % 20


def _rows_left() -> Column:
    return F.when(_code() == 0, 0).when(_code() == 3, 2).otherwise(1)


def damaged(conversations: DataFrame) -> DataFrame:
    """(ckey, turn, tie, copy, role, text, initial, last): the rows after the damage.

    ``last`` is the last character that is no white space, empty in a blank text.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    d = conversations.select(_key().alias("ckey"), F.col("turn").cast("bigint").alias("turn"), _code().alias("code"),
                             role.alias("role"), text.alias("text"),
                             F.sha2(F.concat_ws("\x1f", role, text), 256).alias("tie"))
    d = d.where("code <> 0").withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1)))
                                                          .otherwise(F.array(F.lit(0)))))
    d = (d.withColumn("role", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")))
         .withColumn("text", F.when(F.col("code") == 1, F.lit(""))
                     .when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))))
    return d.select("ckey", "turn", "tie", "copy", "role", "text", F.substring("role", 1, 1).alias("initial"),
                    F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1)).alias("last"))


def _faults(rows: list[tuple[str, str, bool]]) -> tuple[list[bool], list[bool], list[int]]:
    """(must go, truncated) of each (initial, last, seen) row, and the counts of COUNTS from blank to illegal."""
    blank = [last == "" for _, last, _ in rows]
    seen = [not b and s for b, (_, _, s) in zip(blank, rows, strict=True)]
    doomed = [b or s for b, s in zip(blank, seen, strict=True)]
    cut = [not d and last not in ".!?" for d, (_, last, _) in zip(doomed, rows, strict=True)]
    illegal = sum(a[0] + b[0] not in astar.LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return doomed, cut, [sum(blank), sum(seen), sum(cut), illegal]


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def rendered(rows: list[tuple[str, str]], edits: str, state: int) -> list[str]:
    """``role:text`` of the repaired (role, text) rows, read from ``state`` on."""
    out, left = [], iter(rows)
    for e in edits:
        role, text = ("", "") if e == "I" else next(left)
        if e == "D":
            continue
        if e == "K":
            state = astar.FOLLOWS[state][role[:1]]
        else:
            state, role = astar.MADE[state]
        out.append(f"{role}:{text}")
    return out


def solved(rows: list[tuple[int | None, str, str, str, str]]) -> list:
    """The values of RESULT after ckey for the whole ordered (turn, role, text, initial, last) of a conversation."""
    met: set[tuple[str, str]] = set()
    facts = []
    for _, role, text, initial, last in rows:
        facts.append((initial, last, (role, text) in met))
        met.add((role, text))
    doomed, cut, counts = _faults(facts)
    cost, audit = astar.cheapest([f[0] for f in facts], doomed, cut)
    turns = [r[0] for r in rows if r[0] is not None]
    lines = rendered([(r[1], r[2]) for r in rows], audit, astar.START)
    digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return [_gaps(min(turns, default=None), max(turns, default=None), len(set(turns))), *counts, cost, audit, digest]


def _batch(names: list[str], kinds: list[pa.DataType], rows: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_RESULT_NAMES = ["ckey", *COUNTS, "audit", "repaired_sha256"]
_RESULT_KINDS = [pa.string(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            part = batch.slice(at, PIECE)
            yield from zip(*[part.column(c).to_pylist() for c in names], strict=True)


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and order; one result row per conversation."""
    out, own, key = [], [], None
    for ckey, *row in _rows(batches, ["ckey", "turn", "role", "text", "initial", "last"]):
        if ckey != key:
            if own:
                out.append([key, *solved(own)])
            own, key = [], ckey
            if len(out) >= PIECE:
                yield _batch(_RESULT_NAMES, _RESULT_KINDS, out)
                out = []
        own.append(tuple(row))
    if own:
        out.append([key, *solved(own)])
    if out:
        yield _batch(_RESULT_NAMES, _RESULT_KINDS, out)


# --- conversations of more than CHUNK rows ------------------------------------------------------------
_SUMMARY = ("ckey string, chunk bigint, low bigint, high bigint, distinct bigint, opening string, ending string, "
            "blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
            "paths array<struct<start: int, goal: int, cost: bigint, edits: string>>")
_FOLDED = "ckey string, chunk bigint, state int, edits string, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One chunk a row, each with the cheapest edits between all pairs of states (to the end as goal -1)."""
    names = [f.split()[0] for f in _SUMMARY.split(", ")[:12]]
    path = pa.struct([("start", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(path)]
    for ckey, chunk, rows in _rows(batches, ["ckey", "chunk", "rows"]):
        facts = [(r["initial"], r["last"], r["seen"]) for r in rows]
        doomed, cut, counts = _faults(facts)
        initials = [f[0] for f in facts]
        paths = []
        for start in range(4):
            for goal in (*range(4), None):
                found = astar.cheapest(initials, doomed, cut, start, goal)
                if found is not None:
                    paths.append({"start": start, "goal": -1 if goal is None else goal, "cost": found[0], "edits": found[1]})
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        yield _batch(names, kinds, [[ckey, chunk, min(turns, default=None), max(turns, default=None), len(set(turns)),
                                     initials[0], initials[-1], *counts, paths]])


def _fold(table: pa.Table) -> pa.Table:
    """The chunks of one conversation: state and edits of each, counts of the whole conversation on the first."""
    rows = table.sort_by("chunk").to_pylist()
    rest: list[dict[int, tuple[int, int, int]]] = []  # last chunk first: state -> (cost to the end, edits' place, goal)
    after: dict[int, tuple[int, int, int]] | None = None
    for row in reversed(rows):
        best: dict[int, tuple[int, int, int]] = {}
        for at, p in enumerate(row["paths"]):
            if (after is None) != (p["goal"] == -1) or (after is not None and p["goal"] not in after):
                continue
            cost = p["cost"] + (after[p["goal"]][0] if after is not None else 0)
            old = best.get(p["start"])
            if old is None or (cost, p["edits"]) < (old[0], row["paths"][old[1]]["edits"]):
                best[p["start"]] = (cost, at, p["goal"])
        rest.append(best)
        after = best
    rest.reverse()
    low = high = last_turn = None
    distinct, state, out = 0, astar.START, []
    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for k, row in enumerate(rows):
        for c in sums:
            sums[c] += row[c]
        if k and rows[k - 1]["ending"] + row["opening"] not in astar.LEGAL:
            sums["illegal"] += 1
        if row["low"] is not None:
            distinct += row["distinct"] - (row["low"] == last_turn)
            low, high, last_turn = (row["low"] if low is None else low), row["high"], row["high"]
        _, at, goal = rest[k][state]
        out.append([row["ckey"], row["chunk"], state, row["paths"][at]["edits"], *[None] * len(COUNTS)])
        state = goal
    out[0][4:] = [_gaps(low, high, distinct), *sums.values(), rest[0][astar.START][0]]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * len(COUNTS)]
    return pa.Table.from_batches([_batch([f.split()[0] for f in _FOLDED.split(", ")], kinds, out)])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired text of each chunk; null where no row is left."""
    names = ["ckey", "chunk", "edits", *COUNTS]
    kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * len(COUNTS), pa.string()]
    for *own, state, rows in _rows(batches, [*names, "state", "rows"]):
        lines = rendered([(r["role"], r["text"]) for r in rows], own[2], state)
        yield _batch([*names, "piece"], kinds, [[*own, "\n".join(lines) if lines else None]])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by conversation and order; one result row per conversation."""
    key, counts, audit, digest, some = None, [], [], None, False
    for ckey, *own, edits, piece in _rows(batches, ["ckey", *COUNTS, "edits", "piece"]):
        if ckey != key:
            if digest is not None:
                yield _batch(_RESULT_NAMES, _RESULT_KINDS, [[key, *counts, "".join(audit), digest.hexdigest()]])
            key, counts, audit, digest, some = ckey, own, [], hashlib.sha256(), False
        audit.append(edits)
        if piece is not None:
            digest.update((("\n" if some else "") + piece).encode("utf-8", "surrogatepass"))
            some = True
    if digest is not None:
        yield _batch(_RESULT_NAMES, _RESULT_KINDS, [[key, *counts, "".join(audit), digest.hexdigest()]])


def _solve_long(rows: DataFrame) -> DataFrame:
    """RESULT of conversations of any length."""
    order = ["ckey", F.col("turn").asc_nulls_first(), "tie", "copy", "salt"]
    placed = store(sequence(rows.withColumn("salt", F.rand(17)), order, "position", "turns")
                   .withColumn("chunk", F.expr(f"position div {CHUNK}")).drop("salt", "tie", "copy"), "turns")
    small = store(placed.select("ckey", "chunk", "position", "turn", "initial", "last",
                                F.sha2(F.concat_ws("\x1f", "role", "text"), 256).alias("digest")), "facts")
    again = store(small.groupBy("ckey", "digest").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1"), "again")
    met = lookup(small, again, ["ckey", "digest"], "left", size="n")
    seen = F.coalesce(F.col("position") > F.col("first"), F.lit(False)).alias("seen")
    fact = F.struct("position", "turn", "initial", "last", seen)
    chunks = met.groupBy("ckey", "chunk").agg(F.sort_array(F.collect_list(fact)).alias("rows"))
    summaries = store(chunks.mapInArrow(_summaries, _SUMMARY), "summaries")
    folded = store(summaries.groupBy("ckey").applyInArrow(_fold, _FOLDED), "folded")
    texts = placed.groupBy("ckey", "chunk").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("rows"))
    pieces = texts.join(folded, ["ckey", "chunk"]).mapInArrow(
        _render, "ckey string, chunk bigint, edits string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", piece string")
    return pieces.repartition("ckey").sortWithinPartitions("ckey", "chunk").mapInArrow(_join_pieces, RESULT)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: the counts of COUNTS, ``audit`` and ``repaired_sha256``."""
    sizes = store(conversations.groupBy("conv_id", _key().alias("ckey")).agg(F.sum(_rows_left()).alias("n")), "sizes")
    long = store(sizes.where(F.col("n") > CHUNK).select("ckey"), "long")
    many, rows = long.count(), damaged(conversations)
    side = F.broadcast(long) if many <= MOST_BROADCAST_IDS else long
    short = rows.join(side, "ckey", "left_anti").repartition("ckey").sortWithinPartitions(
        "ckey", F.col("turn").asc_nulls_first(), "tie", "copy")
    results = short.mapInArrow(_solve_whole, RESULT)
    if many:
        results = results.unionByName(_solve_long(rows.join(side, "ckey", "left_semi")))
    empty = hashlib.sha256(b"").hexdigest()
    return sizes.join(results, "ckey", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
