"""Order-dependent helpers that never route a whole group to one task.

A group (one contract) is cut into chunks by a caller-supplied chunk column that grows with the
order (e.g. ``ordinal div 1024``). Row-level windows run per (group, chunk), bounded by the chunk;
the group-level step works on one summary row per chunk. A contract holding a third of all rows is
thus spread over ``n / chunk`` tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotpack.session import materialize

DEFAULT_CHUNK = 1024
#: Rows of a group that one window may hold; larger groups are put in order by a range exchange.
MOST_ROWS = 4096
#: Keys of large groups that one broadcast may hold.
MOST_BROADCAST_KEYS = 1_000_000


def chunk_of(col: str | Column, size: int = DEFAULT_CHUNK) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(size)).cast("bigint")


def _spanning(d: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with rows beyond chunk 0 (the only groups whose chunks need stitching)."""
    return d.where(F.col("_ck") > 0).select(*keys).distinct()


def dense_position(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                   out: str = "position") -> DataFrame:
    """0-based position of each row inside ``keys`` ordered by ``order``.

    ``chunk`` must be non-negative and non-decreasing in ``order``. Row numbers are taken per
    (keys, chunk); rows of later chunks are shifted by the rows of the earlier chunks of the same
    group (an exclusive running sum over per-chunk counts of the groups that span chunks).
    """
    d = df.withColumn("_ck", chunk)
    rn = F.row_number().over(Window.partitionBy(*keys, "_ck").orderBy(*order)) - 1
    d = d.withColumn("_rn", rn)
    first = d.where(F.col("_ck") == 0).withColumn(out, F.col("_rn").cast("bigint"))
    spanning = _spanning(d, keys)
    counts = (d.join(spanning, keys, "left_semi")
              .groupBy(*keys, "_ck").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*keys).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_ck", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    later = (d.where(F.col("_ck") > 0).join(offsets, [*keys, "_ck"])
             .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint")).drop("_off"))
    return first.unionByName(later).drop("_ck", "_rn")


def neighbours(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
               cols: list[str]) -> DataFrame:
    """Attach ``prev_<c>`` / ``next_<c>`` (the adjacent rows in ``order`` within ``keys``).

    ``chunk`` must be non-decreasing in ``order``. Adjacent rows inside a chunk come from lag/lead over
    the chunk. Only groups that span several chunks need more: their first and last rows, one row per
    chunk, meet in a window that gives every chunk the last row before and the first row after it, which
    joins the chunk's rows under the partitioning they already have.
    """
    d = df.withColumn("_ck", chunk)
    w = Window.partitionBy(*keys, "_ck").orderBy(*order)
    row = F.struct(*[F.col(c) for c in cols])
    placed = F.struct(*[F.col(c) for c in order], row.alias("_row"))
    ends = (d.join(_spanning(d, keys), keys, "left_semi").groupBy(*keys, "_ck")
            .agg(F.min(placed).alias("_first"), F.max(placed).alias("_last")))
    cw = Window.partitionBy(*keys).orderBy("_ck")
    beside = ends.select(*keys, "_ck", F.lag("_last._row").over(cw).alias("_before"), F.lead("_first._row").over(cw).alias("_after"))
    out = (d.withColumn("_row", row).withColumn("_prev", F.lag("_row").over(w)).withColumn("_next", F.lead("_row").over(w))
           .join(beside, [*keys, "_ck"], "left")
           .withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after")))
    for c in cols:
        out = out.withColumn(f"prev_{c}", F.col(f"_prev.{c}")).withColumn(f"next_{c}", F.col(f"_next.{c}"))
    return out.drop("_ck", "_row", "_prev", "_next", "_before", "_after")


def sequence(df: DataFrame, order: list[str | Column], out: str = "position", name: str = "sequence") -> DataFrame:
    """Stored ``df`` with ``out``, its 0-based dense position in the whole table ordered by ``order``.

    One range exchange deals the rows to tasks by ``order`` alone, so no group of rows, however large, is
    one task's; a row's position is its place in its own sorted partition plus the rows of the partitions
    before it (one count per partition is broadcast). Rows that tie in ``order`` go to one task: add a
    column that tells them apart where many can tie. With a total order the positions do not depend on
    the number of partitions. The range bounds come from a sample of ``order``: keep it to short values.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed, name)
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.col("_id") - F.shiftleft("_part", 33)
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(out, (F.col("_off") + inside).cast("bigint")).drop("_id", "_part", "_off"))


def split(df: DataFrame, keys: list[str], most: int | None = None,
          also: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups of at most ``most`` rows, and those of the larger groups (None without any).

    Groups with a row for which ``also`` holds go with the larger ones.
    """
    most = MOST_ROWS if most is None else most
    odd = F.count_if(also if also is not None else F.lit(False))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), odd.alias("_odd")).where((F.col("_n") > most) | (F.col("_odd") > 0))
    large = materialize(counts.select(*keys), "large")
    many = large.count()
    if not many:
        return df, None
    side = F.broadcast(large) if many <= MOST_BROADCAST_KEYS else large
    return df.join(side, keys, "left_anti"), df.join(side, keys, "left_semi")


def group_position(df: DataFrame, keys: list[str], order: list[str], out: str = "position") -> DataFrame:
    """0-based position of each row inside ``keys`` ordered by ``order``, whatever the values of ``order`` repeat.

    Groups of at most MOST_ROWS rows are numbered by a window; larger ones by their place in the whole
    sorted table less that of their first row, so a group of any size, tied or not, spreads over tasks
    as long as ``order`` tells its rows apart.
    """
    small, large = split(df, keys)
    window = Window.partitionBy(*keys).orderBy(*order)
    placed = small.withColumn(out, (F.row_number().over(window) - 1).cast("bigint"))
    if large is None:
        return placed
    whole = materialize(sequence(large, [*keys, *order], "_p"), "placed")
    first = whole.groupBy(*keys).agg(F.min("_p").alias("_first"))
    return placed.unionByName(whole.join(first, keys).withColumn(out, F.col("_p") - F.col("_first")).drop("_p", "_first"))


def group_neighbours(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """``prev_<c>`` / ``next_<c>`` of the adjacent rows within ``keys``, whatever the values of ``order`` repeat.

    In groups of over MOST_ROWS rows a row meets the ones beside it by its place in the whole sorted table.
    """
    small, large = split(df, keys)
    window, row = Window.partitionBy(*keys).orderBy(*order), F.struct(*cols)
    out = small.withColumn("_prev", F.lag(row).over(window)).withColumn("_next", F.lead(row).over(window))
    if large is not None:
        whole = materialize(sequence(large, [*keys, *order], "_p"), "placed")
        beside = [whole.select(*keys, (F.col("_p") + by).alias("_p"), row.alias(name)) for by, name in ((1, "_prev"), (-1, "_next"))]
        met = whole.join(beside[0], [*keys, "_p"], "left").join(beside[1], [*keys, "_p"], "left").drop("_p")
        out = out.unionByName(met.select(*out.columns))
    for c in cols:
        out = out.withColumn(f"prev_{c}", F.col(f"_prev.{c}")).withColumn(f"next_{c}", F.col(f"_next.{c}"))
    return out.drop("_prev", "_next")
