"""Embedding whitening: projections on the leading components, scaled to unit variance.

Vectors are quantised to whole numbers x = floor(256 c). Count and sums of the distinct x are exact; the
covariance is summed over the partitions from centred values (n x - S) / n, whose numerator is a whole
number. Its leading eigenvalues come from spectrum slicing (``spectrum.py``) of the one small matrix;
rows are then projected where they lie.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are dropped, and so are
rows whose length is not the most frequent one (of equally frequent ones the longest); a table without
rows, or with vectors of length 0 only, gives no rows; entries beyond 64 bits after scaling count as the
nearest 64-bit number; ``deviation`` beyond 64 bits is null; repeated rows and repeated or null ids stay
rows of their own, and the fit list has each distinct x once; vectors of fewer than ``components`` entries
have as many components as entries; a component without variance has ``whitened`` 0, and the identity
error is over the others (null if there are none). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotpack.llm import spectrum
from slotpack.llm.common import store

SCALE = 256
COMPONENTS = 4
#: Rows handled at once inside a task.
PIECE = 2048
_TOP, _LOW = 2.0 ** 63, -(2.0 ** 63)
_ARROW = {"int": pa.int32(), "decimal(38)": pa.decimal128(38, 0), "binary": pa.binary()}


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value) as 64-bit whole numbers, held inside their range."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(SCALE))
    out = np.where(scaled >= _TOP, 0.0, np.maximum(scaled, _LOW)).astype(np.int64)
    out[scaled >= _TOP] = np.iinfo(np.int64).max
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: the width of its entries, then the entries in the fewest bytes that hold them all."""
    out: list[bytes] = []
    low, high = x.min(1), x.max(1)
    widths = np.full(len(x), 8)
    for w in (4, 2, 1):
        widths[(low >= -(1 << (8 * w - 1))) & (high < (1 << (8 * w - 1)))] = w
    for row, w in zip(x, widths.tolist(), strict=True):
        out.append(bytes([w]) + row.astype(f"<i{w}").tobytes())
    return out


def unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    """The rows of ``packed`` as 64-bit whole numbers."""
    out = np.empty((len(column), dimension), np.int64)
    for i, cell in enumerate(column):
        raw = cell.as_py()
        out[i] = np.frombuffer(raw, f"<i{raw[0]}", offset=1)
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit where that cannot overflow, else Python numbers."""
    if len(x) and n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, sums)) < 2 ** 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows whose vector is all finite numbers, v as doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & ~bad)


def quantised_rows(rows: DataFrame, dimension: int) -> DataFrame:
    """Stored (vec_id, x) of the rows of this length; x is ``packed``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                values = piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("vec_id"), pa.array(packed(quantised(values)), pa.binary())], names=["vec_id", "x"])

    schema = T.StructType([rows.schema["vec_id"], T.StructField("x", T.BinaryType())])
    return store(rows.where(F.size("v") == dimension).mapInArrow(run, schema), "vectors")


def _per_partition(fit: DataFrame, dimension: int, add: Callable, zero: Callable, emit: Callable, schema: str) -> DataFrame:
    """``emit`` of what ``add`` gathered of a partition's x rows, starting from ``zero``; rows are (i, ...)."""
    names, kinds = zip(*[(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = zero(), False
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                state, some = add(state, unpacked(batch.column("x").slice(at, PIECE), dimension)), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(emit(state), kinds, strict=True)], names=names)

    return fit.select("x").mapInArrow(run, schema)


def sums_of(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension."""
    def add(state, x):
        wide = len(x) * int(max(abs(int(x.min())), abs(int(x.max())))) >= 2 ** 63
        own = x.astype(object).sum(0) if wide else x.sum(0)
        return state[0] + len(x), [a + int(b) for a, b in zip(state[1], own, strict=True)]

    def emit(state):
        return [range(-1, dimension), [Decimal(v) for v in (state[0], *state[1])]]

    parts = _per_partition(fit, dimension, add, lambda: (0, [0] * dimension), emit, "i int, s decimal(38)")
    rows = {r.i: int(r.s) for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return rows.get(-1, 0), [rows.get(i, 0) for i in range(dimension)]


def _moments(fit: DataFrame, dimension: int, size: int, values: Callable) -> np.ndarray:
    """Sum over all rows of values(x)' values(x), a matrix of ``size`` rows, added up row by row in Spark."""
    def add(state, x):
        d = values(x)
        return state + d.T @ d

    def emit(state):
        return [range(size), [row.tobytes() for row in state]]

    def total(rows: pa.Table) -> pa.Table:
        whole = np.zeros(size)
        for cell in rows.sort_by("row")["row"]:
            whole += np.frombuffer(cell.as_py())
        return pa.table({"i": rows["i"][:1], "row": pa.array([whole.tobytes()], pa.binary())})

    parts = _per_partition(fit, dimension, add, lambda: np.zeros((size, size)), emit, "i int, row binary")
    out = np.zeros((size, size))
    for r in parts.groupBy("i").applyInArrow(total, "i int, row binary").collect():
        out[r.i] = np.frombuffer(bytes(r.row))
    return (out + out.T) / 2


def components_of(fit: DataFrame, dimension: int, n: int, sums: list[int], many: int
                  ) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, projection columns scaled to unit variance, trace) of the covariance of the fit list."""
    covariance = _moments(fit, dimension, dimension, lambda x: (centred(x, n, sums) / n).astype(float)) / n
    values, vectors = spectrum.leading(covariance, many)
    trace = float(np.trace(covariance))
    values[values <= 8 * dimension * spectrum.ROUNDING * trace] = 0.0
    scale = np.zeros(len(values))
    scale[values > 0] = values[values > 0] ** -0.5
    return values, vectors * scale, trace


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row."""
    spark, rows = embeddings.sparkSession, usable(embeddings)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType),
                           *[T.StructField(c, k) for c, k in zip(names[1:], kinds, strict=True)]])
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    usual = lengths.agg(F.max(F.struct("k", "d")).alias("m")).first().m
    if usual is None or usual.d == 0:
        return spark.createDataFrame([], schema)
    dimension = usual.d
    vectors = quantised_rows(rows, dimension)
    fit = store(vectors.select("x").distinct(), "fit")
    n, sums = sums_of(fit, dimension)
    values, weights, trace = components_of(fit, dimension, n, sums, components)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    used = np.flatnonzero(values > 0)
    error = None
    if len(used):
        got = _moments(fit, dimension, len(used), lambda x: (centred(x, n, sums) / n).astype(float) @ weights[:, used]) / n
        error = float(np.abs(got - np.eye(len(used))).max())
    many = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                d = centred(unpacked(piece.column("x"), dimension), n, sums)
                white = ((d / n).astype(float) @ weights).ravel()
                squares = (d.astype(object) ** 2).sum(1)
                deviation = [int(s) if s < 2 ** 63 else None for s in squares]
                take = np.repeat(np.arange(len(piece)), many)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("vec_id").take(pa.array(take)),
                     pa.array(np.tile(np.arange(1, many + 1), len(piece)), pa.int32()),
                     pa.array(np.full(len(take), n), pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(take)),
                     pa.array(white), pa.array(np.tile(explained, len(piece))),
                     pa.array([error] * len(take), pa.float64())], names=names)

    return vectors.mapInArrow(run, schema)
