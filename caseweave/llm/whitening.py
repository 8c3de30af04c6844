"""Whitening of embeddings by the covariance of their distinct quantised vectors.

Every entry c becomes x = floor(scale * c). Equal x vectors are one row with their number of copies; that number or one
(``weights="copies"`` or ``"distinct"``) is the row's weight in the fit. Tasks multiply their centred, weighted rows
into a columns x columns matrix; the matrices are summed per row of the matrix. Every distinct vector is whitened once
and joined back to the rows that hold it: vectors of more than a thousandth of all rows are at most a thousand and go to
all tasks, all others are joined by a shuffle, so no key of it holds more than a thousandth.

Rows whose vector is null, empty or holds a null, NaN or infinite entry are left out. Entries beyond the range of a long
are held at its ends. Vectors of different lengths are fitted each length by itself. Components without variance (fewer
distinct vectors than entries, constant columns) have no rows, so one distinct vector alone gives none. Null and repeated
ids stay as they are, one set of rows for each row. Columns other than the id and the vector are left out. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.operators.search import vector_sum
from caseweave.session import stage

#: Vectors with more copies than one in so many rows go to all tasks; there can't be more than this number of them.
HOT = 1000
#: Share of the whole variance under which a component counts as one without variance.
LEAST = 1e-12
SCHEMA = "vec_id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # of the kept components, falling
    directions: np.ndarray  # a column each
    whole: float  # the trace


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole."""
    c = F.col(vector).cast("array<double>")
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(v * scale))
    return vectors.where((F.size(c) > 0) & whole).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def matrix(column: pa.ListArray, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def column_sums(distinct: DataFrame, length: int) -> tuple[int, list[int]]:
    """(n, exact sum of every column) over the rows (x, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, w = matrix(batch.column(0), length), batch.column(1).to_numpy()
                most = max(abs(int(x.min())), abs(int(x.max()))) * int(w.max()) * len(w)
                total = w @ x if most < 1 << 62 else w.astype(object) @ x.astype(object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(-1, length), pa.int32()), pa.array([Decimal(int(w.sum())), *[Decimal(int(s)) for s in total]], pa.decimal128(38, 0))],
                    names=["i", "s"],
                )

    parts = distinct.select("x", "weight").mapInArrow(run, "i int, s decimal(38,0)")
    found = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}  # length + 1 rows
    return found[-1], [found[i] for i in range(length)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean: the whole part is taken off in integers, so a large common offset costs no digits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def covariance(distinct: DataFrame, length: int, n: int, sums: list[int]) -> np.ndarray:
    """The weighted covariance (divisor n) of the rows (x, weight), one product per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length))
        for batch in batches:
            c = centred(matrix(batch.column(0), length), n, sums)
            total += (c * batch.column(1).to_numpy()[:, None]).T @ c
        rows = pa.ListArray.from_arrays(pa.array(np.arange(length + 1, dtype=np.int32) * length), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), rows], names=["i", "vector"])

    parts = distinct.select("x", "weight").mapInArrow(run, "i int, vector array<double>")
    found = {r["i"]: r["vector"] for r in parts.groupBy("i").agg(vector_sum("vector").alias("vector")).collect()}  # length rows
    return np.array([found[i] for i in range(length)]) / n


def fit(distinct: DataFrame, length: int, components: int) -> Fit:
    """Mean and leading components; the largest entry of a direction by size is positive."""
    n, sums = column_sums(distinct, length)
    v = covariance(distinct, length, n, sums)
    values, directions = np.linalg.eigh((v + v.T) / 2)
    values, directions = values[::-1], directions[:, ::-1]
    whole = float(np.trace(v))
    kept = [k for k in range(min(components, length)) if values[k] > LEAST * whole]
    directions = directions[:, kept] * np.where(directions[abs(directions).argmax(axis=0), range(length)][kept] < 0, -1.0, 1.0)
    return Fit(n, sums, values[kept], directions, whole)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n * x - S)² per row, exact; null where it has more than 38 digits."""
    most = max(n * int(abs(x).max()) + max(abs(s) for s in sums), 1)
    if most * most * x.shape[1] < 1 << 63:
        t = n * x - np.array(sums, np.int64)
        return pa.array((t * t).sum(axis=1)).cast(pa.decimal128(38, 0))
    t = n * x.astype(object) - np.array(sums, object)
    exact = [int(v) for v in (t * t).sum(axis=1)]
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def whitened(distinct: DataFrame, length: int, model: Fit) -> DataFrame:
    """(x, copies, weight, deviation, y): ``y`` holds the components of every distinct vector, each of variance one."""
    back = model.directions / np.sqrt(model.values)
    n, sums = model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), length)
                y = centred(x, n, sums) @ back
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, deviations(x, n, sums), lists], names=["x", "copies", "weight", "deviation", "y"])

    return distinct.select("x", "copies", "weight").mapInArrow(run, "x array<long>, copies long, weight long, deviation decimal(38,0), y array<double>")


def identity_error(white: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the covariance of ``y`` less the identity."""
    y = [F.col("y")[i] for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    sums = white.agg(*[F.sum(F.col("weight") * v) for v in y], *[F.sum(F.col("weight") * y[i] * y[j]) for i, j in cells]).first()
    means = [s / n for s in sums[:k]]
    return max(abs(s / n - means[i] * means[j] - (i == j)) for (i, j), s in zip(cells, sums[k:], strict=True))


def join_back(rows: DataFrame, white: DataFrame, total: int) -> DataFrame:
    """(vec_id, deviation, y): every row (vec_id, x) with what its vector got."""
    hot = white.where(F.col("copies") > max(1, total // HOT)).select("x", "deviation", "y")
    cold = white.where(F.col("copies") <= max(1, total // HOT)).select("x", "deviation", "y")
    often = rows.join(F.broadcast(hot), "x")
    return often.unionByName(rows.join(cold, "x")).select("vec_id", "deviation", "y")


def whiten(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256, weights: str = "distinct"
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per whole row and component.

    ``n`` is the sum of the weights, ``deviation`` the exact sum of (n * x - S)² over the entries of x with the column
    sums S, ``explained`` the component's share of the variance, ``identity_error`` how far the covariance of the result
    is from the identity.
    """
    if weights not in ("distinct", "copies"):
        raise ValueError(f"weights: {weights}")
    rows = stage(quantised(vectors, vec_id, vector, scale))
    grouped = rows.groupBy("x").agg(F.count("*").alias("copies"))
    distinct = stage(grouped.withColumn("weight", F.lit(1).cast("long") if weights == "distinct" else F.col("copies")))
    lengths = distinct.groupBy(F.size("x").alias("length")).agg(F.sum("copies").alias("total")).collect()
    out = None
    for length, total in sorted(lengths):
        own = distinct.where(F.size("x") == length)
        model = fit(own, length, components)
        k = len(model.values)
        if k == 0:
            continue
        white = stage(whitened(own, length, model))
        error = identity_error(white, k, model.n)
        cells = F.array(*[
            F.struct(F.lit(i + 1).alias("component"), F.col("y")[i].alias("whitened"), F.lit(float(model.values[i] / model.whole)).alias("explained"))
            for i in range(k)
        ])
        back = join_back(rows.where(F.size("x") == length), white, total)
        part = back.select("vec_id", "deviation", F.explode(cells).alias("c")).select(
            "vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA.format(id=rows.schema["vec_id"].dataType.simpleString()))
    return out
