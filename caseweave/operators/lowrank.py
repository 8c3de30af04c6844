"""Truncated singular value decomposition of long weights, with both factors as tables.

A randomised range finder: a random table of terms x (k + spare) numbers is multiplied by AᵀA and made orthonormal again
until the leading values settle. The documents are staged once, a row each, and read by a number of tasks that doesn't
follow them. A task opens the staged table of terms, takes its documents a bounded number of weights at a time and
multiplies both ways; the tasks' results are summed per term, so a round shuffles one table per task and no document. Between
the rounds only a square matrix of k + spare columns comes to the driver: the rows are made orthonormal by the inverse
root of their Gram matrix, twice, so no factor is ever collected. At the end the values and the turn of both factors come
from the Gram matrix of A times the table, so the columns of U·S are orthogonal to machine precision.

The table of terms is kept as rows (block, data): ``BLOCK`` terms each, their numbers as bytes. It goes to every task, terms x (k + spare) x 8 bytes each: bound the vocabulary, as its callers do.
The tasks open it by Arrow's file systems, so the shared folder must be one that Arrow can open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators.search import vector_sum
from caseweave.session import release, stage

#: Weights that a task holds at once, weights that are multiplied at once (their rows of the table fit a core's cache), and terms of a block of the table.
HELD, CHUNK, BLOCK = 1 << 20, 1 << 11, 256

#: Tasks that a table of terms is sent to, at most.
TASKS = 16


def lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def dense(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def document_rows(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """Staged (doc_id, index, w): a document per row, with term numbers from 0."""
    entries = F.array_sort(F.collect_list(F.struct((F.col("index") - 1).cast("int").alias("index"), F.col("w").cast("double").alias("w"))))
    return stage(weights.where("w <> 0").join(terms, "term").groupBy("doc_id").agg(entries.alias("e")).selectExpr("doc_id", "e.index AS index", "e.w AS w"))


def times(index: np.ndarray, w: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A @ table for rows that start at ``starts`` (none is empty)."""
    out = np.empty((len(starts), table.shape[1]))
    ends = np.append(starts[1:], len(index))
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        a, b = starts[at], ends[upto - 1]
        out[at:upto] = np.add.reduceat(table[index[a:b]] * w[a:b, None], starts[at:upto] - a, axis=0)
        at = upto
    return out


def matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, width)


def read_blocks(files: list[str], width: int) -> np.ndarray:
    """The whole table of a staged frame (block, data)."""
    parts = []
    for name in files:
        system, path = fs.FileSystem.from_uri(name)
        with system.open_input_file(path) as source:
            parts.append(pq.read_table(source, columns=["block", "data"]))
    return np.concatenate([matrix(d.as_buffer(), width) for d in pa.concat_tables(parts).sort_by("block")["data"]])


def held_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most HELD weights (a longer document alone)."""
    ends = np.cumsum(batch.column(2).value_lengths().to_numpy())
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD, "right")))
        yield batch.slice(start, end - start)
        start = end


def meet(rows: DataFrame, table: DataFrame, width: int, turn: np.ndarray | None, back: bool) -> DataFrame:
    """Y = A·(table·turn) as (doc_id, vector), or Aᵀ·Y as (block, data) with ``back``; ``table`` is staged."""
    kind, files = rows.schema["doc_id"].dataType.simpleString(), table.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = z = None
        for part in (part for batch in batches if batch.num_rows for part in held_rows(batch)):
            if m is None:
                m = read_blocks(files, width)
                m = m if turn is None else m @ turn
                z, met = (np.zeros_like(m), np.zeros(len(m), dtype=bool)) if back else (None, None)
            lengths = part.column(2).value_lengths().to_numpy()
            index, w = (part.column(c).flatten().to_numpy() for c in (1, 2))
            y = times(index, w, np.cumsum(lengths) - lengths, m)
            if not back:
                yield pa.RecordBatch.from_arrays([part.column(0), lists(y)], names=["doc_id", "vector"])
                continue
            order = np.argsort(index, kind="stable")
            doc = np.repeat(np.arange(len(lengths)), lengths)[order]
            found, first = np.unique(index[order], return_index=True)
            z[found] += times(doc, w[order], first, y)
            met[found] = True
        if back and m is not None:
            for b in np.unique(np.flatnonzero(met) // BLOCK).tolist():
                data = z[b * BLOCK : (b + 1) * BLOCK].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])

    met = rows.coalesce(TASKS).mapInArrow(run, "block int, data binary" if back else f"doc_id {kind}, vector array<double>")
    return block_sums(met) if back else met


def block_sums(parts: DataFrame) -> DataFrame:
    """The sum of all rows of each block; a task adds them up one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = total = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "data"])

        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(data.as_buffer())
                if b == block:
                    total += values
                else:
                    if total is not None:
                        yield row()
                    block, total = b, values.copy()
        if total is not None:
            yield row()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, data binary")


def gram(table: DataFrame, width: int, turn: np.ndarray | None = None) -> np.ndarray:
    """XᵀX of the rows of a table of blocks or of vectors, times ``turn`` if there is one."""
    column = "data" if "data" in table.columns else "vector"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(b"".join(batch.column(0).to_pylist()), width) if column == "data" else dense(batch.column(0))
                x = x if turn is None else x @ turn
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), lists(total)], names=["i", "vector"])

    parts = table.select(column).mapInArrow(run, "i int, vector array<double>")
    found = {r["i"]: r["vector"] for r in parts.groupBy("i").agg(vector_sum("vector").alias("vector")).collect()}  # k + spare rows
    return np.array([found[i] for i in range(len(found))])


def inverse_root(g: np.ndarray, least: float = 1e-13) -> np.ndarray:
    """T with TᵀGT = 1; directions without weight are dropped."""
    values, directions = np.linalg.eigh((g + g.T) / 2)
    kept = values > least * max(values[-1], 1e-300)
    return directions[:, kept] / np.sqrt(values[kept])


def orthonormal(table: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(turn, leading values): the table times ``turn`` has orthonormal columns."""
    g = gram(table, width)
    turn = inverse_root(g)
    return turn @ inverse_root(gram(table, width, turn)), np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0))


def turned(table: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(dense(batch.column(1)) @ turn)], names=[key, "vector"])

    return table.select(key, "vector").mapInArrow(run, f"{key} {kind}, vector array<double>")


def rows_of_blocks(table: DataFrame, width: int, turn: np.ndarray) -> DataFrame:
    """(index, vector) of a table of blocks, times ``turn``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = matrix(data, width) @ turn
                yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + np.arange(len(x)), pa.int32()), lists(x)], names=["index", "vector"])

    return table.mapInArrow(run, "index int, vector array<double>")


def random_table(spark: SparkSession, n_terms: int, width: int, seed: int) -> DataFrame:
    """(block, data): normal numbers that follow from the seed and the block's number alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                data = np.random.default_rng([seed, block]).standard_normal((min(BLOCK, n_terms - block * BLOCK), width)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])

    return spark.range(-(-n_terms // BLOCK)).mapInArrow(run, "block int, data binary")


def truncated_svd(
    weights: DataFrame, terms: DataFrame, k: int, spare: int = 20, seed: int = 11, settled: float = 0.01, max_rounds: int = 5
) -> tuple[list[float], DataFrame, DataFrame]:
    """(sigma, (term, vector) of V, (doc_id, vector) of U·S) for weights (doc_id, term, w) and numbered terms (term, index).

    Rounds end when no value of the first k, squared as a round gives them, changes by more than the share
    ``settled``, or after ``max_rounds``. The largest entry of each column of V is positive. There are at most as many columns as the weights have rank.
    """
    n_terms = terms.count()
    if n_terms == 0:
        raise ValueError("no terms")
    rows = document_rows(weights, terms)
    width = min(k + spare, n_terms)
    table, turn, before = stage(random_table(weights.sparkSession, n_terms, width, seed)), None, None
    for _ in range(max_rounds):
        following = stage(meet(rows, table, width, turn, back=True))
        release(table)
        width = width if turn is None else turn.shape[1]
        table = following
        turn, values = orthonormal(table, width)
        leading = values[: min(k, turn.shape[1])]
        if before is not None and len(before) == len(leading) and (abs(leading - before) <= settled * leading).all():
            break
        before = leading
    y = stage(meet(rows, table, width, turn, back=False))
    values, directions = np.linalg.eigh(gram(y, turn.shape[1]))
    kept = min(k, len(values))
    sigma, directions = np.sqrt(np.maximum(values[::-1][:kept], 0)), directions[:, ::-1][:, :kept]
    v = stage(rows_of_blocks(table, width, turn @ directions))
    cells = v.select("index", F.posexplode("vector").alias("concept", "x"))
    largest = cells.groupBy("concept").agg(F.max_by("x", F.struct(F.abs("x"), -F.col("index"))).alias("x")).collect()  # k rows
    signs = np.ones(kept)
    for r in largest:
        signs[r["concept"]] = -1.0 if r["x"] < 0 else 1.0
    named = terms.select("term", (F.col("index") - 1).cast("int").alias("index"))
    return [float(s) for s in sigma], named.join(turned(v, "index", np.diag(signs)), "index").select("term", "vector"), turned(y, "doc_id", directions * signs)
