"""Ward's merge tree over many vectors: bounded cluster features per task, merged in rounds, then a nearest-neighbour chain.

A cluster feature is the count, mean and inner sum of squares of some vectors. Every task keeps at most ``limit`` of them:
a vector joins the nearest feature within the present reach or opens one, and when there are too many the reach is
widened and the features are put together again. Features of tasks meet in groups of FAN_IN, round after round, until
one table of at most ``limit`` rows is left, whatever the number of rows. With no more different vectors than ``limit``
the reach stays zero, equal vectors are one leaf, and the tree is Ward's tree of all rows.

A merge of two clusters adds half its squared ``height`` to the inner sum of squares, so the heights and the leaves' own
sums make up the whole sum of squares for any number of tasks. Which vectors share a leaf may depend on the dealing of
rows once there are more different ones than ``limit``. Rows whose vector is null or holds null or non-finite
entries are left out; vectors must have one length. An empty table gives empty results. Ties go to the lower number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.session import release, stage

FAN_IN = 16
FEATURE = "task long, n long, mean array<double>, sse double"
LEAF = "leaf long, n long, mean array<double>, sse double"
MERGE = "step long, a long, b long, height double, size long"


class Features:
    """At most ``limit`` cluster features."""

    def __init__(self, limit: int):
        self.limit, self.reach, self.size = max(1, limit), 0.0, 0
        self.n = self.mean = self.sse = None

    def add(self, n: int, mean: np.ndarray, sse: float) -> None:
        if self.n is None:
            self.n, self.sse = np.zeros(self.limit + 1), np.zeros(self.limit + 1)
            self.mean = np.zeros((self.limit + 1, len(mean)))
        if len(mean) != self.mean.shape[1]:
            raise ValueError("the vectors have different lengths")
        if self.size:
            away = ((self.mean[: self.size] - mean) ** 2).sum(axis=1)
            near = int(away.argmin())
            if away[near] <= self.reach:
                total = self.n[near] + n
                self.mean[near] += (mean - self.mean[near]) * (n / total)
                self.sse[near] += sse + away[near] * self.n[near] * n / total
                self.n[near] = total
                return
        at = self.size
        self.n[at], self.mean[at], self.sse[at], self.size = n, mean, sse, at + 1
        if self.size > self.limit:
            self.widen()

    def widen(self) -> None:
        """Put the features together under a wider reach: half of them have a neighbour within it."""
        n, mean, sse = (x[: self.size].copy() for x in (self.n, self.mean, self.sse))
        square = (mean**2).sum(axis=1)
        away = np.maximum(square[:, None] + square - 2 * mean @ mean.T, 0)
        np.fill_diagonal(away, np.inf)
        # the product's rounding must not leave the reach below a real distance
        self.reach = max(2 * self.reach, float(np.median(away.min(axis=1))), 1e-12 * float(square.max()))
        self.size = 0
        for row in zip(n, mean, sse, strict=True):
            self.add(*row)

    def batch(self, **first: int) -> pa.RecordBatch:
        """The features as rows, in the order of their means."""
        size = self.size
        order = np.lexsort(self.mean[:size].T[::-1]) if size else np.empty(0, int)
        n, means, sse = (x[:size][order] if size else np.empty(0) for x in (self.n, self.mean, self.sse))
        (name, value), = first.items()
        lead = np.arange(size) if value is None else np.full(size, value)
        arrays = [pa.array(lead, pa.int64()), pa.array(n.astype(np.int64)), pa.array(list(means), pa.list_(pa.float64())), pa.array(sse, pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names=[name, "n", "mean", "sse"])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of an array column."""
    rows = [np.asarray(v, np.float64) for v in column.to_pylist()]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("the vectors have different lengths")
    return np.stack(rows) if rows else np.empty((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and finite throughout."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.withColumn("vector", F.col("vector").cast("array<double>")).filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & whole)


def leaves(vectors: DataFrame, limit: int = 500) -> DataFrame:
    """The stored table (leaf, n, mean, sse) of at most ``limit`` cluster features of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Features(limit)
        for batch in batches:
            if batch.num_rows:
                for mean, n in zip(*np.unique(matrix(batch.column(0)), axis=0, return_counts=True), strict=True):
                    found.add(int(n), mean, 0.0)
        if found.size:
            yield found.batch(task=TaskContext.get().partitionId())

    def together(rows: pa.Table, **first: int) -> pa.Table:
        found, means = Features(limit), matrix(rows.column("mean"))
        n, sse = rows.column("n").to_numpy(), rows.column("sse").to_numpy()
        for i in np.lexsort([*means.T[::-1], -n]):
            found.add(int(n[i]), means[i], float(sse[i]))
        return pa.Table.from_batches([found.batch(**first)])

    made = stage(usable(vectors).select("vector").mapInArrow(run, FEATURE))
    while (made.agg(F.max("task")).first()[0] or 0) >= FAN_IN:
        parts = made.withColumn("task", F.expr(f"task div {FAN_IN}"))
        wider = stage(parts.groupBy("task").applyInArrow(lambda key, rows: together(rows, task=key[0].as_py()), FEATURE))
        release(made)
        made = wider
    last = stage(made.groupBy(F.lit("all").alias("all")).applyInArrow(lambda rows: together(rows, leaf=None), LEAF))
    release(made)
    return last


def chain(n: np.ndarray, mean: np.ndarray) -> list[tuple[int, int, float]]:
    """Ward's merges (a member of one side, a member of the other, height), by height; memory grows with the leaves alone."""
    n, mean, active = n.astype(np.float64), mean.copy(), np.ones(len(n), bool)
    path, merges = [], []
    for _ in range(len(n) - 1):
        if not path:
            path.append(int(active.argmax()))
        while True:
            i = path[-1]
            cost = 2 * n[i] * n / (n[i] + n) * ((mean - mean[i]) ** 2).sum(axis=1)
            cost[~active] = cost[i] = np.inf
            j = int(cost.argmin())
            if len(path) > 1 and cost[path[-2]] <= cost[j]:
                j = path[-2]
                break
            path.append(j)
        del path[-2:]
        i, j = min(i, j), max(i, j)
        merges.append((i, j, float(np.sqrt(cost[j] if np.isfinite(cost[j]) else cost[i]))))
        mean[i] += (mean[j] - mean[i]) * (n[j] / (n[i] + n[j]))
        n[i] += n[j]
        active[j] = False
    return sorted(merges, key=lambda m: m[2])


def merge_tree(found: DataFrame) -> DataFrame:
    """(step, a, b, height, size): merges by height; leaves have their numbers, the cluster of step s is number of leaves + s.

    ``size`` counts rows. The leaves are bounded, so one task does it.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("leaf")
        n = rows.column("n").to_numpy()
        label, size, top = list(range(len(n))), dict(enumerate(n.tolist())), list(range(len(n)))

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        out = []
        for step, (i, j, height) in enumerate(chain(n, matrix(rows.column("mean")))):
            i, j = root(i), root(j)
            a, b = sorted((label[i], label[j]))
            top[j], label[i], size[len(n) + step] = i, len(n) + step, size[a] + size[b]
            out.append((step, a, b, height, size[len(n) + step]))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["step", "a", "b", "height", "size"])

    return found.groupBy(F.lit("all").alias("all")).applyInArrow(run, MERGE)


def cut(found: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(leaf, cluster): the leaves under the tree cut at k clusters, which are numbered from 0 by their smallest leaf."""

    def run(rows: pa.Table, merges: pa.Table) -> pa.Table:
        count = rows.num_rows
        above = {}
        merges = merges.sort_by("step").slice(0, max(0, count - max(1, k)))
        for step, a, b in zip(*(merges.column(c).to_pylist() for c in ("step", "a", "b")), strict=True):
            above[a] = above[b] = count + step
        number, out = {}, []
        for leaf in range(count):
            top = leaf
            while top in above:
                top = above[top]
            out.append(number.setdefault(top, len(number)))
        return pa.Table.from_arrays([pa.array(range(count), pa.int64()), pa.array(out, pa.int64())], names=["leaf", "cluster"])

    one = F.lit("all").alias("all")
    return found.groupBy(one).cogroup(tree.groupBy(one)).applyInArrow(run, "leaf long, cluster long")


def assign(vectors: DataFrame, labelled: DataFrame, key: str = "id") -> DataFrame:
    """(key, cluster, distance): each row under the cluster of its nearest leaf; ``labelled`` is (leaf, cluster, mean), bounded."""
    held = labelled.orderBy("leaf").select("cluster", "mean").toArrow()
    cluster, means = held.column("cluster").to_numpy(), matrix(held.column("mean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = [((means - np.asarray(v)) ** 2).sum(axis=1) for v in batch.column(1).to_pylist()]
            near = np.array([a.argmin() for a in away], int)
            distance = np.sqrt([a[i] for a, i in zip(away, near, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster[near]), pa.array(distance, pa.float64())], names=[key, "cluster", "distance"])

    rows = usable(vectors).select(key, "vector")
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, cluster long, distance double")


def ward_clusters(vectors: DataFrame, k: int = 4, limit: int = 500, key: str = "id") -> DataFrame:
    """(key, cluster, distance): Ward's tree of all rows cut at k."""
    found = leaves(vectors, limit)
    labelled = stage(found.join(cut(found, merge_tree(found), k), "leaf").select("leaf", "cluster", "mean"))
    return assign(vectors, labelled, key)
