"""Cluster tables and scores over groups and tags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions import vectors as vec
from caseweave.operators.ordering import top_k_per_group
from caseweave.operators.search import vector_sum
from caseweave.session import stage


def cluster_members(assignment: DataFrame) -> DataFrame:
    """Each member with the size of its cluster (a row per member, never one list per cluster)."""
    sizes = assignment.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return assignment.join(sizes, "cluster")


def cluster_terms(weights: DataFrame, assignment: DataFrame, k: int = 10) -> DataFrame:
    """The k terms with the highest mean weight of each cluster."""
    sizes = assignment.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    sums = weights.join(assignment, "doc_id").groupBy("cluster", "term").agg(F.sum("w").alias("total"))
    means = sums.join(sizes, "cluster").select("cluster", "term", (F.col("total") / F.col("size")).alias("weight"))
    return top_k_per_group(means, ["cluster"], [F.round("weight", 9).desc(), F.col("term")], k)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    sums = vectors.groupBy(group).agg(vector_sum().alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.col(group).alias("id"), F.transform("s", lambda x: x / F.col("n")).alias("vector"))


def _unit(vectors: DataFrame, weights: Column | None) -> DataFrame:
    v = F.col("vector") if weights is None else F.zip_with("vector", weights, lambda x, w: x * w)
    return vectors.withColumn("vector", vec.unit(v))


def _pair_sum(s: Column, n: Column) -> Column:
    """Sum of cosines over the pairs of n unit vectors with sum s: (‖s‖² − n)/2."""
    return (vec.dot(s, s) - n) / 2


def inter_group_score(vectors: DataFrame, group: str, weights: Column | None = None) -> DataFrame:
    """Cosine sum over pairs of the same group minus that over other pairs, per pair.

    Sums over pairs follow from the vector sum of each group, so no pair is formed.
    """
    units = _unit(vectors, weights).where("vector IS NOT NULL")
    groups = units.groupBy(group).agg(vector_sum().alias("vector"), F.count(F.lit(1)).alias("n"))
    same = F.sum(_pair_sum(F.col("vector"), F.col("n"))).alias("same")
    whole = groups.agg(same, vector_sum().alias("s"), F.sum("n").alias("n"))
    return whole.select(((2 * F.col("same") - _pair_sum(F.col("s"), F.col("n"))) / (F.col("n") * (F.col("n") - 1) / 2)).alias("score"))


def _tag_score(units: DataFrame, keys: list[str]) -> DataFrame:
    """Score per ``keys``: vectors are summed per distinct tag set, and only sets that share a tag are joined."""
    sums = units.groupBy(*keys, F.array_sort(F.array_distinct("tags")).alias("tags")).agg(vector_sum().alias("s"), F.count(F.lit(1)).alias("n"))
    return _set_score(sums, keys)


def _set_score(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Score per ``keys`` from the sums (…, tags, s, n) of the unit vectors of each sorted tag set."""
    sets = stage(sums)
    own = F.sum(F.when(F.size("tags") > 0, _pair_sum(F.col("s"), F.col("n"))).otherwise(0.0))
    totals = sets.groupBy(*keys).agg(own.alias("own"), vector_sum("s").alias("whole"), F.sum("n").alias("n"))
    fanned = sets.withColumn("tag", F.explode("tags"))
    a, b = fanned.alias("a"), fanned.alias("b")
    at = (F.col("a.tag") == F.col("b.tag")) & (F.col("a.tags") < F.col("b.tags"))
    for key in keys:
        at = at & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    # a pair of sets counts at the first tag that they share
    first = F.col("a.tag") == F.array_min(F.array_intersect("a.tags", "b.tags"))
    across = a.join(b, at & first).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.sum(vec.dot(F.col("a.s"), F.col("b.s"))).alias("across"))
    joined = totals.join(across, keys, "left") if keys else totals.withColumn("across", across.scalar())
    shared = F.col("own") + F.coalesce("across", F.lit(0.0))
    score = (2 * shared - _pair_sum(F.col("whole"), F.col("n"))) / (F.col("n") * (F.col("n") - 1) / 2)
    return joined.select(*keys, score.alias("score"))


def inter_tag_score(vectors: DataFrame, weights: Column | None = None) -> DataFrame:
    """As ``inter_group_score`` with tag sets: plus where two vectors share any tag, minus elsewhere.

    The cosine sum over pairs of two sets is the dot product of their vector sums, so no pair of vectors is formed.
    """
    return _tag_score(_unit(vectors, weights).where("vector IS NOT NULL"), [])


def weight_draws(dims: int, iters: int, seed: int = 11) -> list[list[float]]:
    """Normal draws of dimension weights."""
    from random import Random

    rng = Random(seed)
    return [[rng.gauss(0.0, 1.0) for _ in range(dims)] for _ in range(iters)]


def drawn_sums(vectors: DataFrame, draws: np.ndarray) -> DataFrame:
    """(iter, tags, s, n): per draw and tag set the sum of the unit vectors after the draw's weights.

    A task multiplies a batch by all draws at once and keeps a sum per draw and tag set of the batch, so what is shuffled
    follows from the draws and the tag sets and not from the rows. Rows of norm zero under a draw don't count in it.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            sets = [tuple(t) for t in batch.column(1).to_pylist()]
            number = {t: k for k, t in enumerate(dict.fromkeys(sets))}
            member = np.zeros((len(number), len(sets)))
            member[[number[t] for t in sets], range(len(sets))] = 1.0
            norms = np.sqrt((x * x) @ (w * w).T)  # rows x draws
            shares = np.divide(1.0, norms, out=np.zeros_like(norms), where=norms > 0)
            tags = pa.array([list(t) for t in number], pa.list_(pa.string()))
            for i in range(len(w)):
                sums = (member * shares[:, i]) @ x * w[i]
                n = (member @ (norms[:, i] > 0)).astype(np.int64)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(sums), pa.int32()), tags, rows, pa.array(n)], names=["iter", "tags", "vector", "n"])

    whole = F.forall("vector", lambda v: v.isNotNull()) & (F.size("vector") == draws.shape[1])
    narrow = vectors.where(whole).select("vector", F.array_sort(F.array_distinct("tags")).alias("tags")).where("tags IS NOT NULL")
    parts = narrow.mapInArrow(run, "iter int, tags array<string>, vector array<double>, n long")
    return parts.groupBy("iter", "tags").agg(vector_sum().alias("s"), F.sum("n").alias("n")).where("n > 0")


def tune_similarity_weights(vectors: DataFrame, dims: int, iters: int = 100, seed: int = 11) -> DataFrame:
    """Random search of dimension weights: the best (weights, score) of ``iters`` normal draws, from one pass over the rows."""
    draws = weight_draws(dims, iters, seed)
    table = vectors.sparkSession.createDataFrame([(i, w) for i, w in enumerate(draws)], "iter INT, weights ARRAY<DOUBLE>")
    scores = _set_score(drawn_sums(vectors, np.array(draws)), ["iter"])
    return scores.join(table, "iter").orderBy(F.desc("score"), "iter").limit(1)
