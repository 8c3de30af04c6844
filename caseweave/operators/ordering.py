"""Positions, cut values and top-k lists without a single-task global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.session import stage


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of a full order (planned as a bounded heap per task)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group.

    Spark limits each map task to k rows per group before the shuffle, so a group that holds a
    large share of the rows arrives as at most k rows per task.
    """
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based position of each row in its group under a full order.

    Rows are range-partitioned by (group, order), so one group spreads over many tasks. A task counts
    its rows per group, the running sum of these counts is the offset of the task, and the position
    is offset plus local row number. The ranged rows are staged because both uses must see the same
    ranges.
    """
    pieces = [F.col(g) for g in group]
    ranged = stage(
        df.repartitionByRange(*pieces, *order).withColumn("_piece", F.spark_partition_id())
    )
    sizes = ranged.groupBy("_piece", *group).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_piece", *group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    local = W.partitionBy("_piece", *group).orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(local))
        .join(offsets, ["_piece", *group])
        .withColumn(name, (F.col("_offset") + F.col("_row")).cast("long"))
        .drop("_piece", "_row", "_offset")
    )


def assign_dense_ids(df: DataFrame, value: str, name: str = "id") -> DataFrame:
    """The distinct non-empty values with ids 1, 2, ... in value order."""
    values = df.where(F.col(value) != "").select(value).distinct()
    return positions(values, [], [F.col(value)], name)


def percentiles_r6(df: DataFrame, value: str, percents: Sequence[float]) -> DataFrame:
    """(percent, percentile): values at rank (p/100)(n+1) with linear interpolation, clamped to the first and last; one sort for all."""
    ranked = stage(positions(df.where(F.col(value).isNotNull()).select(value), [], [F.col(value)]))
    wanted = ranked.agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"))
    at = F.col("percent") / 100.0 * (F.col("n") + 1.0)
    inside = lambda rank: F.greatest(F.lit(1), F.least("n", rank)).cast("long")
    bounds = wanted.select("percent", at.alias("at"), inside(F.floor(at)).alias("low"), inside(F.floor(at) + 1).alias("high"))
    low = ranked.select(F.col("position").alias("low"), F.col(value).alias("a"))
    high = ranked.select(F.col("position").alias("high"), F.col(value).alias("b"))
    between = F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))
    return bounds.join(low, "low").join(high, "high").select("percent", between.alias("percentile"))


def percentile_r6(df: DataFrame, value: str, percent: float) -> DataFrame:
    """One percentile as ``percentiles_r6`` gives it."""
    return percentiles_r6(df, value, [percent]).select("percentile")


def prune_weak_edges(edges: DataFrame, weight: str = "weight", fraction: float = 0.5) -> DataFrame:
    """Keep edges strictly heavier than the heaviest of the lowest ⌊fraction·n⌋."""
    ranked = positions(edges.select(weight), [], [F.col(weight)])
    n = ranked.agg(F.count(F.lit(1))).scalar()
    cut = ranked.where(F.col("position") == F.floor(F.lit(fraction) * n)).agg(F.max(weight))
    return edges.where(F.col(weight) > F.coalesce(cut.scalar(), F.lit(float("-inf"))))
