"""A table of the latest row of each id, kept in folders by a hash of the id, so that a merge rewrites only what it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators.relational import upsert_by_id
from caseweave.session import release, stage


class MergedTable:
    """Parquet folders ``bucket=0`` … below ``path``; ids, order columns and ``buckets`` are a choice for the table's whole life.

    The order columns decide which of two rows of an id is the later one; ties go by the other columns. Merges of one table
    must not run at the same time. The merged rows are written to the shared folder before a bucket is replaced, and a merge
    that broke off can be run again, as merging the same rows twice changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, ids: Sequence[str], order: Sequence[str], buckets: int = 256):
        self.spark, self.path, self.ids, self.order, self.buckets = spark, path.rstrip("/"), list(ids), list(order), buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.ids), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        writer = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def create(self, rows: DataFrame) -> None:
        self._write(self._placed(upsert_by_id(rows, self.ids, self.order)))

    def merge(self, rows: DataFrame) -> list[int]:
        """Bring new and changed rows in; the numbers of the buckets that were rewritten."""
        fresh = stage(self._placed(upsert_by_id(rows, self.ids, self.order)))
        touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if touched:
            held = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched))
            merged = stage(self._placed(upsert_by_id(held.unionByName(fresh).drop("bucket"), self.ids, self.order)))
            self._write(merged)
            release(merged)
        release(fresh)
        return touched
