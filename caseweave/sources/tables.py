"""Filters at the scan, samples, word lists and table files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "app_id LONG, app_name STRING, avg_severity DOUBLE, incidents INT, risk DOUBLE"
EDGE_SCHEMA = "src LONG, dst LONG, weight DOUBLE, avg_days DOUBLE"


def filter_by_size(df: DataFrame, size: Column | None = None, min_size: int = 1000) -> DataFrame:
    """Keep rows whose size, by default the size of their file, is above ``min_size``."""
    return df.where((F.col("_metadata.file_size") if size is None else size) > min_size)


def sample_rows(df: DataFrame, fraction: float = 0.1, seed: int = 11, key: str | None = None) -> DataFrame:
    """Seeded sample without replacement; with a key it is a stable sample by hash of that key."""
    if key is None:
        return df.sample(False, fraction, seed)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.where(h < int(fraction * 2**32))


def load_word_list(spark: SparkSession, path: str, comment: str = ";") -> DataFrame:
    """Words of a list file, one per line; comment lines and blank lines drop out."""
    word = F.lower(F.trim("value"))
    return (
        spark.read.text(path).where(~F.trim("value").startswith(comment)).select(word.alias("word")).where("word <> ''").distinct()
    )


def write_nodes_edges(df: DataFrame, path: str, sep: str = "\t", header: bool = False) -> None:
    df.write.mode("errorifexists").csv(path, sep=sep, header=header)


def read_nodes_edges(spark: SparkSession, path: str, schema: str = EDGE_SCHEMA, sep: str = "\t", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def write_tables(df: DataFrame, path: str, fmt: str = "parquet", *partition_by: str) -> None:
    """Parquet between stages, CSV for exports."""
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_embedding(embedding: DataFrame, path: str) -> None:
    """Word vectors as parquet (word, vector)."""
    embedding.select("word", "vector").write.mode("errorifexists").parquet(path)


def load_embedding(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word STRING, vector ARRAY<DOUBLE>").parquet(path)
