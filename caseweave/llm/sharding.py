"""Weighted rendezvous sharding of records by a stable key, in DataFrame functions only.

Every shard draws a number for a key from the hash of (key, shard); the number is stretched by the shard's weight and the
smallest wins. A further shard only takes the keys it wins itself, so no other record moves.

Slots number the records of a shard from 0 without gaps: records are counted per (bucket, shard), the buckets' counts are
summed up as offsets, and places inside a bucket come from a window over that bucket alone. Buckets mix the key with the
place in the stored table, so a key that holds many rows is spread over them.

Null keys are one key; null texts count no bytes and the checksum of the empty text. Repeated rows go to one shard and get
slots of their own. An empty table gives an empty result. Input columns other than key and text are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.session import stage

#: Buckets per shard in which slots are counted; fixed, so that offsets are a table of bounded size.
BUCKETS = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) that wins a key; a shard of twice the weight wins twice the keys."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    draws = []
    for shard, weight in enumerate(weights):
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(unit) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*draws))["shard"]


def number_slots(placed: DataFrame, shard: str, key: str) -> DataFrame:
    """``placed`` with ``slot``: gapless from 0 in every shard. ``placed`` is stored first and read twice."""
    run = F.floor(F.monotonically_increasing_id() / 8192)
    stored = stage(placed.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key), run), F.lit(BUCKETS)).cast("int")))
    counts = stored.groupBy("_bucket", shard).count()
    before = F.sum("count").over(Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_bucket", shard, F.coalesce(before, F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket", shard).orderBy(key)) - 1
    return stored.withColumn("_place", place).join(offsets, ["_bucket", shard]).withColumn("slot", F.col("_offset") + F.col("_place")).drop("_bucket", "_offset", "_place")


def shard_records(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, added: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): the shard of each record now and with one more shard."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"), rendezvous(F.col(key), [*weights, added]).alias("grown_shard"),
    )
    return number_slots(placed, "shard", key).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
