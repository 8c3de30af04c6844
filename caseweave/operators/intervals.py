"""Incidents that were open at the same time.

An incident occupies the days ``first_day .. last_day`` of its open span padded by one day on each
side. Two incidents pair (parent, child) when they share a day and the parent does not start after
the child. Then the child's first day is always a shared day, which gives two rules:

* a parent from an earlier day meets the child in the bucket of the child's first day;
* a parent that starts on the child's first day must start before it. For that the time of day is
  read as digits of base 16, and the two meet at the first digit in which they differ.

Both are equality joins on a bucket with ``parent digit < child digit``, each pair meets in exactly
one bucket, and rows of one component can be summed per bucket before the join. So counts and
averages over pairs never list the pairs. A bucket of many components is cut into slices of its children, to each of
which its parents are repeated, so a busy day is many tasks.

``pair_totals`` doesn't go through the digits for starts of one day: a day is cut into slots of time, and in a slot the
starts are taken in order against the running totals of all components so far, so work is starts x components.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.session import stage

DAY = 86_400_000_000  # microseconds
DIGITS, BASE_BITS = 10, 4  # digits of base 16 that cover the microseconds of a day
SLICE = 256  # summed rows of a bucket per slice
SLOT = 200_000  # starts of a day per slot of time, if they are even over the day
PROBES = 1 << 16  # children of a day in a slice, where pairs are formed
SENT = 200_000  # children that go to all tasks
CELLS = 1 << 22  # (child, parent) components that a task sums at once
AS_PARENT, AS_CHILD = "role <> 2", "role <> 1"


def days_between_frac(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(DAY))


def days_between_int(start: Column, end: Column) -> Column:
    return days_between_frac(start, end).cast("int")


def filter_duration(incidents: DataFrame, days: float = 15.0) -> DataFrame:
    """Incidents that were open for at most so many days."""
    return incidents.where(days_between_frac(F.col("from_ts"), F.col("to_ts")) <= days)


def valid_incidents(incidents: DataFrame) -> DataFrame:
    """Incidents with both dates and a component."""
    return incidents.where(
        F.col("from_ts").isNotNull() & F.col("to_ts").isNotNull() & F.col("app_id").isNotNull() & (F.col("app_id") > 0)
    )


def open_days(incidents: DataFrame) -> DataFrame:
    """Add the first and last day (days since the epoch) of the padded open span."""
    start = F.unix_micros("from_ts")
    length = F.ceil((F.unix_micros("to_ts") - start) / F.lit(float(DAY)) + 2).cast("long")
    first = F.floor(start / F.lit(float(DAY))).cast("long") - 1
    return (
        incidents.withColumn("first_day", first)
        .withColumn("last_day", first + length - 1)
        .where(F.col("last_day") >= F.col("first_day"))
    )


def meeting_points(incidents: DataFrame, tie_rank: Column | None = None, levels: int = DIGITS) -> DataFrame:
    """One row per incident and bucket, with its digit there.

    Columns added: the bucket (day, level, pos), the ``digit`` there, and ``role``: 1 as parent, 2 as
    child, 3 as both. Level -1 joins earlier days to first days, levels 0..9 are the
    digits of the time of day (the first ``levels`` of them), level 99 holds incidents that start at the same
    microsecond, where the digit is ``tie_rank`` if given.
    """
    micros = F.unix_micros("from_ts").cast("long")
    in_day = F.pmod(micros, F.lit(DAY))

    def point(day, level, pos, digit, role):
        return F.struct(
            day.cast("long").alias("day"), F.lit(level).alias("level"), pos.cast("long").alias("pos"),
            digit.cast("long").alias("digit"), F.lit(role).alias("role"),
        )

    first = F.col("first_day")
    zero, one = F.lit(0), F.lit(1)
    carried = F.when(
        F.col("last_day") > first,
        F.transform(F.sequence(first + 1, F.col("last_day")), lambda d: point(d, -1, zero, zero, 1)),
    ).otherwise(F.array())
    own = [point(first, -1, zero, one, 2)]
    for level in range(levels):
        own.append(
            point(first, level, F.shiftright(in_day, BASE_BITS * (level + 1)), F.shiftright(in_day, BASE_BITS * level) % (1 << BASE_BITS), 3)
        )
    own.append(point(first, 99, in_day, zero if tie_rank is None else tie_rank, 3))
    return (
        open_days(incidents)
        .withColumn("m", F.explode(F.concat(carried, F.array(*own))))
        .select("*", "m.*")
        .drop("m")
    )


def _meets(p: str, c: str, ties: bool) -> Column:
    before = F.col(f"{p}.digit") < F.col(f"{c}.digit")
    if ties:
        before = before | ((F.col(f"{p}.level") == 99) & (F.col(f"{p}.digit") == F.col(f"{c}.digit")))
    return (
        (F.col(f"{p}.day") == F.col(f"{c}.day"))
        & (F.col(f"{p}.level") == F.col(f"{c}.level"))
        & (F.col(f"{p}.pos") == F.col(f"{c}.pos"))
        & before
    )


def _start_days() -> Column:
    """Start as days after the bucket's day: small numbers keep the sums of differences exact enough."""
    return (F.unix_micros("from_ts") - F.col("day") * DAY) / F.lit(float(DAY))


def pair_totals(incidents: DataFrame, by: str = "app_id", break_ties: bool = False) -> DataFrame:
    """Number of incident pairs and sum of elapsed days for each (parent, child) value of ``by``.

    Equal start times count in both directions, or once in a fixed direction with ``break_ties``.
    """
    rank = F.xxhash64(F.col(by)) if break_ties else None
    bucket = ["day", "level", "pos"]
    cells = stage(
        meeting_points(incidents, rank, levels=0)
        .groupBy(*bucket, "digit", by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_start_days()).alias("s"), F.max("role").alias("role"))
    )
    # buckets of one row hold no pair, but for several starts at one microsecond
    sizes = cells.groupBy(*bucket).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows")).where("cells > 1 OR (level = 99 AND rows > 1)")
    shared = cells.join(sizes.select(*bucket, F.ceil(F.col("cells") / SLICE).cast("int").alias("slices")), bucket)
    p = shared.where(AS_PARENT).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("p")
    c = shared.where(AS_CHILD).withColumn("slice", F.pmod(F.xxhash64(by, F.lit("slice")), "slices").cast("int")).alias("c")
    same = (F.col("p.level") == 99) & (F.col("p.digit") == F.col("c.digit")) & (F.col(f"p.{by}") == F.col(f"c.{by}"))
    meets = _meets("p", "c", ties=True) & (F.col("p.slice") == F.col("c.slice"))
    if break_ties:  # components of equal hash have their own order
        meets = meets & ((F.col("p.digit") != F.col("c.digit")) | (F.col(f"p.{by}") <= F.col(f"c.{by}")))
    both_ways = F.col("p.n") * (F.col("p.n") - 1)
    own_pairs = both_ways / 2 if break_ties else both_ways
    n = F.when(same, own_pairs).otherwise(F.col("p.n") * F.col("c.n")).cast("long")
    elapsed = F.when(F.col("p.level") == 99, F.lit(0.0)).otherwise(
        F.col("p.n") * F.col("c.s") - F.col("c.n") * F.col("p.s")
    )
    met = p.join(c, meets).select(F.col(f"p.{by}").alias("src"), F.col(f"c.{by}").alias("dst"), n.alias("n"), elapsed.alias("elapsed"))
    return (
        met.unionByName(later_the_same_day(incidents, by))
        .groupBy("src", "dst")
        .agg(F.sum("n").alias("pairs"), F.sum("elapsed").alias("elapsed"))
        .where(F.col("pairs") > 0)
    )


def later_the_same_day(incidents: DataFrame, by: str) -> DataFrame:
    """(src, dst, n, elapsed): per slot of a day and components, the pairs whose parent starts earlier on the child's first day."""
    in_day = F.pmod(F.unix_micros("from_ts").cast("long"), F.lit(DAY))
    starts = open_days(incidents).select(F.col("first_day").alias("day"), in_day.alias("at"), by)
    starts = stage(starts.groupBy("day", "at", by).agg(F.count(F.lit(1)).alias("n")))
    busiest = starts.groupBy("day").agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0
    slots = max(1, -(-busiest // SLOT))
    placed = starts.withColumn("slot", F.floor(F.col("at") * slots / F.lit(DAY)).cast("int")).withColumn("s", F.col("n") * F.col("at") / F.lit(float(DAY)))
    before = placed.groupBy("day", "slot", by).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where(F.col("slot") < slots - 1)
    before = before.withColumn("slot", F.explode(F.sequence(F.col("slot") + 1, F.lit(slots - 1)))).withColumn("at", F.lit(-1).cast("long"))
    rows = placed.unionByName(before)
    kind = incidents.schema[by].dataType.simpleString()
    spark = incidents.sparkSession  # few bytes but much work per row: keep adaptive execution from merging the partitions
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("day", "slot", "at", "n", "s", F.col(by).alias("by")).repartition(parts, "day", "slot").groupBy("day", "slot").applyInArrow(
        slot_totals, f"src {kind}, dst {kind}, n long, elapsed double"
    )


def slot_totals(rows: pa.Table) -> pa.Table:
    """Pairs and days between them per (parent, child) of a slot; rows ``at`` -1 are the totals of the slots before."""
    rows = rows.sort_by("at")
    at, n, s = (rows[c].to_numpy() for c in ("at", "n", "s"))
    coded = rows["by"].combine_chunks().dictionary_encode(null_encoding="encode")
    code, names = coded.indices.to_numpy(), coded.dictionary
    earlier, width = np.searchsorted(at, at, "left"), max(1, CELLS // len(names))
    parts = []
    for low in range(0, len(names), width):
        size = min(width, len(names) - low)
        pairs, elapsed = np.zeros((size, len(names))), np.zeros((size, len(names)))
        count, total, done = np.zeros(len(names)), np.zeros(len(names)), 0
        for k in np.flatnonzero((at >= 0) & (code >= low) & (code < low + size)):
            if done < earlier[k]:
                np.add.at(count, code[done : earlier[k]], n[done : earlier[k]])
                np.add.at(total, code[done : earlier[k]], s[done : earlier[k]])
                done = earlier[k]
            pairs[code[k] - low] += n[k] * count
            elapsed[code[k] - low] += s[k] * count - n[k] * total
        child, parent = np.nonzero(pairs)
        ends = [names.take(pa.array(parent)), names.take(pa.array(child + low))]
        found = [*ends, pa.array(pairs[child, parent].astype(np.int64)), pa.array(elapsed[child, parent])]
        parts.append(pa.Table.from_arrays(found, names=["src", "dst", "n", "elapsed"]))
    return pa.concat_tables(parts)


def overlap_degrees(incidents: DataFrame) -> DataFrame:
    """For each incident that is in a pair the number of its parents and children and the days since all its parents.

    The pairs are formed, so work is their number, but none is shuffled: they are summed per incident in the task that finds
    them. They are formed once per end. The join is a merge: an incident has a row per open day, of which the planner's size of
    its file says nothing, so it would send them all to every task.
    """
    pairs = pair_incidents_by_overlap(incidents, incidents, sent=0)
    up = pairs.groupBy(F.col("child").alias("incident_id")).agg(F.count(F.lit(1)).alias("parents"), F.sum("elapsed_days").alias("days"))
    down = pairs.groupBy(F.col("parent").alias("incident_id")).agg(F.count(F.lit(1)).alias("children"))
    none = F.lit(0).cast("long")
    ends = up.select("incident_id", "parents", none.alias("children"), "days").unionByName(
        down.select("incident_id", none.alias("parents"), "children", F.lit(0.0).alias("days"))
    )
    return ends.groupBy("incident_id").agg(F.sum("parents").alias("n_parents"), F.sum("children").alias("n_children"), F.sum("days").alias("parent_days"))


def pair_incidents_by_overlap(
    probes: DataFrame, incidents: DataFrame, break_ties_by_id: bool = False, carried: Sequence[str] = (), sent: int = SENT
) -> DataFrame:
    """The (parent, child) pairs whose child is one of the ``probes``.

    Columns ``carried`` of both frames come along as ``parent_`` and ``child_`` columns, so the pairs need no join for them.
    At most ``sent`` probes go to all tasks, and the incidents meet them where they lie; with more, both are shuffled by day,
    the probes of a busy day in slices, to each of which the day's incidents are repeated.

    With ``probes = incidents`` this is the complete pair list, whose size grows with the square of
    the incidents open per day; ``pair_totals`` gives its sums per component without it.
    """
    c = open_days(probes)
    p = open_days(incidents).withColumn("day", F.explode(F.sequence("first_day", "last_day")))
    met = (F.col("p.day") == F.col("c.first_day")) & (F.col("p.incident_id") != F.col("c.incident_id"))
    if sent and c.limit(sent + 1).count() <= sent:
        c = F.broadcast(c)
    else:
        busiest = c.groupBy("first_day").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        slices = max(1, -(-busiest // PROBES))
        spark = probes.sparkSession  # few bytes but much work per row: keep adaptive execution from merging the partitions
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        c = c.withColumn("slice", F.pmod(F.xxhash64("incident_id", "from_ts"), F.lit(slices)).cast("int")).repartition(parts, "first_day", "slice").hint("merge")
        p = p.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(parts, "day", "slice")
        met = met & (F.col("p.slice") == F.col("c.slice"))
    earlier = F.col("p.from_ts") <= F.col("c.from_ts")
    if break_ties_by_id:
        earlier = (F.col("p.from_ts") < F.col("c.from_ts")) | (
            (F.col("p.from_ts") == F.col("c.from_ts")) & (F.col("p.incident_id") < F.col("c.incident_id"))
        )
    return (
        p.alias("p").join(c.alias("c"), met & earlier)
        .select(
            F.col("p.incident_id").alias("parent"), F.col("c.incident_id").alias("child"),
            F.col("p.app_id").alias("parent_app"), F.col("c.app_id").alias("child_app"),
            days_between_frac(F.col("p.from_ts"), F.col("c.from_ts")).alias("elapsed_days"),
            *[F.col(f"{side}.{c}").alias(f"{end}_{c}") for c in carried for side, end in (("p", "parent"), ("c", "child"))],
        )
    )


def app_edge_stats(incidents: DataFrame, integer_days: bool = False, break_ties: bool = False) -> DataFrame:
    """Component edges: number of incident pairs and average days from parent to child start.

    ``integer_days`` cuts the average of each edge to whole days.
    """
    totals = pair_totals(incidents, "app_id", break_ties)
    avg = F.col("elapsed") / F.col("pairs")
    return totals.select("src", "dst", "pairs", (avg.cast("int").cast("double") if integer_days else avg).alias("avg_days"))


def normalize_edge_weight(edges: DataFrame, how: str = "max") -> DataFrame:
    """Edge weight = pairs / largest pairs, or with ``how='total'`` pairs / number of all pairs.

    The edges are staged, since the whole and the rows both need them.
    """
    edges = stage(edges)
    whole = edges.agg((F.max if how == "max" else F.sum)("pairs")).scalar()
    return edges.withColumn("weight", F.col("pairs") / whole)
