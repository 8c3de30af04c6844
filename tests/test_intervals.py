from datetime import datetime, timedelta
from random import Random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseweave.operators import intervals

START = datetime(2015, 3, 1)


def make(spark, rows):
    return spark.createDataFrame(rows, "incident_id LONG, app_id LONG, from_ts TIMESTAMP, to_ts TIMESTAMP, severity INT")


def random_rows(seed, n=120, apps=7):
    rng = Random(seed)
    rows = []
    for i in range(n):
        # many equal starts, starts that differ in the last digit only, whole-day spans, one frequent component
        start = START + timedelta(hours=rng.choice([0, 5, 5, 29, 71]), microseconds=rng.choice([0, 0, 1, 2, 977_531]))
        length = rng.choice([timedelta(0), timedelta(days=1), timedelta(days=2, seconds=1), timedelta(hours=30)])
        rows.append((i, 1 if rng.random() < 0.34 else rng.randrange(apps), start, start + length, rng.randrange(1, 4)))
    return rows


def open_keys(row):
    """The dates of start - 1 day + k days while before end + 1 day."""
    day, keys = row[2] - timedelta(days=1), set()
    while day < row[3] + timedelta(days=1):
        keys.add(day.date())
        day += timedelta(days=1)
    return keys


def brute_pairs(rows):
    keys = {r[0]: open_keys(r) for r in rows}
    return {
        (p[0], c[0]): (p[1], c[1], (c[2] - p[2]) / timedelta(days=1))
        for p in rows for c in rows
        if p[0] != c[0] and p[2] <= c[2] and keys[p[0]] & keys[c[0]]
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_totals_match_brute_force(spark, seed):
    rows = random_rows(seed)
    incidents, expected = make(spark, rows), brute_pairs(rows)

    listed = {(r.parent, r.child) for r in intervals.pair_incidents_by_overlap(incidents, incidents).collect()}
    assert listed == set(expected)

    sums = {}
    for a, b, days in expected.values():
        n, total = sums.get((a, b), (0, 0.0))
        sums[a, b] = (n + 1, total + days)
    got = {(r.src, r.dst): (r.pairs, r.avg_days) for r in intervals.app_edge_stats(incidents).collect()}
    assert got.keys() == sums.keys()
    for key, (n, total) in sums.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(total / n, abs=1e-9)

    degrees = {r.incident_id: r for r in intervals.overlap_degrees(incidents).collect()}
    for r in rows:
        parents = [v for (p, c), v in expected.items() if c == r[0]]
        assert degrees[r[0]].n_parents == len(parents)
        assert degrees[r[0]].n_children == sum(1 for p, c in expected if p == r[0])
        assert degrees[r[0]].parent_days == pytest.approx(sum(v[2] for v in parents), abs=1e-9)


def test_links_are_counted_from_pairs_of_ids(spark, monkeypatch):
    """An incident that comes twice is no parent of itself, and one without an id has no links."""
    rows = random_rows(6, 40)
    rows += [(i, app, start + timedelta(hours=k), end + timedelta(hours=k), s) for k, (i, app, start, end, s) in enumerate(rows[:12])]
    rows += [(None, *r[1:]) for r in rows[:9]]
    days = [open_keys(r) for r in rows]
    named = [(r, k) for r, k in zip(rows, days) if r[0] is not None]
    want = {}
    for p, of in named:
        for c, on in named:
            if p[0] != c[0] and p[2] <= c[2] and of & on:
                for i, x in ((c[0], (1, 0, (c[2] - p[2]) / timedelta(days=1))), (p[0], (0, 1, 0.0))):
                    want[i] = tuple(map(sum, zip(want.get(i, (0, 0, 0.0)), x)))
    for most in (1 << 16, 5):
        monkeypatch.setattr(intervals, "PROBES", most)
        degrees = intervals.overlap_degrees(make(spark, rows))
        got = {r.incident_id: (r.n_parents, r.n_children, r.parent_days) for r in degrees.collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in got)
    assert degrees._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_ties_count_once_when_broken(spark):
    rows = [(i, i % 3, START, START, 1) for i in range(9)]
    incidents = make(spark, rows)
    both = intervals.app_edge_stats(incidents).agg(F.sum("pairs")).first()[0]
    once = intervals.app_edge_stats(incidents, break_ties=True).agg(F.sum("pairs")).first()[0]
    listed = intervals.pair_incidents_by_overlap(incidents, incidents, break_ties_by_id=True).count()
    assert (both, once, listed) == (72, 36, 36)


def test_same_component_edges_stay(spark):
    incidents = make(spark, [(1, 5, START, START, 1), (2, 5, START + timedelta(hours=1), START + timedelta(hours=2), 1)])
    assert [tuple(r) for r in intervals.app_edge_stats(incidents).select("src", "dst", "pairs").collect()] == [(5, 5, 1)]


def test_integer_days_and_weights(spark):
    incidents = make(
        spark,
        [(1, 1, START, START + timedelta(days=9), 1)] + [(10 + i, 2, START + timedelta(days=i, hours=13), START + timedelta(days=9), 1) for i in range(3)],
    )
    edge = intervals.app_edge_stats(incidents, integer_days=True).where("src = 1 AND dst = 2").first()
    assert edge.avg_days == 1.0 and edge.pairs == 3
    weights = intervals.normalize_edge_weight(intervals.app_edge_stats(incidents)).agg(F.max("weight")).first()[0]
    shares = intervals.normalize_edge_weight(intervals.app_edge_stats(incidents), "total").agg(F.sum("weight")).first()[0]
    assert weights == 1.0 and shares == pytest.approx(1.0)


def test_plan_has_no_cartesian_product(spark):
    incidents = make(spark, random_rows(3))
    for df in (intervals.app_edge_stats(incidents), intervals.overlap_degrees(incidents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_busy_day_is_many_slices(spark):
    """Components of one day spread over all tasks, and each pair still counts once."""
    start = F.timestamp_seconds(F.lit(1_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(3600)))
    df = spark.range(1200).select(F.col("id").alias("incident_id"), (F.col("id") + 1).alias("app_id"), start.alias("from_ts"), start.alias("to_ts"))
    totals = intervals.pair_totals(df, break_ties=True)
    assert totals.agg(F.sum("pairs")).first()[0] == 1200 * 1199 // 2
    spread = totals.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(spread) > 1


def test_totals_are_not_sent_to_all_tasks(spark, tmp_path):
    """The file of the incidents is small, their rows per day and digit are not: the planner must not go by the file."""
    make(spark, random_rows(3)).write.parquet(str(tmp_path / "incidents"))
    degrees = intervals.overlap_degrees(spark.read.parquet(str(tmp_path / "incidents")))
    assert "Broadcast" not in degrees._jdf.queryExecution().sparkPlan().toString()
    assert degrees.where("n_parents + n_children > 0").count() > 0


def test_starts_of_a_day_go_in_slots(spark, monkeypatch):
    """Starts of one day meet running totals of components, not one another, however the day is cut."""
    incidents = make(spark, random_rows(4))
    totals = lambda: sorted((r.src, r.dst, r.pairs, round(r.elapsed, 9)) for r in intervals.pair_totals(incidents).collect())
    whole = totals()
    monkeypatch.setattr(intervals, "SLOT", 3)
    assert totals() == whole and len(whole) > 1
    assert intervals.meeting_points(incidents, levels=0).where("level BETWEEN 0 AND 9").isEmpty()


@pytest.mark.parametrize("cells", [1 << 22, 5])
def test_a_slot_takes_blocks_of_components(monkeypatch, cells):
    monkeypatch.setattr(intervals, "CELLS", cells)
    at, by = [-1, -1, 10, 10, 30, 20], [1, None, 1, 2, None, 2]
    n, s = [2, 1, 1, 3, 2, 1], [0.5, 0.25, 1.0, 3.0, 6.0, 2.0]
    rows = pa.table({"at": pa.array(at), "n": pa.array(n), "s": pa.array(s), "by": pa.array(by, pa.int64())})
    expected = {}
    for c, p in ((c, p) for c in range(6) for p in range(6) if at[c] >= 0 and at[p] < at[c]):
        pairs, days = expected.get((by[p], by[c]), (0, 0.0))
        expected[by[p], by[c]] = pairs + n[p] * n[c], days + s[c] * n[p] - n[c] * s[p]
    got = {(r["src"], r["dst"]): (r["n"], r["elapsed"]) for r in intervals.slot_totals(rows).to_pylist()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_pairs_carry_columns_of_their_ends(spark):
    """The pairs need no join with the incidents, which would shuffle them."""
    rows = random_rows(5)
    severity = {r[0]: r[4] for r in rows}
    incidents = make(spark, rows)
    pairs = intervals.pair_incidents_by_overlap(incidents.where("incident_id % 10 = 0"), incidents, carried=["severity"])
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = pairs.collect()
    assert got and all((r.parent_severity, r.child_severity) == (severity[r.parent], severity[r.child]) for r in got)
