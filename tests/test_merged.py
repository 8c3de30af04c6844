"""The stored table of latest rows."""

from caseweave.operators import relational
from caseweave.sources.merged import MergedTable

SCHEMA = "id LONG, at LONG, value STRING"


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    table = MergedTable(spark, f"file://{tmp_path}/t", ["id"], ["at"], buckets=8)
    old = [(i, 1, f"old{i}") for i in range(60)] + [(None, 1, "nobody")]
    table.create(spark.createDataFrame(old, SCHEMA))
    files = {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    new = [(3, 2, "new3"), (3, 0, "late"), (100, 5, "added"), (None, 2, "still nobody")]
    touched = table.merge(spark.createDataFrame(new, SCHEMA))
    assert 0 < len(touched) <= 3
    after = {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    same = [p for p in files if not any(f"bucket={b}/" in p for b in touched)]
    assert same and all(after[p] == files[p] for p in same)
    want = {i: f"old{i}" for i in range(60)} | {3: "new3", 100: "added", None: "still nobody"}
    rows = table.read().collect()
    assert {r.id: r.value for r in rows} == want and len(rows) == len(want)
    assert table.merge(spark.createDataFrame(new, SCHEMA)) == touched and table.read().count() == len(want)
    assert table.merge(spark.createDataFrame([], SCHEMA)) == []


def test_ties_are_decided(spark):
    rows = [(1, 5, v) for v in "bca"] + [(1, 4, "z")]
    for seed in range(3):
        df = spark.createDataFrame(rows[seed:] + rows[:seed], SCHEMA).repartition(4)
        assert [r.value for r in relational.upsert_by_id(df, ["id"], ["at"]).collect()] == ["c"]
