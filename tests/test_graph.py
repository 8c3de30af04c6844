import pytest
from pyspark.sql import functions as F

from caseweave.operators import graph, ordering
from caseweave.session import stage

EDGES = [(1, 2, 0.5), (2, 3, 0.25), (3, 1, 0.2), (1, 1, 0.1), (2, 4, 0.3)]


def brute_rank(edges, tol, reset=0.15):
    nodes = {n for e in edges for n in e[:2]}
    rank = {n: reset for n in nodes}
    delta, got = dict(rank), set(nodes)
    while any(n in got and delta[n] > tol for n in nodes):
        inbox = {}
        for u, v, w in edges:
            if u in got and delta[u] > tol:
                inbox[v] = inbox.get(v, 0.0) + delta[u] * w
        for n in nodes:
            delta[n] = (1 - reset) * inbox.get(n, 0.0)
            rank[n] += delta[n]
        got = set(inbox)
    return rank


def edge_frame(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src LONG, dst LONG, weight DOUBLE")


def test_weighted_rank_until_settled(spark):
    got = {r.id: r["rank"] for r in graph.weighted_page_rank(edge_frame(spark)).collect()}
    assert got == pytest.approx(brute_rank(EDGES, 0.001))
    assert min(got.values()) >= 0.15


def test_page_rank_uses_equal_shares(spark):
    degree = {1: 2, 2: 2, 3: 1}
    shares = [(u, v, 1 / degree[u]) for u, v, _ in EDGES]
    got = {r.id: r["rank"] for r in graph.page_rank(edge_frame(spark)).collect()}
    assert got == pytest.approx(brute_rank(shares, 0.001))


def test_rank_that_does_not_settle_is_an_error(spark):
    with pytest.raises(RuntimeError):
        graph.weighted_page_rank(edge_frame(spark, [(1, 2, 2.0), (2, 1, 2.0)]), max_iter=5)


def test_prune_weak_edges(spark):
    edges = edge_frame(spark, [(i, i + 1, w) for i, w in enumerate([0.1, 0.2, 0.2, 0.4, 0.5])])
    # the lowest two of five weights are 0.1 and 0.2
    assert sorted(r.weight for r in ordering.prune_weak_edges(edges).collect()) == [0.4, 0.5]
    assert ordering.prune_weak_edges(edges, fraction=0.1).count() == 5


@pytest.mark.parametrize("values,percent,expected", [([3.0], 50, 3.0), ([1.0, 2.0], 1, 1.0), ([1.0, 2.0], 99, 2.0), ([1.0, 2.0, 4.0], 50, 2.0), ([1.0, 2.0, 4.0, 8.0], 50, 3.0)])
def test_percentile_r6(spark, values, percent, expected):
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    assert ordering.percentile_r6(df, "v", percent).first()[0] == pytest.approx(expected)


def test_positions_are_global_and_per_group(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS g", "id * 7919 % 1000 AS x").repartition(5)
    rows = ordering.positions(df, ["g"], [F.col("x"), F.col("id")]).collect()
    for g in range(3):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: (r.x, r.id))
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))


def test_spread(spark):
    nodes = spark.createDataFrame([(1, True), (2, False), (3, False), (4, False)], "id LONG, failed BOOLEAN")
    edges = spark.createDataFrame(
        [(1, 2, 12.0), (1, 3, 9.0), (2, 3, 25.0), (2, 1, 30.0), (3, 4, 40.0), (2, 4, 15.0)], "src LONG, dst LONG, avg_days DOUBLE"
    )
    got = {r.id: (r.time, r.round) for r in graph.spread_from_failed(nodes, edges).collect()}
    # 1→3 takes less than the lag; 2→4 starts too late
    assert got == {1: (0.0, 0), 2: (12.0, 1), 3: (37.0, 2), 4: (None, None)}


def test_stage_keeps_rows_and_types(spark):
    df = spark.range(5).selectExpr("id", "array(id) AS a", "map('k', id) AS m")
    staged = stage(df)
    assert staged.dtypes == df.dtypes and staged.count() == 5
