"""Ward's tree against its definition, and what must hold beyond the bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.operators import ward

SCHEMA = "id long, vector array<double>"


def brute(rows):
    """The heights of Ward's merges and the groups left after each, by trying every pair."""
    groups, heights, states = [[i] for i in range(len(rows))], [], []
    while len(groups) > 1:
        means, sizes = np.array([rows[g].mean(axis=0) for g in groups]), np.array([len(g) for g in groups])
        cost = 2 * sizes[:, None] * sizes / (sizes[:, None] + sizes) * ((means[:, None] - means) ** 2).sum(axis=2)
        np.fill_diagonal(cost, np.inf)
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        heights.append(np.sqrt(cost[i, j]))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
        states.append({frozenset(g) for g in groups})
    return heights, states


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, r if r is None else [None if x is None else float(x) for x in r]) for i, r in enumerate(rows)], SCHEMA).repartition(parts)


def test_equals_its_definition(spark):
    rows = np.random.default_rng(4).normal(size=(200, 3))
    heights, states = brute(rows)
    vectors = frame(spark, rows, 20)  # more tasks than meet in one round
    found = ward.leaves(vectors, 500)
    tree = ward.merge_tree(found).orderBy("step").collect()
    assert np.allclose([r["height"] for r in tree], heights, rtol=1e-9) and tree[-1]["size"] == 200
    for k in (1, 4, 20, 200):
        groups = {}
        for r in ward.ward_clusters(vectors, k).collect():
            groups.setdefault(r["cluster"], set()).add(r["id"])
        assert {frozenset(g) for g in groups.values()} == (states[199 - k] if k < 200 else {frozenset([i]) for i in range(200)})
        assert sorted(groups) == list(range(k))


def test_bounded_features_keep_the_sum_of_squares(spark):
    draw = np.random.default_rng(5)
    rows = np.concatenate([draw.normal(c, 0.1, size=(150, 2)) for c in ((0, 0), (9, 0), (0, 9), (9, 9))] + [np.zeros((300, 2))])
    for parts in (1, 5):
        vectors = frame(spark, rows, parts)
        found = ward.leaves(vectors, 30)
        assert 4 <= found.count() <= 30 and found.agg(F.sum("n")).first()[0] == 900
        merged = ward.merge_tree(found).agg(F.sum(F.col("height") ** 2 / 2)).first()[0]
        assert np.isclose(found.agg(F.sum("sse")).first()[0] + merged, ((rows - rows.mean(axis=0)) ** 2).sum(), rtol=1e-9)
        groups = {}
        for r in ward.ward_clusters(vectors, 4, 30).collect():
            groups.setdefault(r["cluster"], set()).add(r["id"])
        whole = [set(range(0, 150)) | set(range(600, 900)), *[set(range(a, a + 150)) for a in (150, 300, 450)]]
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, whole))


def test_copies_odd_rows_and_empty_tables(spark):
    rows = [[1, 2], [1, 2], None, [float("nan"), 1], [None, 1], [], [float("inf"), 0], [4, 6], [1, 2]]
    vectors = frame(spark, rows)
    assert [(r["n"], list(r["mean"])) for r in ward.leaves(vectors).orderBy("leaf").collect()] == [(3, [1, 2]), (1, [4, 6])]
    (only,) = ward.merge_tree(ward.leaves(vectors)).collect()
    assert (only["a"], only["b"], only["size"]) == (0, 1, 4) and np.isclose(only["height"], np.sqrt(1.5) * 5)
    assert {(r["id"], r["cluster"]) for r in ward.ward_clusters(vectors, 9).collect()} == {(0, 0), (1, 0), (8, 0), (7, 1)}
    nothing = vectors.limit(0)
    assert ward.merge_tree(ward.leaves(nothing)).count() == 0 and ward.ward_clusters(nothing).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        ward.leaves(frame(spark, [[1, 2], [1, 2, 3]], 1))
