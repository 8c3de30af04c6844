"""Whitening against numpy over all rows."""

import numpy as np
import pytest

from caseweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string"


def brute(rows, k=4, copies=False):
    """{(id, component): (n, deviation, |whitened|, explained)} from whole matrices."""
    kept = [(i, v) for i, v in rows if v is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    xs = [tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for _, v in kept]
    fit = np.array(xs if copies else sorted(set(xs)), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit - s / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for (i, _), x in zip(kept, xs):
        x = np.array(x, dtype=object)
        y = (x - s / n).astype(float) @ u / np.sqrt(e)
        out += [(i, j + 1, n, int(((n * x - s) ** 2).sum()), abs(y[j]), e[j] / np.trace(c.T @ c / n)) for j in range(len(e))]
    return out


def vectors(n=300, d=6, offset=0.0, seed=3):
    draw = np.random.default_rng(seed)
    base = draw.normal(0, 1, (n, d)) @ draw.normal(0, 1, (d, d)) + offset
    return [(i, [float(c) for c in base[i % (n - 40)]]) for i in range(n)]


@pytest.mark.parametrize("weights", ["distinct", "copies"])
@pytest.mark.parametrize("offset", [0.0, 30000.0])
def test_against_numpy(spark, weights, offset):
    rows = vectors(offset=offset) + [(None, None), (7, []), (8, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] * 6), (10, [float("inf")] * 6)]
    rows += [(5, rows[0][1])] * 120 + [(None, rows[1][1])]
    df = spark.createDataFrame([(*r, "old") for r in rows], SCHEMA).repartition(5)
    got = whitening.whiten(df, weights=weights).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 3))
    have = sorted([(r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got], key=key)
    want = sorted(brute(rows, copies=weights == "copies"), key=key)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], abs=1e-6) and a[5] == pytest.approx(b[5], rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_one_sign_for_all_rows(spark):
    rows = vectors()
    got = whitening.whiten(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).where("component = 2").collect()
    x = np.floor(256 * np.array([np.float32(v) for _, v in rows]).astype(float))
    fit = np.unique(x, axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    want = (x - fit.mean(axis=0)) @ u[:, -2] / np.sqrt(e[-2])
    have = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id)])
    assert min(abs(have - want).max(), abs(have + want).max()) < 1e-6


def test_empty_flat_and_ragged(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], SCHEMA)).collect() == []
    rows = [(1, [0.0, 1.0], ""), (2, [1.0, 1.0], ""), (3, [0.0, 0.0, 2.0], ""), (4, [4.0, 0.0, 0.0], "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n, abs(round(r.whitened, 9))) for r in got) == [(i, 1, 2, 1.0) for i in (1, 2, 3, 4)]


def test_values_beyond_a_long(spark):
    rows = [(1, [3e38, 0.0], ""), (2, [-3e38, 1.0], ""), (3, [0.0, 2.0], "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in got)
