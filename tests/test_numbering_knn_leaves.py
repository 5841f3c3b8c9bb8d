"""Row numbers without Python tasks, and neighbours searched by leaves."""

import numpy as np
import pytest

from wearline.operators import knn as K
from wearline.operators import sampling as SA


def test_rows_are_numbered_in_order_without_python(spark):
    rows = [(None, None, "n"), (None, 3, "m")] + [(i * 7 % 40, i % 3, str(i)) for i in range(300)] + [(5, 1, "again")] * 3
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(7)
    got = SA.numbered(df, ["a", "b"], "nr")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan
    out = sorted(map(tuple, got.union(got.limit(0)).collect()), key=lambda r: r[3])
    assert got.columns == ["a", "b", "c", "nr"] and [r[3] for r in out] == list(range(1, len(rows) + 1))
    key = lambda r: tuple((x is not None, x or 0) for x in r[:2])
    assert [key(r) for r in out] == sorted(map(key, rows))
    assert sorted(r[:3] for r in out if r[0] is not None) == sorted(r for r in rows if r[0] is not None)
    assert SA.numbered(df.filter("a > 99"), ["a"], "nr").count() == 0


def _bounds(S, kk, n=20):
    piv = S[:n]
    D = K._cdist(S, piv)
    c = D.argmin(1)
    radius = np.full(n, -np.inf)
    np.maximum.at(radius, c, D[np.arange(len(c)), c])
    return K._Bounds(piv, np.partition(D, kk - 1, axis=0)[kk - 1], np.bincount(c, minlength=n), radius)


@pytest.mark.parametrize("dims", [1, 3, 20])
def test_leaves_give_the_nearest_and_skip_most_rows(monkeypatch, dims):
    rng, kk = np.random.default_rng(dims), 4
    S = np.unique(np.round(rng.random((20_000 if dims == 3 else 3000, dims)), 2), axis=0)
    rng.shuffle(S)
    Q = np.vstack([S, rng.random((100, dims)), np.full((1, dims), np.nan)])
    bounds, looked = _bounds(S, kk), []
    rows_of = K._rows_of
    monkeypatch.setattr(K, "_rows_of", lambda *a: (looked.append(len(rows_of(*a))), rows_of(*a))[1])
    q, s, d = K._block_topk(Q, np.arange(len(Q)), S, np.arange(len(S)), np.arange(len(S) + 1), kk, bounds)
    n = len(Q) - 1
    assert sorted(set(q.tolist())) == list(range(n))
    for i in range(0, n, 1 + n // 300):
        exact = np.sqrt(((S - Q[i]) ** 2).sum(1))
        want = np.lexsort((np.arange(len(S)), exact))[:kk]
        assert s[q == i].tolist() == want.tolist()
        assert d[q == i].tolist() == exact[want].tolist()
    if dims == 3:
        assert sum(looked) * K.LEAF_ROWS < 0.4 * len(S) * len(Q)


def test_a_data_row_that_is_no_number_hides_none(spark):
    rng, kk = np.random.default_rng(9), 3
    S = rng.random((500, 3))
    bounds, spoiled = _bounds(S, kk), np.vstack([S, np.full((1, 3), np.nan)])
    args = (np.arange(501), np.arange(502), kk, bounds)
    a = K._block_topk(S, np.arange(500), S, np.arange(500), np.arange(501), kk, bounds)
    b = K._block_topk(S, np.arange(500), spoiled, *args)
    assert all(sorted(x.tolist()) == sorted(y.tolist()) for x, y in zip(a, b))
