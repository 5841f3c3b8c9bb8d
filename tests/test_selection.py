"""Smallest-n selection and exact quantiles against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import sampling as SA
from wearline.operators import selection as SE


@pytest.mark.parametrize("near_rows,cells", [(2000, 1024), (3, 4), (1, 2)])
def test_smallest_by_class(spark, monkeypatch, near_rows, cells):
    """Ties in the hash, rows equal in all keys, a null class, hot classes."""
    monkeypatch.setattr(SE, "NEAR_ROWS", near_rows)
    monkeypatch.setattr(SE, "CELLS", cells)
    rng = np.random.default_rng(cells)
    rows = [(["a", "b", None][min(2, i % 7)], int(rng.integers(0, 60)) * 70_000_000, int(rng.integers(0, 4)) if i % 9 else None, i) for i in range(700)]
    df = spark.createDataFrame(rows, "label string, h bigint, k int, i bigint")
    take = {"a": 37, "b": 100_000, None: 201}
    got = SE.flag_smallest(df, F.col("h"), ["k"], lambda counts: take, "label", "hit").filter("hit").collect()
    for c in ("a", "b", None):
        want = sorted((h, -1 if k is None else k) for x, h, k, _ in rows if x == c)[:take[c]]
        mine = [r for r in got if r.label == c]
        assert sorted((r.h, -1 if r.k is None else r.k) for r in mine) == want and len({r.i for r in mine}) == len(want)
    one = SE.flag_smallest(df, F.col("h"), ["k", "i"], lambda counts: {None: 50}, None, "hit").filter("hit").collect()
    want = sorted((h, -1 if k is None else k, i) for _, h, k, i in rows)[:50]
    assert sorted((r.h, -1 if r.k is None else r.k, r.i) for r in one) == want


def test_selection_sorts_nothing(spark):
    """A split of a table is a projection of it: no exchange, no sort."""
    df = spark.range(1000).selectExpr("id AS k", "id % 3 AS label")
    for out in (SA.row_split(df, ["k"]), SA.undersample(df, "label", ["k"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
    assert SA.row_split(df, ["k"]).filter("split = 'test'").count() == 200
    assert SA.undersample(spark.createDataFrame([], "k int, label int"), "label", ["k"]).collect() == []


def test_labels_must_be_classes(spark):
    with pytest.raises(ValueError, match="not a class label"):
        SE.class_counts(spark.range(2000), "id")


COLUMNS = {
    "steps": lambda rng, n: rng.integers(0, 3, n).astype(float), "normal": lambda rng, n: rng.normal(size=n) * 1e6,
    "wide": lambda rng, n: np.exp(rng.normal(size=n) * 60), "huge": lambda rng, n: rng.choice([-1.7e308, 1.7e308, 1.0, 2.0], n),
    "infinite": lambda rng, n: rng.choice([-np.inf, np.inf, 5.0, 6.0, 7.5], n), "same": lambda rng, n: np.full(n, 4.0),
}


@pytest.mark.parametrize("n,accuracy", [(1, 2000), (2, 2000), (5, 2000), (1000, 2000), (20_000, 30)])
def test_quantiles_are_exact(spark, n, accuracy):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({c: make(rng, n) for c, make in COLUMNS.items()})
    pdf["holes"] = np.where(rng.random(n) < 0.5, np.nan, pdf["normal"])
    df = spark.createDataFrame(pdf).withColumn("holes", F.when(F.rand(1) < 0.5, F.nanvl("holes", F.lit(None))).otherwise(F.col("holes")))
    df = df.withColumn("none", F.lit(None).cast("int"))
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got, _ = SE.exact_quantiles(df, df.columns, qs, accuracy)
    assert not any(c == "none" for c, _ in got)
    for c in pdf.columns:
        v = np.sort(pdf[c].dropna().to_numpy())
        for q in qs if len(v) else ():
            at = (len(v) - 1) * q
            a, b = v[math.floor(at)], v[math.ceil(at)]
            assert got[c, q] == (a if a == b else a + (b - a) * (at - math.floor(at))) or (math.isnan(got[c, q]) and np.isinf([a, b]).any())
