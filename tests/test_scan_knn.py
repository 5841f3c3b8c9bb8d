"""The distributed primitives against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wearline.operators.knn import knn_join
from wearline.operators.scan import ranked


def test_ranked_hot_key_many_partitions(spark):
    rng = np.random.default_rng(1)
    n = 6000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 20, n)),
                        "o": rng.permutation(n), "v": rng.random(n)})
    df = spark.createDataFrame(pdf)
    r = ranked(df, ["k"], ["o"], ["v"], n_parts=13).toPandas().sort_values(["k", "o"])
    exp = pdf.sort_values(["k", "o"])
    assert (r["_rn"].to_numpy() == exp.groupby("k").cumcount().to_numpy() + 1).all()
    assert np.allclose(r["v_cum"].to_numpy(), exp.groupby("k")["v"].cumsum().to_numpy())


def test_ranked_null_and_nan_keys_over_partitions(spark):
    rows = [(None if i % 3 else float("nan") if i % 2 else 1.5, i, 2**60 + i, float(i % 7)) for i in range(900)]
    df = spark.createDataFrame(rows, "k double, o bigint, big bigint, v double")
    r = ranked(df, ["k"], ["o"], ["v"], n_parts=7).toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "o", "big", "v"])
    pdf["g"] = ["null" if a is None else str(a) for a, *_ in rows]
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    pdf["cum"] = pdf.groupby("g")["v"].cumsum()
    r, pdf = r.sort_values("o"), pdf.sort_values("o")
    assert (r["_rn"].to_numpy() == pdf["rn"].to_numpy()).all() and np.allclose(r["v_cum"], pdf["cum"])
    assert r["big"].tolist() == pdf["big"].tolist()


def test_ranked_global_descending(spark):
    df = spark.range(2000).select(((F.col("id") * 7919) % 2000).alias("o"))
    r = ranked(df, [], [F.desc("o")], n_parts=7).toPandas()
    assert (r.sort_values("o", ascending=False)["_rn"].to_numpy() == np.arange(1, 2001)).all()


def test_knn_exact_with_copies_and_hot_cells(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 6))
    X[:60] = X[0]                     # a group of copies (a fifth of the rows)
    ids = np.arange(300)
    pdf = pd.DataFrame({"vec_id": ids, "features": list(X)})
    df = spark.createDataFrame(pdf)
    out = knn_join(df, df, 4, exclude_self=True, max_block=25).toPandas()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    np.fill_diagonal(D, np.inf)
    for i in ids:
        exp = ids[np.lexsort((ids, D[i]))][:4]
        got = out[out.q_id == i].sort_values("rank").s_id.to_numpy()
        assert (got == exp).all(), i


@pytest.mark.parametrize("shift", [0, 17])
def test_knn_ties_of_many_copies(spark, shift):
    """Forty equal vectors and others at equal distances: ties go by id, for
    any order of the rows and with the default block size."""
    X = np.zeros((60, 3))
    X[40:50, 0], X[50:, 1] = 2.0, 2.0
    ids = (np.arange(60) * 7 + shift) % 60
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "features": list(X)}))
    out = knn_join(df, df, 5, exclude_self=True).toPandas()
    assert len(out) == 300
    for n, i in enumerate(ids):
        D = np.sqrt(((X - X[n]) ** 2).sum(1))
        D[n] = np.inf
        assert out[out.q_id == i].sort_values("rank").s_id.tolist() == ids[np.lexsort((ids, D))][:5].tolist()


def test_knn_stores_and_sends_no_row_per_cell(spark):
    """Where no cell can be pruned, what a join stores follows the vectors,
    not the vectors times the cells; results stay exact over forced blocks."""
    import os

    from wearline.session import ensure_checkpoint_dir
    rng = np.random.default_rng(3)
    X = rng.normal(size=(1500, 32))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(1500), "features": list(X)}))
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")

    def size():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    before = size()
    out = knn_join(df, df, 3, exclude_self=True, n_pivots=64, max_block=200).toPandas().sort_values(["q_id", "rank"])
    assert size() - before < 5 * X.nbytes
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    np.fill_diagonal(D, np.inf)
    assert (out.s_id.to_numpy().reshape(1500, 3) == np.argsort(D, axis=1, kind="stable")[:, :3]).all()


def test_knn_blocks_hold_at_most_so_many_rows():
    from wearline.operators.knn import _near_order, _pack
    rng = np.random.default_rng(4)
    count = rng.integers(0, 300, 50)
    packed = _pack(count, _near_order(rng.normal(size=(50, 3))), 200)
    assert sorted(c for c, _, _ in packed) == list(range(50))
    held: dict = {}
    for c, first, parts in packed:
        for i in range(parts):
            held.setdefault(first + i, []).append((int(count[c]), parts))
    assert all(sum(-(-n // p) for n, p in cells) <= 200 for cells in held.values())
