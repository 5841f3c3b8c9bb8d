"""Run manifests, the racing search, and the latest-risk tables."""

import os

import pytest
from pyspark.sql import functions as F

from wearline.operators import models as MD
from wearline.plans import train as TR
from wearline.session import shared_path
from wearline.sources import artifacts as AR
from wearline.streaming import risk as SR


def local(path):
    return path.removeprefix("file:")


def table(spark, n=240):
    return spark.range(n).select(
        (F.col("id") % 12 + 1).alias("unit_number"), (F.floor(F.col("id") / 12) + 1).cast("bigint").alias("time_in_cycles"),
        (F.col("id") * 7 % 31).cast("double").alias("a"), (F.col("id") * 5 % 17).cast("double").alias("b"),
        (F.col("id") * 7 % 31 > 18).cast("bigint").alias("failure"))


def write(spark, base):
    t = table(spark)
    model = MD.fit_forest(t, ["a", "b"], params=dict(numTrees=2, maxDepth=3, seed=1))
    scaler = spark.createDataFrame([("a", 0.0, 1.0)], "column string, min double, max double")
    result = spark.createDataFrame([(0.5,)], "accuracy double")
    return TR.write_run(base, model, 0.25, result, ["a", "b"], scaler, ["x"])


def test_run_is_loaded_through_its_manifest(spark):
    base = shared_path(spark, "runs")
    assert AR.latest_run(spark, base, "L", "cost_sensitive") is None
    report = write(spark, base)
    run = AR.latest_run(spark, base, "L", "cost_sensitive")
    assert report == f"{run}/report"
    assert AR.load_threshold(spark, run, "L", "cost_sensitive") == 0.25
    assert AR.load_removed(spark, run, "L", "cost_sensitive") == ["x"]
    assert AR.load_model(run, "L", "cost_sensitive").stages[-1].getNumTrees == 2
    write(spark, base)
    assert AR.latest_run(spark, base, "L", "cost_sensitive") > run


def test_broken_run_is_never_loaded(spark, monkeypatch):
    base = shared_path(spark, "runs")
    write(spark, base)
    run = AR.latest_run(spark, base, "L", "cost_sensitive")

    def fail(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(MD, "feature_importances", fail)
        with pytest.raises(RuntimeError, match="lost"):
            write(spark, base)
    assert len(os.listdir(f"{local(base)}/runs/L_cost_sensitive")) == 2
    assert AR.latest_run(spark, base, "L", "cost_sensitive") == run
    with pytest.raises(FileNotFoundError, match="absent"):
        AR.publish_run(spark, base, "L", "cost_sensitive", run, ["report", "absent"])
    assert AR.latest_run(spark, base, "L", "cost_sensitive") == run


def test_forest_defaults_to_the_reference_preset():
    assert (MD.REFERENCE_FOREST["numTrees"], MD.REFERENCE_FOREST["maxDepth"]) == (500, 30)
    assert (MD.QUERY_FOREST["numTrees"], MD.QUERY_FOREST["maxDepth"]) == (50, 12)


def test_halving_drops_the_weak_and_spends_trees_on_the_rest(spark):
    t = table(spark)
    r = MD.halving_search(t, ["a", "b"], folds=2, grid={"maxDepth": [1, 4], "minInstancesPerNode": [1, 100]}, trees=(2, 4, 6)).toPandas()
    assert r.groupby("rung").size().tolist() == [4, 2, 1]
    assert r.groupby("rung").numTrees.first().tolist() == [2, 4, 6]
    for rung, g in r.groupby("rung"):
        assert g[g.kept].mean_auc.min() >= g[~g.kept].mean_auc.max() if (~g.kept).any() else len(g) == 1
        later = r[r.rung == rung + 1]
        if len(later):
            keys = ["maxDepth", "minInstancesPerNode"]
            assert sorted(map(tuple, g[g.kept][keys].values)) == sorted(map(tuple, later[keys].values))
    assert r[r.rung == 2].minInstancesPerNode.tolist() == [1]


def batch(spark, rows):
    return spark.createDataFrame(rows, "unit_number bigint, time_in_cycles bigint, v double")


def state(spark, base):
    return sorted(map(tuple, SR.latest_risk(spark, base).select("unit_number", "time_in_cycles", "probability").collect()))


def names(base, kind):
    path = f"{local(base)}/{kind}"
    return sorted(int(n[2:]) for n in os.listdir(path) if n.startswith("v=")) if os.path.isdir(path) else []


def test_latest_risk_deltas_compaction_and_replay(spark):
    base = shared_path(spark, "risk")
    run = SR.make_batch_fn(base, ["v"], lambda d: d.withColumn("probability", F.col("v") / 100), compact_every=3)
    run(batch(spark, [(u, 1, 1.0) for u in range(1, 201)]), 0)
    want = {u: (1, 0.01) for u in range(1, 201)}
    for epoch in range(1, 9):
        rows = [(epoch, epoch + 1, float(epoch)), (epoch, epoch, 50.0), (epoch + 1, 1, 0.5), (0, 1, 1.0), (5, None, 1.0)]
        want[epoch] = (epoch + 1, epoch / 100)
        run(batch(spark, rows), epoch)
        # the delta holds the batch's units only, whatever the table holds
        assert spark.read.parquet(f"{base}/delta/v={epoch:012d}").count() == 2
        once = state(spark, base)
        assert once == sorted((u, c, p) for u, (c, p) in want.items())
        run(batch(spark, rows), epoch)
        assert state(spark, base) == once
    assert names(base, "latest") == [5, 8]
    assert names(base, "delta") == [6, 7, 8]
    assert SR.quarantined(spark, base).count() == 16


def test_latest_risk_with_a_broken_compaction(spark):
    base = shared_path(spark, "risk")
    run = SR.make_batch_fn(base, ["v"], lambda d: d.withColumn("probability", F.col("v") / 100), compact_every=2)
    for epoch in range(4):
        run(batch(spark, [(1, epoch, float(epoch)), (epoch + 2, epoch, 9.0)]), epoch)
    once = state(spark, base)
    os.remove(f"{local(base)}/latest/v={3:012d}/_SUCCESS")
    assert state(spark, base) == once
    run(batch(spark, [(1, 3, 3.0), (5, 3, 9.0)]), 3)
    assert state(spark, base) == once
    assert names(base, "latest") == [1, 3]


def test_latest_risk_of_equal_cycles_is_the_greater(spark):
    base = shared_path(spark, "risk")
    run = SR.make_batch_fn(base, ["v"], lambda d: d.withColumn("probability", F.col("v") / 100))
    run(batch(spark, [(1, 4, 3.0), (1, 4, 7.0)]), 0)
    run(batch(spark, [(1, 4, 5.0)]), 1)
    assert state(spark, base) == [(1, 4, 0.07)]


def test_selection_fits_each_candidate_once_per_fold_and_caches_no_fold(spark, monkeypatch):
    """No refit on all rows, no cached folds, one partition per core at most."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from wearline.operators import models as MD
    df = spark.range(400).select((F.col("id") % 20).alias("unit_number"), (F.col("id") * 37 % 101).cast("double").alias("x"),
                                 (F.col("id") * 37 % 101 > 50).cast("bigint").alias("failure")).repartition(50)
    fits, cached = [], []
    fit = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, d: (fits.append(d.rdd.getNumPartitions()), fit(self, d))[1])
    monkeypatch.setattr(DataFrame, "cache", lambda self: (cached.append(1), self)[1])
    out = MD.model_selection(df, ["x"], folds=2, grid={"numTrees": [2, 3], "maxDepth": [2]}).collect()
    assert len(out) == 2 and all(0.9 < r["mean_auc"] <= 1 for r in out)
    assert len(fits) == 4 and max(fits) <= spark.sparkContext.defaultParallelism and not cached


def test_stored_reads_back_and_restores_the_setting(spark):
    from pyspark.sql import functions as F

    from wearline.session import stored
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    t = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert t.count() == 7 and spark.conf.get(key, None) == before
