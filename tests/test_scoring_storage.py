"""What scoring leaves on disk and shuffles."""

import os

from pyspark.sql import functions as F

from wearline.plans import score as SCO
from wearline.plans import train as TR
from wearline.session import ensure_checkpoint_dir, shared_path, stored, stored_removed


def _folder(spark):
    return ensure_checkpoint_dir(spark).removeprefix("file:")


def _tables(spark):
    d = _folder(spark)
    return {x for x in os.listdir(d) if x.startswith("wearline-")} if os.path.isdir(d) else set()


def _telemetry(spark, units=12, cycles=40):
    return spark.range(units * cycles).select(
        (F.col("id") % units + 1).alias("unit_number"), (F.floor(F.col("id") / units) + 1).alias("time_in_cycles"),
        *[((F.col("id") * m) % 97 / 7.0).alias(c) for m, c in ((31, "operational_setting_1"), (17, "sensor_measurement_4"),
                                                               (53, "sensor_measurement_7"))])


def test_stored_tables_of_a_block_go_at_its_end(spark):
    kept = stored(spark.range(5), "before")
    with stored_removed(spark):
        own = shared_path(spark, "result")
        assert stored(spark.range(3), "inside").count() == 3
        spark.range(2).write.parquet(own)
    assert kept.count() == 5 and spark.read.parquet(own).count() == 2
    assert not [x for x in _tables(spark) if x.startswith("wearline-inside")]


def test_training_leaves_no_telemetry_and_features(spark):
    before, l = _tables(spark), _telemetry(spark)
    final = l.select("unit_number").distinct().select("unit_number", F.lit(5).cast("bigint").alias("RUL"))
    path = TR.train_pipeline(l, final, shared_path(spark, "run"), forest=dict(numTrees=2, maxDepth=2, seed=1), threshold=20)
    assert os.path.isdir(path.removeprefix("file:"))
    assert all(x.startswith("wearline-run") for x in _tables(spark) - before)


def test_fleet_scores_are_stored_before_the_join(spark):
    l = _telemetry(spark).withColumn("RUL", F.lit(30).cast("bigint") - F.col("time_in_cycles"))
    l = l.unionByName(l.filter("unit_number = 3 AND time_in_cycles < 4"))      # keys that come twice
    feats = SCO.preprocess(l, None, []).withColumn("failure", (F.col("RUL") < 10).cast("bigint"))
    from wearline.operators import features as FE
    from wearline.operators import models as MD
    model = MD.fit_forest(feats, FE.feature_columns(feats), params=dict(numTrees=2, maxDepth=2, seed=1))
    pol = spark.createDataFrame([("healthy", "no_maintenance"), ("failed", "immediate_maintenance")], "state string, recommended_action string")
    out = SCO.score_fleet(l, model, None, [], policy=pol)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "rolling" not in plan
    assert out.count() == 12 * 40 + 3 * 4 - 3      # as an equi-join on (unit, cycle): two rows of a key make four
