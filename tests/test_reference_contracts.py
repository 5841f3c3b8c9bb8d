"""The reference's own unit-test contracts, as Spark tests."""

import pandas as pd
from pyspark.sql import functions as F

from wearline.operators import labels as LB
from wearline.operators import metrics as MT
from wearline.operators import models as MD
from wearline.operators import sampling as SA
from wearline.operators import scaling as SC
from wearline.schema import telemetry_columns


def test_headers():
    cols = telemetry_columns()
    assert len(cols) == 31
    assert cols[:2] == ["unit_number", "time_in_cycles"]
    assert cols[2] == "operational_setting_1" and cols[-1] == "sensor_measurement_26"


def test_rul(spark):
    df = spark.createDataFrame(pd.DataFrame({"unit_number": [1, 1, 1, 2, 2], "time_in_cycles": [1, 2, 3, 1, 2]}))
    out = LB.compute_rul(df).orderBy("unit_number", "time_in_cycles").toPandas()
    assert out["RUL"].tolist() == [2, 1, 0, 1, 0]


def test_label(spark):
    df = spark.createDataFrame(pd.DataFrame({"RUL": [100, 50, 30, 10]}))
    out = LB.label_failure(df, 50)
    assert dict(out.dtypes)["failure"] == "bigint"
    assert [r[0] for r in out.select("failure").collect()] == [0, 1, 1, 1]


def test_constant_columns_removed(spark):
    df = spark.createDataFrame(pd.DataFrame({"unit_number": [1, 2, 3], "const_feature": [1, 1, 1],
                                             "variable_feature": [1, 2, 3], "RUL": [100, 50, 25]}))
    removed = SC.removed_columns(SC.variance_report(df))
    assert removed == ["const_feature"]
    kept = SC.drop_columns(df, removed).columns
    assert "RUL" in kept and "variable_feature" in kept and "const_feature" not in kept


def _classification_frame(spark, n=100, pos_share=0.5, seed=0):
    import numpy as np
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 10))
    y = (rng.random(n) < pos_share).astype(int)
    X[:, 0] += 2 * y
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(10)])
    pdf["failure"] = y
    pdf["unit_number"] = range(n)
    pdf["time_in_cycles"] = 1
    return spark.createDataFrame(pdf)


def test_forest_fit_predict(spark):
    df = _classification_frame(spark)
    train, test = df.filter("unit_number < 80"), df.filter("unit_number >= 80")
    feats = [f"f{i}" for i in range(10)]
    model = MD.fit_forest(train, feats, params=dict(numTrees=10, maxDepth=4, seed=42))
    out = MD.predict(model, test).toPandas()
    assert len(out) == 20
    assert out["probability"].between(0, 1).all()
    probs = model.transform(test).select("probability").toPandas()["probability"]
    assert all(abs(sum(v) - 1) < 1e-9 for v in probs)


def test_evaluate_keys(spark):
    df = _classification_frame(spark).withColumn("prediction", (F.col("f0") > 1).cast("bigint")) \
        .withColumn("probability", F.col("f0"))
    m = MT.binary_metrics(df, score="probability")
    assert {"accuracy", "precision", "recall", "f1_score", "roc_auc"} <= set(m.columns)


def test_imbalance_equal_counts(spark):
    df = _classification_frame(spark, pos_share=0.1, seed=3)
    counts = SA.class_counts(df, "failure")
    us = SA.class_counts(SA.undersample(df, "failure", ["unit_number"]), "failure")
    assert us[0] == us[1] == min(counts.values())
    vec = df.select(F.col("unit_number").alias("id"), F.array(*[f"f{i}" for i in range(10)]).alias("v"), "failure")
    syn = SA.smote(vec, "failure", "id", "v")
    after = SA.class_counts(vec.select("failure").unionByName(syn.select("failure")), "failure")
    assert after[0] == after[1] == max(counts.values())
