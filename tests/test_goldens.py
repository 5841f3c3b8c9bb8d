"""Golden values derived from the reference's published numbers."""

import pytest

from wearline.operators import metrics as MT
from wearline.operators import policy as PO

# the exploration notebook's deterministic MDP
MDP = [
    ("healthy", "no_maintenance", "moderate_wear", 10), ("healthy", "maintenance", "healthy", -5),
    ("moderate_wear", "no_maintenance", "severe_wear", -20), ("moderate_wear", "maintenance", "healthy", -5),
    ("severe_wear", "no_maintenance", "failed", -50), ("severe_wear", "maintenance", "moderate_wear", -10),
    ("failed", "no_maintenance", "failed", -100), ("failed", "maintenance", "failed", -100),
]


def test_notebook_q_table(spark):
    q = {(r.state, r.action): r.q for r in PO.policy_from_mdp(spark, MDP).collect()}
    assert round(q[("healthy", "no_maintenance")], 2) == 28.95
    assert round(q[("healthy", "maintenance")], 2) == 21.05
    assert round(q[("moderate_wear", "no_maintenance")], 2) == -11.95
    assert round(q[("moderate_wear", "maintenance")], 2) == 21.05
    assert round(q[("severe_wear", "no_maintenance")], 2) == -50.0
    assert round(q[("severe_wear", "maintenance")], 2) == 8.95
    assert q[("failed", "no_maintenance")] == 0 and q[("failed", "maintenance")] == 0
    pol = {r.state: r.recommended_action for r in
           PO.greedy_policy(PO.policy_from_mdp(spark, MDP), ["no_maintenance", "maintenance"]).collect()}
    assert pol["healthy"] == "no_maintenance" and pol["moderate_wear"] == "maintenance"


def test_report_row_from_confusion(spark):
    c = spark.createDataFrame([(2527, 3241, 50, 7278)], "tp bigint, fp bigint, fn bigint, tn bigint")
    m = MT.metrics_from_counts(c).first()
    assert m.accuracy == pytest.approx(0.7487018937080024, abs=1e-15)
    assert m.precision == pytest.approx(0.4381067961165049, abs=1e-15)
    assert m.recall == pytest.approx(0.9805975941016686, abs=1e-15)
    assert m.f1_score == pytest.approx(0.6056321150389454, abs=1e-15)


def test_cost_benefit_golden(spark):
    c = spark.createDataFrame([(2527, 3241, 50, 7278)], "tp bigint, fp bigint, fn bigint, tn bigint")
    r = MT.cost_benefit(c).first()
    assert r.scheduled_maintenance_cost == 57_680_000
    assert r.unexpected_failure_cost == 5_000_000
    assert r.total_cost == 62_680_000
    assert r.avoided_failure_cost == 227_430_000
    assert r.net_benefit == 195_020_000
    assert r.roi_percent == pytest.approx(338.107, abs=1e-3)


def test_auc_ties_and_empty_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "failure int, probability double")
    # pairs: (0.9+,0.9-) tie 0.5, (0.9+,0.1-) 1, (0.5+,0.9-) 0, (0.5+,0.1-) 1 -> 2.5/4
    assert MT.roc_auc(df).first()[0] == pytest.approx(0.625)
    one = spark.createDataFrame([(1, 0.9), (1, 0.5)], "failure int, probability double")
    assert MT.roc_auc(one).first()[0] is None


def test_histogram_matches_numpy(spark):
    import numpy as np
    import pandas as pd
    from wearline.operators.profile import histogram
    rng = np.random.default_rng(7)
    x = np.r_[rng.integers(0, 700, 5000), [0, 699, 699]].astype(float)
    df = spark.createDataFrame(pd.DataFrame({"RUL": x}))
    got = histogram(df, "RUL", 50).orderBy("bin").toPandas()
    counts, edges = np.histogram(x, bins=50)
    assert got["count"].tolist() == counts.tolist()
    assert np.allclose(got["lo"].to_numpy(), edges[:-1]) and np.allclose(got["hi"].to_numpy(), edges[1:])
