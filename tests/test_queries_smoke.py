"""A sample of registered queries against their DuckDB oracle at sf0.001,
and the entry point."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

NAMES = ["rul_compute", "failure_label", "rolling_std", "ema", "horizon_report", "scale_features",
         "variance_report", "describe_columns", "roc_curve", "pr_curve", "optimal_threshold",
         "confusion_matrix", "policy_values", "maintenance_schedule", "undersample", "knn_join",
         "smote_rows", "request_validate", "timeline_table", "stream_features", "action_distribution", "ema_gaps", "ema_span_200",
         "knn_ties", "undersample_null_label", "score_requests_multi", "stream_quarantine"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["lineitem", "events", "embeddings"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(None if (isinstance(v, float) and np.isnan(v)) else v) for v in r)
                  for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF001).toPandas()
    exp = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert _norm(got) == _norm(exp)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "RUL" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = {"rf_score", "rf_balanced_score", "gbt_score", "feature_importance_topk", "common_top_features",
                 "model_selection", "model_selection_halving", "pca_2d", "model_comparison", "train_report", "score_fleet", "score_requests"}
    from wearline.plans import edge_cases, oracle, queries
    q, s = {**queries.QUERIES, **edge_cases.QUERIES}, {**oracle.build(), **edge_cases.ORACLES}
    assert set(q) <= set(E.queries()) and set(s) <= set(E.oracle_sql())
    assert set(s) <= set(q)
    assert set(q) - set(s) == rows_only
