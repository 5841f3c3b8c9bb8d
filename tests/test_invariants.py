"""Invariants: splits, quarantine, partition independence, late stream rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF001
from wearline.operators import features as FE
from wearline.operators import sampling as SA
from wearline.session import shared_path
from wearline.sources import driver_tables as DT
from wearline.sources import requests as RQ


def test_unit_split_disjoint_exhaustive(spark):
    l = DT.supplier_telemetry(spark, SF001)
    tr, va = SA.unit_split(l, 0.2, 42)
    a = {r[0] for r in tr.select("unit_number").distinct().collect()}
    b = {r[0] for r in va.select("unit_number").distinct().collect()}
    allu = {r[0] for r in l.select("unit_number").distinct().collect()}
    assert not (a & b) and (a | b) == allu and len(b) == max(1, int(len(allu) * 0.2))
    assert tr.count() + va.count() == l.count()


def test_quarantine_complete(spark):
    r = DT.requests(DT.supplier_telemetry(spark, SF001))
    bad = r.withColumn("time_steps", F.slice("time_steps", 1, 3))
    allr = r.unionByName(bad)
    v = RQ.validate_requests(allr)
    assert v.filter("valid = 1").count() + v.filter("valid = 0").count() == allr.count()
    reasons = {r[0]: r[1] for r in v.filter("valid = 0").groupBy("reason").count().collect()}
    assert set(reasons) <= {"too_few_steps", "unit_id"}     # the data has a unit 0
    assert reasons["too_few_steps"] == bad.filter("unit_id >= 1").count()


def test_partition_count_does_not_change_results(spark):
    l = DT.supplier_telemetry(spark, SF001)
    a = FE.engineer_features(l.repartition(3)).toPandas().sort_values(["unit_number", "time_in_cycles"])
    b = FE.engineer_features(l.repartition(17, "time_in_cycles")).toPandas().sort_values(["unit_number", "time_in_cycles"])
    for c in a.columns:
        assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True), c


def test_stream_late_rows_quarantined_and_state_carried(spark):
    from wearline.session import ship_package
    from wearline.streaming.features import stream_features
    ship_package(spark)
    rng = np.random.default_rng(0)
    vals = rng.normal(size=12) * 10
    first = pd.DataFrame({"unit_number": 1, "time_in_cycles": range(1, 11), "sensor_measurement_4": vals[:10]})
    second = pd.DataFrame({"unit_number": 1, "time_in_cycles": [5, 11, 12],
                           "sensor_measurement_4": [99.0, vals[10], vals[11]]})
    src = shared_path(spark, "late-src")
    schema = "unit_number bigint, time_in_cycles bigint, sensor_measurement_4 double"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(src)
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(src)
    out, ck = shared_path(spark, "late-out"), shared_path(spark, "late-ck")
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    try:
        st = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = (stream_features(st, ["sensor_measurement_4"]).writeStream.format("parquet")
             .option("checkpointLocation", ck).trigger(availableNow=True).start(out))
        q.awaitTermination()
    finally:
        spark.conf.set(key, "true")
    res = spark.read.parquet(out).toPandas()
    late = res[res.status == "late"]
    assert late.time_in_cycles.tolist() == [5]
    ok = res[res.status == "ok"].sort_values("time_in_cycles")
    assert ok.time_in_cycles.tolist() == list(range(1, 13))
    batch = FE.engineer_features(spark.createDataFrame(
        pd.DataFrame({"unit_number": 1, "time_in_cycles": range(1, 13), "sensor_measurement_4": vals}), schema)
    ).toPandas().sort_values("time_in_cycles")
    for c in ["sensor_measurement_4_rolling_mean_5", "sensor_measurement_4_rolling_std_3", "sensor_measurement_4_ema",
              "sensor_measurement_4_rate_of_change", "sensor_measurement_4_cumsum"]:
        assert np.allclose(ok[c].to_numpy(), batch[c].to_numpy(), atol=1e-9), c


def test_nan_to_null_at_ingest_and_tuned_threshold(spark):
    from wearline.plans.score import resolve_threshold
    from wearline.sources import artifacts as AR
    from wearline.sources.telemetry import read_telemetry
    p = shared_path(spark, "nan-text")
    spark.createDataFrame([("1 1 0.5 NaN 100 1.0  ",), ("1 2 0.5 0.1",)], "value string").coalesce(1).write.text(p)
    t = read_telemetry(spark, p).orderBy("time_in_cycles").toPandas()
    assert t["operational_setting_2"].isna().iloc[0] and t["sensor_measurement_1"].isna().iloc[1]
    base = shared_path(spark, "thr")
    th = spark.createDataFrame([("random_forest", "L", "m", 0.42)], "model string, dataset string, method string, threshold double")
    AR.save_artifacts(base, "L", "m", thresholds=th, spark=spark)
    assert resolve_threshold("tuned", (base, "L", "m")) == 0.42
    assert resolve_threshold("tuned", (base, "L", "missing")) == 0.5


def test_scaler_fit_on_train_only(spark):
    from wearline.operators import sampling as SA2
    from wearline.plans import train as TR
    l = DT.supplier_telemetry(spark, SF001)
    f_tr, f_va, f_te, stats, removed = TR.prepare_splits(l, DT.final_rul(l), fit_on="train_only")
    train_tel, _ = TR.split_units(l)
    fit_rows = train_tel.join(SA2.validation_units(train_tel, 0.2, 42), "unit_number", "left_anti")
    mx = fit_rows.agg(F.max("sensor_measurement_7")).first()[0]
    got = {r["column"]: r["max"] for r in stats.collect()}
    assert got["sensor_measurement_7"] == mx
    for d in (f_tr, f_va, f_te):
        d.unpersist()


def test_stream_state_gives_pandas_averages_over_gaps():
    """The state function, fed a series with gaps in one, two or many parts."""
    from wearline.streaming.features import make_state_fn

    class State:
        exists, hasTimedOut, value = False, False, None

        @property
        def get(self):
            return self.value

        def update(self, v):
            self.exists, self.value = True, v

    x = np.array([np.nan, 1, 2, np.nan, 4, 5, np.nan, np.nan, 9, np.nan])
    want = pd.Series(x).ewm(span=5, adjust=False).mean().fillna(0).to_numpy()
    for cuts in ([10], [4, 10], list(range(1, 11))):
        fn, _ = make_state_fn(["sensor_measurement_4"], [])
        state, out, a = State(), [], 0
        for z in cuts:
            pdf = pd.DataFrame({"unit_number": 1, "time_in_cycles": np.arange(a, z) + 1, "sensor_measurement_4": x[a:z]})
            out += [d["sensor_measurement_4_ema"].to_numpy() for d in fn((1,), iter([pdf]), state)]
            a = z
        assert np.allclose(np.concatenate(out), want, rtol=1e-12)


def test_keys_and_final_rul_are_checked(spark):
    import pytest
    from wearline.operators import labels as LB
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "unit_number bigint, time_in_cycles bigint")
    with pytest.raises(ValueError, match="share a key"):
        LB.require_unique_keys(rows)
    fine = rows.distinct()
    assert LB.require_unique_keys(fine) is fine
    final = spark.createDataFrame([(1, 10)], "unit_number bigint, RUL bigint")
    with pytest.raises(ValueError, match="final RUL"):
        LB.attach_final_rul(fine, final)
    got = {(r.unit_number, r.time_in_cycles): r.RUL for r in LB.attach_final_rul(fine, final, on_missing="null").collect()}
    assert got == {(1, 1): 11, (1, 2): 10, (2, 1): None}


def test_parts_of_a_folder_are_numbered_through(spark):
    from wearline.sources.telemetry import read_csv_telemetry, read_final_rul
    p, q = shared_path(spark, "parts"), shared_path(spark, "ruls")
    rows = spark.range(40).selectExpr("id", "id * 1.5 AS sensor_measurement_4").repartitionByRange(4, "id").sortWithinPartitions("id")
    rows.drop("id").write.option("header", True).csv(p)
    rows.selectExpr("CAST(id AS STRING)").write.text(q)
    got = read_csv_telemetry(spark, p).select("unit_number", "time_in_cycles", "sensor_measurement_4").collect()
    assert sorted(map(tuple, got)) == [(1, i + 1, i * 1.5) for i in range(40)]
    assert sorted(map(tuple, read_final_rul(spark, q).collect())) == [(i + 1, i) for i in range(40)]


def test_shared_tables_can_be_removed(spark, monkeypatch):
    from wearline import session
    monkeypatch.setattr(session, "_MADE", [])
    path = shared_path(spark, "gone")
    spark.range(3).write.parquet(path)
    shared_path(spark, "never-written")
    assert session.remove_shared(spark) == 1 and session.remove_shared(spark) == 0


def test_score_requests_reads_every_row(spark):
    """Every row of every unit is in a request, and each request (with its
    spoiled copies) has one answer."""
    from wearline.plans import queries
    l = DT.supplier_telemetry(spark, SF001)
    assert RQ.explode_requests(DT.life_requests(l)).count() == l.count()
    want = {f"{r.request_id}-{v}" for r in DT.life_requests(l).select("request_id").collect()
            for v in ("ok", "short", "narrow", "nan", "unit0")}
    got = [r.request_id for r in queries.q_score_requests(spark, SF001).select("request_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_life_queries_match_their_sql(spark):
    import duckdb
    from wearline.plans import edge_cases
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF001}/lineitem.parquet')")
    for name in ("request_explode_life", "request_validate_life", "parse_manual_rows_life"):
        got, want = edge_cases.QUERIES[name](spark, SF001).toPandas(), con.execute(edge_cases.ORACLES[name]).df()
        norm = lambda d: sorted(repr([None if v != v else v for v in r]) for r in d[sorted(d.columns)].itertuples(index=False))
        assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want), name
