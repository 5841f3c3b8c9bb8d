"""Feature engine: pandas parity and the one-exchange plan."""

import numpy as np
from pyspark.sql import functions as F
import pandas as pd
import pytest

from wearline.operators.features import engineer_features


def _pandas_features(pdf, cols):
    out = pdf.copy()
    g = pdf.groupby("unit_number")
    for w in (3, 5):
        for c in cols:
            out[f"{c}_rolling_mean_{w}"] = g[c].rolling(w).mean().reset_index(0, drop=True)
            out[f"{c}_rolling_std_{w}"] = g[c].rolling(w).std().reset_index(0, drop=True)
    for c in cols:
        out[f"{c}_ema"] = g[c].transform(lambda x: x.ewm(span=5, adjust=False).mean())
    out = out.fillna(0)
    g = out.groupby("unit_number")
    out["cycle_norm"] = g["time_in_cycles"].transform(lambda x: x / x.max() if x.max() > 0 else x * 0)
    for c in ["sensor_measurement_4"]:
        out[f"{c}_rate_of_change"] = g[c].diff().fillna(0)
        out[f"{c}_cumsum"] = g[c].cumsum()
    return out


def test_pandas_parity(spark):
    rng = np.random.default_rng(2)
    rows = []
    for u, n in enumerate([1, 2, 3, 5, 97, 98, 300]):
        for t in range(1, n + 1):
            rows.append((u, t, float(rng.normal()), float(rng.normal() * 100)))
    pdf = pd.DataFrame(rows, columns=["unit_number", "time_in_cycles", "sensor_measurement_4", "sensor_measurement_2"])
    cols = ["sensor_measurement_2", "sensor_measurement_4"]
    # shuffled input: order must come from the cycle, not the file
    got = engineer_features(spark.createDataFrame(pdf.sample(frac=1, random_state=1))).toPandas() \
        .sort_values(["unit_number", "time_in_cycles"]).reset_index(drop=True)
    exp = _pandas_features(pdf, cols).reset_index(drop=True)
    for c in exp.columns:
        assert np.allclose(got[c].to_numpy(float), exp[c].to_numpy(float), atol=1e-9), c


def test_plan_nodes(spark):
    """The windows cost one exchange, one sort and one Window operator; the
    prefix scan one Python pass."""
    pdf = pd.DataFrame({"unit_number": [1, 1, 2], "time_in_cycles": [1, 2, 1], "sensor_measurement_4": [1.0, 2.0, 3.0]})
    df = engineer_features(spark.createDataFrame(pdf), include_degradation=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    count = lambda name: sum(line.lstrip(" :+-*()0123456789").startswith(name) for line in plan.splitlines())
    assert (count("Exchange"), count("Sort"), count("Window"), count("MapInArrow")) == (1, 1, 1, 1)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


GAPS = [None, None, 1.0, 2.0, None, 4.0, 5.0, None, None, None, 7.0, -3.0, None]


@pytest.mark.parametrize("span", [5, 200, 1000])
def test_ema_over_gaps_and_wide_spans(spark, span):
    """pandas' averages on series with leading, inner and trailing gaps, one of
    them spread over many partitions (span 5 to 1000)."""
    rng = np.random.default_rng(4)
    series = {0: GAPS, 1: [None] * 7, 2: [3.0], 3: list(np.where(rng.random(4000) < 0.3, np.nan, 100 + rng.normal(size=4000))),
              4: [None] * 900 + [1.0] + [None] * 2500 + [9.0]}
    rows = [(u, t, None if v is None or v != v else float(v)) for u, s in series.items() for t, v in enumerate(s, 1)]
    df = spark.createDataFrame(rows, "unit_number bigint, time_in_cycles bigint, sensor_measurement_4 double")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = engineer_features(df, include_degradation=False, ema_span=span).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    got = got.sort_values(["unit_number", "time_in_cycles"])["sensor_measurement_4_ema"].to_numpy()
    exp = np.concatenate([pd.Series([np.nan if v is None else v for v in s], dtype=float).ewm(span=span, adjust=False).mean().fillna(0)
                          for s in series.values()])
    assert np.allclose(got, exp, rtol=1e-11, atol=1e-11)
    trailing = engineer_features(df.filter("unit_number = 0"), include_degradation=False, ema_span=span, history=6).toPandas()
    trailing = trailing.sort_values("time_in_cycles")["sensor_measurement_4_ema"].to_numpy()
    s = pd.Series([np.nan if v is None else v for v in GAPS], dtype=float)
    want = [s[max(0, i - 5):i + 1].ewm(span=span, adjust=False).mean().fillna(0).iloc[-1] for i in range(len(s))]
    assert np.allclose(trailing, want, rtol=1e-11)


def test_null_keys_stay_apart(spark):
    """A null unit is a unit of its own, not unit 0."""
    rows = [(None, 1, 1.0), (None, 2, 3.0), (0, 1, 10.0), (0, 2, None)]
    df = spark.createDataFrame(rows, "unit_number bigint, time_in_cycles bigint, sensor_measurement_4 double")
    got = {(r.unit_number, r.time_in_cycles): (r.sensor_measurement_4_cumsum, r.cycle_norm) for r in engineer_features(df).collect()}
    assert got == {(None, 1): (1.0, 0.5), (None, 2): (4.0, 1.0), (0, 1): (10.0, 0.5), (0, 2): (10.0, 1.0)}


def test_chunked_equals_single_task(spark):
    """A hot unit (half of all rows) cut into chunks gives the same features."""
    rng = np.random.default_rng(9)
    rows = [(0, t, float(rng.normal()), float(rng.normal() * 50)) for t in range(1, 1201)]
    rows += [(u, t, float(rng.normal()), float(rng.normal() * 50)) for u in range(1, 6) for t in range(1, 121)]
    pdf = pd.DataFrame(rows, columns=["unit_number", "time_in_cycles", "sensor_measurement_4", "sensor_measurement_7"])
    df = spark.createDataFrame(pdf)
    for hist in (None, 10):
        a = engineer_features(df, history=hist).toPandas().sort_values(["unit_number", "time_in_cycles"])
        b = engineer_features(df, history=hist, chunk_rows=150).toPandas() \
            .sort_values(["unit_number", "time_in_cycles"])
        assert list(a.columns) == list(b.columns)
        for c in a.columns:
            assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-12, atol=1e-12), (hist, c)


def by_unit(df, columns=None):
    pdf = df.toPandas()
    return (pdf if columns is None else pdf[columns]).sort_values(["unit_number", "time_in_cycles"]).reset_index(drop=True)


def odd_units(spark):
    """One unit with more than half of the rows, gaps and a huge jump in its
    cycles, a null unit, short units, and nulls among the values."""
    rng = np.random.default_rng(3)
    cycles = np.cumsum(rng.integers(1, 9, 900)) + np.where(np.arange(900) > 500, 10**7, 0)
    rows = [(0, int(t), float(rng.normal() * 40)) for t in cycles]
    rows += [(None, t, float(t)) for t in range(1, 40)] + [(u, t, None if t % 7 == 0 else 2.0 * t) for u in range(1, 9) for t in range(1, 70)]
    return spark.createDataFrame(rows, "unit_number bigint, time_in_cycles bigint, sensor_measurement_4 double")


@pytest.mark.parametrize("chunk_rows", [1, 7, 64, 300])
def test_long_units_give_equal_results(spark, chunk_rows):
    from wearline.operators import labels as LB
    from wearline.operators import policy as PO
    from wearline.operators.features import every_nth_cycle
    df = odd_units(spark)
    whole, cut = LB.compute_rul(df), LB.compute_rul(df, chunk_rows=chunk_rows)
    assert by_unit(whole).equals(by_unit(cut, whole.columns)) and not whole.filter("unit_number IS NULL AND RUL IS NULL").count()
    assert by_unit(every_nth_cycle(df, 5, 7)).equals(by_unit(every_nth_cycle(df, 5, 7, chunk_rows=chunk_rows)))
    rul = whole.withColumn("RUL", F.col("RUL") % 130)
    assert by_unit(PO.logged_steps(rul)).equals(by_unit(PO.logged_steps(rul, chunk_rows=chunk_rows)))
    if chunk_rows > 9:
        for history in (None, 10):
            a, b = by_unit(engineer_features(df, history=history)), by_unit(engineer_features(df, history=history, chunk_rows=chunk_rows))
            assert list(a.columns) == list(b.columns)
            for c in a.columns:
                assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-11, atol=1e-11, equal_nan=True), (history, c)


def test_long_unit_in_several_tasks(spark):
    """A unit of 5,000 rows is dealt to chunks of about 500, with the rows
    before each as ghosts."""
    from wearline.operators.chunks import chunked
    df = spark.range(5000).selectExpr("1L AS unit_number", "id * 3 AS time_in_cycles")
    found = chunked(df, ["unit_number"], "time_in_cycles", back=4, chunk_rows=500)
    sizes = {r._chunk: (r.own, r.ghosts) for r in found.groupBy("_chunk").agg(
        F.sum((~F.col("_ghost")).cast("int")).alias("own"), F.sum(F.col("_ghost").cast("int")).alias("ghosts")).collect()}
    assert len(sizes) == 10 and max(own for own, _ in sizes.values()) <= 520 and sum(own for own, _ in sizes.values()) == 5000
    assert all(4 <= ghosts <= 40 for c, (_, ghosts) in sizes.items() if c) and sizes[0][1] == 0


def test_adapters_number_long_units(spark):
    from tests.conftest import SF001
    from wearline.sources.driver_tables import supplier_telemetry
    a, b = supplier_telemetry(spark, SF001), supplier_telemetry(spark, SF001, chunk_rows=100)
    assert by_unit(a).equals(by_unit(b))


def test_plans_without_joins(spark):
    """No join, no checkpoint and one exchange for short units; trailing
    features without Python."""
    df = odd_units(spark)
    for history, arrow in ((None, 1), (10, 0)):
        plan = engineer_features(df, history=history)._jdf.queryExecution().executedPlan().toString()
        count = lambda name: sum(line.lstrip(" :+-*()0123456789").startswith(name) for line in plan.splitlines())
        assert (count("Exchange"), count("Sort"), count("Window"), count("MapInArrow")) == (1, 1, 1, arrow)
        assert "Join" not in plan and "ExistingRDD[" not in plan.replace("Scan ExistingRDD[unit_number", "")


def test_scan_next_values(spark):
    """The following row's values, across batches, partitions and groups."""
    from wearline.operators.scan import ranked
    rows = [(k, i, float(i * k)) for k in range(1, 4) for i in range(700)] + [(None, 1, 5.0), (9, 1, 6.0)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, v double")
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled"):
        old = spark.conf.get(name)
        spark.conf.set(name, "64" if "arrow" in name else "false")
        try:
            got = ranked(df, ["k"], ["i"], nexts=["v", "i"]).collect()
        finally:
            spark.conf.set(name, old)
        assert {(r.k, r.i): (r.v_next, r.i_next) for r in got} == {
            (k, i): ((float((i + 1) * k), i + 1) if k in (1, 2, 3) and i < 699 else (None, None)) for k, i, _ in rows}


def test_latest_row_of_ties(spark):
    from wearline.operators.features import latest_per_unit
    rows = [(1, 5, float(i)) for i in range(50)]
    cols = "unit_number bigint, time_in_cycles bigint, sensor_measurement_4 double"
    one, = latest_per_unit(spark.createDataFrame(rows, cols)).collect()
    two, = latest_per_unit(spark.createDataFrame(rows[::-1], cols).repartition(7)).collect()
    assert one == two
