"""Steps whose tasks must stay small as tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import features as FE
from wearline.schema import CYCLE, UNIT


def _rows(spark):
    rng = np.random.default_rng(11)
    rows = [(u, t, None if rng.random() < 0.1 else float(rng.normal() * 50), float(rng.normal()))
            for u, n in enumerate([1, 2, 5, 40, 300, 7]) for t in range(1, n + 1)]
    rows += [(None, 1, 2.0, None), (None, 2, float("nan"), 1.0), (None, 3, 4.0, 1.0)]
    return spark.createDataFrame(rows, f"{UNIT} bigint, {CYCLE} bigint, sensor_measurement_4 double, sensor_measurement_2 double")


@pytest.mark.parametrize("batch", [3, 64])
def test_one_pass_equals_frames(spark, batch):
    """One Arrow pass gives what Spark's frames give, units cut by batches included."""
    from pyspark.sql import Window
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    w = Window.partitionBy(UNIT).orderBy(CYCLE)
    df = _rows(spark)
    exprs = []
    for n in (3, 5):
        for c in ("sensor_measurement_2", "sensor_measurement_4"):
            f = w.rowsBetween(1 - n, 0)
            full = F.count(c).over(f) == n
            exprs += [F.coalesce(F.when(full, F.avg(c).over(f)), F.lit(0.0)).alias(f"{c}_rolling_mean_{n}"),
                      F.coalesce(F.when(full, F.stddev_samp(c).over(f)), F.lit(0.0)).alias(f"{c}_rolling_std_{n}")]
    base = F.coalesce(F.col("sensor_measurement_4"), F.lit(0.0))
    exprs += [F.coalesce(base - F.lag(base).over(w), F.lit(0.0)).alias("sensor_measurement_4_rate_of_change"),
              F.sum(base).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sensor_measurement_4_cumsum")]
    order = [F.col(UNIT).asc_nulls_first(), CYCLE]
    want = df.select(UNIT, CYCLE, *exprs).orderBy(*order).toPandas()
    spark.conf.set(key, str(batch))
    try:
        got = FE.engineer_features(df).orderBy(*order).select(*want.columns).toPandas()
    finally:
        spark.conf.set(key, old)
    for c in want.columns:
        assert np.array_equal(got[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True), c


def test_no_frames_and_compiled_methods(spark):
    """No bounded frame is left, and reading a table keeps methods compilable."""
    from tests.conftest import SF001
    from wearline.sources.driver_tables import table
    for history in (None, 10):
        plan = FE.engineer_features(_rows(spark), history=history)._jdf.queryExecution().optimizedPlan().toString()
        assert "stddev_samp" not in plan and "avg(" not in plan
    table(spark, SF001, "lineitem")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_files_follow_the_rows(spark, monkeypatch):
    """Written sources have as many files as their rows need."""
    from tests.conftest import SF001
    from wearline.plans import queries as Q
    monkeypatch.setattr(Q, "ROWS_PER_FILE", 100)
    rows = spark.read.parquet(f"{SF001}/lineitem.parquet")
    assert Q._parts(spark, SF001, 5) == -(-rows.count() // 100) > 5
    src, _, spread = Q._stream_source(spark, SF001, "stream-src-test")
    assert spread == -(-rows.select("l_suppkey").distinct().count() * 200 // 100) > 2
    assert spark.read.parquet(src).count() == rows.count()
