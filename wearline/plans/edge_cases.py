"""Registered queries on the given tables, spoiled by rules on their keys:
gaps, wide spans, ties, null labels, several requests per unit, replayed
stream batches; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.operators import features as FE
from wearline.operators import knn as KN
from wearline.operators import labels as LB
from wearline.operators import sampling as SA
from wearline.plans import score as SCO
from wearline.plans.oracle import KNN_V, L, VALUE_COLS, VEC, h, req_values
from wearline.schema import CYCLE, UNIT
from wearline.session import shared_path
from wearline.sources import driver_tables as DT
from wearline.sources import requests as RQ
from wearline.sources.requests import REQUEST
from wearline.streaming import risk as SR

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn
    return register


# ---- averages over gaps and wide spans -----------------------------------------------

GAP = "((unit_number * 31 + time_in_cycles * 17) % 5 < 2 OR time_in_cycles <= unit_number % 4)"


def _ema_sql(x: str, span: int) -> str:
    d, a = f"({span - 1}.0 / {span + 1}.0)::DOUBLE", f"(2.0 / {span + 1}.0)::DOUBLE"
    return f"""WITH RECURSIVE {L}, S AS MATERIALIZED (SELECT unit_number AS u, time_in_cycles AS c, {x} AS x FROM L),
X AS (SELECT u, c, x AS v, 1.0::DOUBLE AS w FROM S WHERE c = 1
  UNION ALL SELECT S.u, S.c,
    CASE WHEN S.x IS NULL THEN X.v WHEN X.v IS NULL THEN S.x ELSE (X.w * {d} * X.v + {a} * S.x) / (X.w * {d} + {a}) END,
    CASE WHEN S.x IS NOT NULL OR X.v IS NULL THEN 1.0 ELSE X.w * {d} END
  FROM X JOIN S ON S.u = X.u AND S.c = X.c + 1)
SELECT u AS unit_number, c AS time_in_cycles, round(coalesce(v, 0), 4) AS ema FROM X"""


def _ema(df, column, span):
    f = FE.engineer_features(df.select(UNIT, CYCLE, column), include_degradation=False, ema_span=span)
    return f.select(UNIT, CYCLE, F.round(f"{column}_ema", 4).alias("ema"))


@query("ema_gaps", _ema_sql(f"CASE WHEN NOT {GAP} THEN sensor_measurement_7 END", 5))
def ema_gaps(spark, sf):
    """Leading and inner gaps in every unit's series."""
    spoiled = F.when(~F.expr(GAP), F.col("sensor_measurement_7")).alias("sensor_measurement_7")
    return _ema(DT.supplier_telemetry(spark, sf).select(UNIT, CYCLE, spoiled), "sensor_measurement_7", 5)


@query("ema_span_200", _ema_sql("sensor_measurement_7", 200))
def ema_span_200(spark, sf):
    return _ema(DT.supplier_telemetry(spark, sf), "sensor_measurement_7", 200)


# ---- ties and null keys --------------------------------------------------------------

@query("knn_ties", f"""WITH {VEC}, V3 AS (SELECT vec_id + 100000 * c AS vec_id, features FROM V, (SELECT unnest([0, 1, 2]) AS c)),
{KNN_V.format(src='V3')}
SELECT q_id AS vec_id, s_id AS neighbor_id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM NN""")
def knn_ties(spark, sf):
    """Every vector three times, under new ids."""
    v = DT.vectors(spark, sf).select("vec_id", "features")
    three = v.select(F.explode(F.array(*[F.col("vec_id") + 100000 * c for c in range(3)])).alias("vec_id"), "features")
    nn = KN.knn_join(three, three, 5, exclude_self=True)
    return nn.select(F.col("q_id").alias("vec_id"), F.col("s_id").alias("neighbor_id"), "rank", F.round("distance", 6).alias("distance"))


@query("undersample_null_label", f"""WITH {L}, B AS (SELECT unit_number, time_in_cycles,
  CASE (unit_number + time_in_cycles) % 6 WHEN 0 THEN 1 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 0 END::BIGINT AS label FROM L),
NM AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM B GROUP BY label)),
US AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h('unit_number', 'time_in_cycles')}, unit_number, time_in_cycles) AS rn FROM B)
SELECT unit_number, time_in_cycles, coalesce(label, -1) AS label FROM US, NM WHERE rn <= n""")
def undersample_null_label(spark, sf):
    """Null is a class of its own (shown as -1)."""
    k = (F.col(UNIT) + F.col(CYCLE)) % 6
    label = F.when(k == 0, 1).when(k <= 2, None).otherwise(0).cast("bigint")
    kept = SA.undersample(DT.supplier_telemetry(spark, sf).select(UNIT, CYCLE, label.alias("label")), "label", [UNIT, CYCLE], 42)
    return kept.withColumn("label", F.coalesce("label", F.lit(-1).cast("bigint")))


# ---- several requests of one unit ----------------------------------------------------

LIFE = f"""Q AS (SELECT unit_number AS u, (time_in_cycles - 1) // 10 AS p, (time_in_cycles - 1) % 10 AS step,
  {', '.join(f'{v} AS v{i}' for i, v in enumerate(req_values()))} FROM L)"""


@query("request_explode_life", f"""WITH {L}, {LIFE}
SELECT u || '-' || p AS request_id, u AS unit_number, CAST(step + 1 AS BIGINT) AS time_in_cycles,
  {', '.join(f'CAST(v{i} AS DOUBLE) AS {c}' for i, c in enumerate(VALUE_COLS))} FROM Q""")
def request_explode_life(spark, sf):
    """Every row of every unit, in requests of ten steps."""
    return RQ.explode_requests(DT.life_requests(DT.supplier_telemetry(spark, sf)))


@query("request_validate_life", f"""WITH {L}, {LIFE}, A AS (SELECT u, p, count(*) AS n FROM Q GROUP BY u, p),
V AS (SELECT u || '-' || p AS request_id, CASE WHEN v = 'unit0' THEN 0 ELSE u END AS unit_id, v AS variant,
  CASE WHEN v = 'short' THEN least(n - 1, 4) ELSE n END AS n FROM A, (SELECT unnest(['ok', 'short', 'narrow', 'nan', 'unit0']) AS v)),
R AS (SELECT *, CASE WHEN unit_id < 1 THEN 'unit_id' WHEN n < 5 THEN 'too_few_steps' WHEN variant = 'narrow' THEN 'step_width'
  WHEN variant = 'nan' THEN 'non_finite' END AS reason FROM V)
SELECT request_id, CAST(unit_id AS BIGINT) AS unit_id, variant, CAST(reason IS NULL AS BIGINT) AS valid, reason FROM R""")
def request_validate_life(spark, sf):
    from wearline.plans.queries import spoiled
    req = spoiled(DT.life_requests(DT.supplier_telemetry(spark, sf)))
    return RQ.validate_requests(req).select(REQUEST, "unit_id", "variant", "valid", "reason")


@query("parse_manual_rows_life", f"""WITH {L}, {LIFE},
S AS (SELECT u || '-' || p AS request_id, u AS unit_id, CAST(step AS BIGINT) AS step,
  round(0.0 + {' + '.join(f'v{i}' for i in range(29))}, 4) AS value_sum FROM Q)
SELECT request_id, unit_id, step, 'ok' AS variant, CAST(1 AS BIGINT) AS valid, CAST(29 AS BIGINT) AS n_values, value_sum FROM S
UNION ALL SELECT request_id, unit_id, step, 'junk', CAST(0 AS BIGINT), CAST(30 AS BIGINT), value_sum FROM S""")
def parse_manual_rows_life(spark, sf):
    from wearline.plans.queries import manual_rows
    return manual_rows(DT.life_requests(DT.supplier_telemetry(spark, sf)))


@query("score_requests_multi", f"""WITH {L}, Q AS (SELECT unit_number AS u, (time_in_cycles - 1) // 10 AS p, time_in_cycles AS c,
  sensor_measurement_4 AS x FROM L),
A AS (SELECT u, p, count(*) AS n, avg(x) FILTER (WHERE k <= 5) AS m FROM
  (SELECT *, row_number() OVER (PARTITION BY u, p ORDER BY c DESC) AS k FROM Q) GROUP BY u, p),
R AS (SELECT *, CASE WHEN u < 1 THEN 'unit_id' WHEN n < 5 THEN 'too_few_steps' WHEN (u + p) % 7 = 3 THEN 'non_finite' END AS reason,
  least(1.0, m / 50.0) AS f FROM A)
SELECT u || '-' || p AS request_id, u AS unit_id, coalesce('quarantine:' || reason, 'scored') AS status,
  CASE WHEN reason IS NULL THEN round(f, 6) ELSE -1.0 END AS failure_probability,
  CASE WHEN reason IS NULL THEN CAST(f >= 0.5 AS BIGINT) ELSE -1 END AS failure_prediction FROM R""")
def score_requests_multi(spark, sf):
    """One response per request; a fixed formula stands for the model. -1
    stands for no score."""
    req = DT.life_requests(DT.supplier_telemetry(spark, sf))
    bad = (F.col("unit_id") + F.col("part")) % 7 == 3
    nan_first = F.transform("time_steps", lambda s, i: F.when(i == 0, F.concat(F.array(F.lit(float("nan"))), F.slice(s, 2, 28))).otherwise(s))
    req = req.withColumn("time_steps", F.when(bad, nan_first).otherwise(F.col("time_steps"))).drop("part")

    def formula(df):
        p = F.least(F.lit(1.0), F.col("sensor_measurement_4_rolling_mean_5") / 50.0)
        return df.withColumn("probability", p).withColumn("prediction", (p >= 0.5).cast("bigint"))

    resp, quarantine = SCO.score_requests(req, None, None, [], score_fn=formula)
    return resp.select(REQUEST, "unit_id", F.lit("scored").alias("status"), F.round("failure_probability", 6).alias("failure_probability"),
                       "failure_prediction").unionByName(quarantine.select(
                           REQUEST, "unit_id", F.concat(F.lit("quarantine:"), "reason").alias("status"),
                           F.lit(-1.0).alias("failure_probability"), F.lit(-1).cast("bigint").alias("failure_prediction")))


# ---- stream quarantine ---------------------------------------------------------------

@query("stream_quarantine", f"""WITH {L}, S AS (SELECT unit_number AS u, time_in_cycles AS c, sensor_measurement_4 AS x,
  u < 1 OR (unit_number * 7 + time_in_cycles) % 11 < 3 AS bad FROM L)
SELECT u AS unit_number, count(*)::BIGINT AS n_rows, sum(bad::INT)::BIGINT AS n_quarantined, 
  coalesce(max(c) FILTER (WHERE NOT bad), -1)::BIGINT AS time_in_cycles,
  coalesce(arg_max(least(1.0, x / 50.0), c) FILTER (WHERE NOT bad), -1.0)::DOUBLE AS probability FROM S GROUP BY u""")
def stream_quarantine(spark, sf):
    """Nulls, NaN, infinities and bad units; every batch is delivered twice.
    -1 stands for units without a good row."""
    k = (F.col(UNIT) * 7 + F.col(CYCLE)) % 11
    spoiled = F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("inf")).otherwise(F.col("sensor_measurement_4"))
    rows = DT.supplier_telemetry(spark, sf).select(UNIT, CYCLE, spoiled.alias("sensor_measurement_4"))
    src, base, ck = (shared_path(spark, f"quarantine-{x}") for x in ("src", "tables", "ckpt"))
    rows.write.parquet(src)
    run = SR.make_batch_fn(base, ["sensor_measurement_4"], lambda df: df.withColumn(
        "probability", F.least(F.lit(1.0), F.col("sensor_measurement_4") / 50.0)))

    def twice(batch, epoch):
        run(batch, epoch)
        run(batch, epoch)

    (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(src).writeStream.foreachBatch(twice)
     .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination())
    every = spark.read.parquet(src).groupBy(UNIT).agg(F.count(F.lit(1)).alias("n_rows"))
    bad = SR.quarantined(spark, base).groupBy(UNIT).agg(F.count(F.lit(1)).alias("n_quarantined"))
    return (every.join(bad, UNIT, "left").join(SR.latest_risk(spark, base), UNIT, "left")
            .select(UNIT, "n_rows", F.coalesce("n_quarantined", F.lit(0)).cast("bigint").alias("n_quarantined"),
                    F.coalesce(CYCLE, F.lit(-1)).cast("bigint").alias(CYCLE), F.coalesce("probability", F.lit(-1.0)).alias("probability")))


# ---- keys ----------------------------------------------------------------------------

@query("duplicate_keys", f"""WITH {L}, D AS (SELECT unit_number, time_in_cycles FROM L
  UNION ALL SELECT unit_number, time_in_cycles FROM L WHERE (unit_number + time_in_cycles) % 13 = 0)
SELECT unit_number, time_in_cycles, count(*)::BIGINT AS n FROM D GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    """Every 13th key twice."""
    rows = DT.supplier_telemetry(spark, sf).select(UNIT, CYCLE)
    return LB.duplicate_keys(rows.unionByName(rows.filter((F.col(UNIT) + F.col(CYCLE)) % 13 == 0)))


@query("unmatched_units", f"WITH {L} SELECT DISTINCT unit_number FROM L WHERE unit_number % 5 = 2")
def unmatched_units(spark, sf):
    """Every fifth unit lacks its final RUL."""
    rows = DT.supplier_telemetry(spark, sf)
    return LB.unmatched_units(rows, DT.final_rul(rows).filter(F.col(UNIT) % 5 != 2))
