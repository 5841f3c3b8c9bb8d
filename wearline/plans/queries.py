"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the coverage list. Every query reads the driver's tables (or
data Spark derives from them) in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.operators import features as FE
from wearline.operators import labels as LB
from wearline.schema import CYCLE, POLICY_ACTIONS, UNIT
from wearline.sources import driver_tables as DT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# computed bit-identically by Spark and the oracle: never rounded (a value
# such as 333/640 = 0.5203125 sits on a decimal half)
EXACT = {"cycle_norm"}


def round_half_away(x, d: int):
    """Round the binary value half away from zero (the oracle's rule, and
    C's ``round``); plain arithmetic, so it stays in generated code."""
    p = F.lit(float(10 ** d))
    return F.signum(x) * F.floor(F.abs(x) * p + F.lit(0.5)) / p


def rounded(df: DataFrame, digits: int = 6, **per_col: int) -> DataFrame:
    """Round every double column (``per_col`` overrides by name / suffix)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float") and f.name not in EXACT:
            d = digits
            for k, v in per_col.items():
                if f.name == k or f.name.endswith(k):
                    d = v
            out.append(round_half_away(F.col(f.name).cast("double"), d).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def L(spark, sf):
    return DT.supplier_telemetry(spark, sf)


# ---- step 1: labels and first windows ------------------------------------------

@query("rul_compute")
def q_rul_compute(spark, sf):
    return LB.compute_rul(L(spark, sf)).select(UNIT, CYCLE, "RUL")


@query("failure_label")
def q_failure_label(spark, sf):
    return LB.label_failure(LB.compute_rul(L(spark, sf)), 90).select(UNIT, CYCLE, "RUL", "failure")


@query("failure_label_events")
def q_failure_label_events(spark, sf):
    e = DT.user_telemetry(spark, sf)
    return LB.label_failure(LB.compute_rul(e), 20).select(UNIT, CYCLE, "RUL", "failure")


def raw_features(spark, sf, **kw):
    return rounded(FE.engineer_features(L(spark, sf), **kw), 4, _cumsum=2)


@query("raw_features")
def q_raw_features(spark, sf):
    return raw_features(spark, sf)


# ---- step 2: the feature set -------------------------------------------------------

def _feature_subset(spark, sf, suffixes):
    f = raw_features(spark, sf)
    keep = [c for c in f.columns if any(c.endswith(s) for s in suffixes)]
    return f.select(UNIT, CYCLE, *keep)


@query("rolling_mean")
def q_rolling_mean(spark, sf):
    return _feature_subset(spark, sf, ["_rolling_mean_3", "_rolling_mean_5"])


@query("rolling_std")
def q_rolling_std(spark, sf):
    return _feature_subset(spark, sf, ["_rolling_std_3", "_rolling_std_5"])


@query("ema")
def q_ema(spark, sf):
    return _feature_subset(spark, sf, ["_ema"])


@query("rate_of_change")
def q_rate_of_change(spark, sf):
    return _feature_subset(spark, sf, ["_rate_of_change"])


@query("cumulative_sum")
def q_cumulative_sum(spark, sf):
    return _feature_subset(spark, sf, ["_cumsum"])


@query("cycle_norm")
def q_cycle_norm(spark, sf):
    return _feature_subset(spark, sf, ["cycle_norm"])


@query("ema_events")
def q_ema_events(spark, sf):
    e = DT.user_telemetry(spark, sf)
    f = FE.engineer_features(e, include_degradation=False)
    return rounded(f.select(UNIT, CYCLE, "sensor_measurement_4_ema", "sensor_measurement_4_rolling_mean_5",
                            "sensor_measurement_4_rolling_std_5"), 6)


@query("degradation_only")
def q_degradation_only(spark, sf):
    """Degradation features without the rolling pass: nulls are not filled."""
    f = FE.engineer_features(L(spark, sf), include_rolling=False)
    return rounded(f, 4, _cumsum=2)


@query("trailing_features")
def q_trailing_features(spark, sf):
    return rounded(FE.engineer_features(L(spark, sf), history=10), 4, _cumsum=2)


@query("latest_per_unit")
def q_latest_per_unit(spark, sf):
    f = FE.engineer_features(LB.compute_rul(L(spark, sf)))
    # a unit's cycles differ, so the columns shown are all that the last row is told by
    last = FE.latest_per_unit(f.select(UNIT, CYCLE, "RUL", "sensor_measurement_4_rolling_mean_3",
                                       "sensor_measurement_7_ema", "sensor_measurement_11_cumsum"))
    return rounded(last, 4, _cumsum=2)


@query("timeline_points")
def q_timeline_points(spark, sf):
    return FE.every_nth_cycle(L(spark, sf), start=5, step=5).select(UNIT, CYCLE, "sensor_measurement_4")


@query("feature_select")
def q_feature_select(spark, sf):
    f = FE.engineer_features(LB.label_failure(LB.compute_rul(L(spark, sf)), 90))
    sel = FE.select_features(f)
    # keys are needed to compare rows; they are carried outside the feature list
    return rounded(f.select(UNIT, CYCLE, *sel.columns), 4, _cumsum=2)


@query("fillna_zero")
def q_fillna_zero(spark, sf):
    return FE.fill_zero(L(spark, sf))


@query("horizon_report")
def q_horizon_report(spark, sf):
    """Flagship of step 1: units inside the failure horizon with their
    current rolling level (RUL, label, rolling mean 3, latest row)."""
    lab = LB.label_failure(LB.compute_rul(L(spark, sf)), 90)
    f = FE.engineer_features(lab, window_sizes=(3,), include_degradation=False)
    last = FE.latest_per_unit(f.select(UNIT, CYCLE, "RUL", "failure",
                                       "sensor_measurement_4_rolling_mean_3",
                                       "sensor_measurement_7_rolling_mean_3"))
    return rounded(last, 4)


# ---- step 3: scaling, variance, profiles -------------------------------------------

from wearline.operators import profile as PR  # noqa: E402
from wearline.operators import scaling as SC  # noqa: E402


def labelled(spark, sf, threshold=90):
    return LB.label_failure(LB.compute_rul(L(spark, sf)), threshold)


@query("scaler_fit")
def q_scaler_fit(spark, sf):
    return SC.fit_scaler(L(spark, sf)).select("column", "min", "max", "scale", "offset",
                                             F.col("ordinal").cast("bigint").alias("ordinal"))


@query("scale_features")
def q_scale_features(spark, sf):
    l = L(spark, sf)
    return SC.apply_scaler(l, SC.fit_scaler(l))


@query("variance_report")
def q_variance_report(spark, sf):
    l = labelled(spark, sf)
    scaled = SC.apply_scaler(l, SC.fit_scaler(l))
    rep = SC.variance_report(scaled)
    return rounded(rep, 4)


@query("drop_low_variance")
def q_drop_low_variance(spark, sf):
    l = labelled(spark, sf)
    scaled = SC.apply_scaler(l, SC.fit_scaler(l))
    return SC.drop_columns(scaled, SC.removed_columns(SC.variance_report(scaled)))


@query("unit_life")
def q_unit_life(spark, sf):
    return LB.unit_life(L(spark, sf))


@query("failure_rate")
def q_failure_rate(spark, sf):
    return PR.failure_rate(labelled(spark, sf))


@query("class_distribution")
def q_class_distribution(spark, sf):
    return PR.value_counts(labelled(spark, sf), "failure")


@query("describe_columns")
def q_describe_columns(spark, sf):
    from wearline.plans.train import stored
    l = stored(L(spark, sf), "telemetry")      # the passes read a table, as they would of the user's
    return rounded(PR.describe(l, l.columns), 4)


@query("column_profile")
def q_column_profile(spark, sf):
    return PR.column_profile(LB.compute_rul(L(spark, sf)))


@query("rul_histogram")
def q_rul_histogram(spark, sf):
    return rounded(PR.histogram(LB.compute_rul(L(spark, sf)), "RUL", 50), 6)


@query("rul_density")
def q_rul_density(spark, sf):
    return rounded(PR.density(LB.compute_rul(L(spark, sf)), "RUL", 200), 10, x=4)


@query("rul_test_offset")
def q_rul_test_offset(spark, sf):
    l = L(spark, sf)
    t = LB.attach_final_rul(l, DT.final_rul(l))
    return LB.label_failure(t, 90).select(UNIT, CYCLE, "RUL", "failure")


@query("prepare_data")
def q_prepare_data(spark, sf):
    from wearline.plans.prepare import prepare_data
    l = L(spark, sf)
    train, test, _ = prepare_data(l, l, DT.final_rul(l), threshold=90)
    return (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("split", F.lit("test"))))


# ---- step 4: evaluation ------------------------------------------------------------

from wearline.operators import metrics as MT  # noqa: E402


def scored(spark, sf):
    """Labelled L with two deterministic scores: ``p_qty = quantity / 50``
    (50 levels, many ties) and ``p_price`` = min-max scaled price."""
    l = labelled(spark, sf)
    l = SC.apply_scaler(l, SC.fit_scaler(l, ["sensor_measurement_7"]))
    return l.select(UNIT, CYCLE, "RUL", "failure",
                    (F.col("sensor_measurement_4") / 50.0).alias("p_qty"),
                    F.col("sensor_measurement_7").alias("p_price"),
                    ((F.col("sensor_measurement_4") / 50.0) >= 0.5).cast("bigint").alias("prediction"))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return MT.confusion_matrix(scored(spark, sf))


@query("binary_metrics")
def q_binary_metrics(spark, sf):
    m = MT.binary_metrics(scored(spark, sf), score="p_qty")
    return m.withColumn("roc_auc", round_half_away(F.col("roc_auc"), 12))


@query("classification_report")
def q_classification_report(spark, sf):
    return MT.classification_report(scored(spark, sf))


@query("roc_curve")
def q_roc_curve(spark, sf):
    return MT.roc_curve(scored(spark, sf), score="p_price")


@query("roc_curve_ties")
def q_roc_curve_ties(spark, sf):
    return MT.roc_curve(scored(spark, sf), score="p_qty")


@query("roc_auc")
def q_roc_auc(spark, sf):
    s = scored(spark, sf)
    a = MT.roc_auc(s, score="p_qty").withColumnRenamed("roc_auc", "auc_qty")
    b = MT.roc_auc(s, score="p_price").first()[0]
    return rounded(a.withColumn("auc_price", F.lit(b)), 12)


@query("pr_curve")
def q_pr_curve(spark, sf):
    return MT.pr_curve(scored(spark, sf), score="p_qty")


@query("pr_curve_price")
def q_pr_curve_price(spark, sf):
    return MT.pr_curve(scored(spark, sf), score="p_price")


@query("optimal_threshold")
def q_optimal_threshold(spark, sf):
    return MT.optimal_threshold(scored(spark, sf), score="p_price", min_recall=0.60, min_threshold=0.4)


@query("optimal_threshold_fallback")
def q_optimal_threshold_fallback(spark, sf):
    """No point meets threshold >= 0.99: the recall-only tier decides."""
    return MT.optimal_threshold(scored(spark, sf), score="p_qty", min_recall=0.60, min_threshold=0.99)


@query("cost_benefit")
def q_cost_benefit(spark, sf):
    return MT.cost_benefit(MT.confusion_counts(scored(spark, sf)))


@query("prediction_summary")
def q_prediction_summary(spark, sf):
    return rounded(MT.prediction_summary(scored(spark, sf), prob="p_qty"), 12)


@query("class_weights")
def q_class_weights(spark, sf):
    return MT.class_weights(labelled(spark, sf))


@query("scale_pos_weight")
def q_scale_pos_weight(spark, sf):
    return MT.scale_pos_weight(labelled(spark, sf))


@query("metric_delta")
def q_metric_delta(spark, sf):
    s = scored(spark, sf)
    ours = MT.metric_rows(s, score="p_qty")
    return rounded(MT.metric_delta(ours, MT.baseline_rows(spark)), 12)


# ---- step 5: risk, policy, schedule, timeline ------------------------------------------

from wearline.functions import expressions as X  # noqa: E402
from wearline.operators import policy as PO  # noqa: E402
from wearline.operators import risk as RK  # noqa: E402
from wearline.plans import timeline as TL  # noqa: E402


@query("threshold_decision")
def q_threshold_decision(spark, sf):
    s = scored(spark, sf)
    return s.select(UNIT, CYCLE, "p_price", X.threshold_decision("p_price", 0.5).alias("decision"))


@query("risk_band")
def q_risk_band(spark, sf):
    s = scored(spark, sf)
    return s.select(UNIT, CYCLE, "p_price", X.risk_level("p_price").alias("risk_level"))


@query("risk_recommendation")
def q_risk_recommendation(spark, sf):
    s = scored(spark, sf).select(UNIT, CYCLE, F.col("p_price").alias("probability"))
    return RK.score_risk(s, "probability").select(UNIT, CYCLE, "prediction", "risk_level", "color",
                                                  "recommendation")


@query("wear_state")
def q_wear_state(spark, sf):
    r = LB.compute_rul(L(spark, sf))
    return r.select(UNIT, CYCLE, "RUL", X.wear_state("RUL").alias("state"))


@query("policy_reward")
def q_policy_reward(spark, sf):
    return PO.logged_steps(LB.compute_rul(L(spark, sf)))


@query("wear_transitions")
def q_wear_transitions(spark, sf):
    return rounded(PO.wear_transitions(LB.compute_rul(L(spark, sf))), 9)


def _transitions(spark, sf):
    return PO.action_transitions(LB.compute_rul(L(spark, sf)))


@query("action_transitions")
def q_action_transitions(spark, sf):
    return rounded(_transitions(spark, sf), 12)


def _q(spark, sf):
    return PO.policy_values(_transitions(spark, sf), gamma=0.9)


@query("policy_values")
def q_policy_values(spark, sf):
    return rounded(_q(spark, sf), 6)


@query("greedy_policy")
def q_greedy_policy(spark, sf):
    return rounded(PO.greedy_policy(_q(spark, sf)), 6)


@query("policy_reward_maintenance")
def q_policy_reward_maintenance(spark, sf):
    """D1 for the configured action that has no rule of its own."""
    return PO.logged_steps(LB.compute_rul(L(spark, sf)), action="maintenance")


@query("action_transitions_all")
def q_action_transitions_all(spark, sf):
    """D2b for all four actions."""
    return rounded(PO.action_transitions(LB.compute_rul(L(spark, sf)), actions=POLICY_ACTIONS), 12)


def _q_all(spark, sf, actions):
    return PO.policy_values(PO.action_transitions(LB.compute_rul(L(spark, sf)), actions=actions), gamma=0.9)


@query("policy_values_all")
def q_policy_values_all(spark, sf):
    """D3 for all four actions."""
    return rounded(_q_all(spark, sf, POLICY_ACTIONS), 6)


@query("q_table_all")
def q_q_table_all(spark, sf):
    """D6 for all four actions."""
    return rounded(PO.q_table_wide(_q_all(spark, sf, POLICY_ACTIONS), POLICY_ACTIONS), 6)


@query("greedy_policy_config")
def q_greedy_policy_config(spark, sf):
    """D4 for the two actions that the configuration names."""
    return rounded(PO.greedy_policy(_q_all(spark, sf, PO.CONFIG_ACTIONS), PO.CONFIG_ACTIONS), 6)


@query("q_table_wide")
def q_q_table_wide(spark, sf):
    return rounded(PO.q_table_wide(_q(spark, sf)), 6)


@query("maintenance_schedule")
def q_maintenance_schedule(spark, sf):
    r = LB.compute_rul(L(spark, sf))
    return PO.maintenance_schedule(r, PO.greedy_policy(_q(spark, sf)))


@query("schedule_merge")
def q_schedule_merge(spark, sf):
    s = scored(spark, sf)
    sched = PO.maintenance_schedule(s, PO.greedy_policy(_q(spark, sf)))
    return PO.schedule_merge(s.select(UNIT, CYCLE, "RUL", "failure", "p_qty", "prediction"), sched)


@query("block_average")
def q_block_average(spark, sf):
    st = PO.logged_steps(LB.compute_rul(L(spark, sf))).filter(F.col("next_state").isNotNull())
    return rounded(PO.block_average(st, 100), 9)


def timeline_scored(spark, sf):
    """Trailing-10 features with a deterministic score:
    ``probability = min(1, rolling_mean_5(quantity) / 50)``."""
    f = FE.engineer_features(L(spark, sf), history=10, include_degradation=False)
    return f.select(UNIT, CYCLE, F.least(F.lit(1.0), F.col("sensor_measurement_4_rolling_mean_5") / 50.0)
                    .alias("probability"))


@query("timeline_table")
def q_timeline_table(spark, sf):
    return TL.timeline_points(timeline_scored(spark, sf))


@query("timeline_summary")
def q_timeline_summary(spark, sf):
    return TL.timeline_summary(TL.timeline_points(timeline_scored(spark, sf)))


@query("ground_truth_check")
def q_ground_truth_check(spark, sf):
    l = L(spark, sf)
    pts = TL.timeline_points(timeline_scored(spark, sf))
    return TL.ground_truth_check(pts, DT.final_rul(l), 90)


# ---- step 6: splits, rebalancing, kNN -------------------------------------------------

from wearline.operators import knn as KN  # noqa: E402
from wearline.operators import sampling as SA  # noqa: E402


@query("distinct_units")
def q_distinct_units(spark, sf):
    return SA.distinct_units(L(spark, sf))


@query("unit_split_train")
def q_unit_split_train(spark, sf):
    tr, _ = SA.unit_split(L(spark, sf), 0.2, 42)
    return tr.select(UNIT, CYCLE, "sensor_measurement_4")


@query("unit_split_val")
def q_unit_split_val(spark, sf):
    _, va = SA.unit_split(L(spark, sf), 0.2, 42)
    return va.select(UNIT, CYCLE, "sensor_measurement_4")


@query("row_split")
def q_row_split(spark, sf):
    return SA.row_split(L(spark, sf).select(UNIT, CYCLE), [UNIT, CYCLE], 0.2, 42)


@query("undersample")
def q_undersample(spark, sf):
    return SA.undersample(labelled(spark, sf).select(UNIT, CYCLE, "failure"), "failure", [UNIT, CYCLE], 42)


def binary_vectors(spark, sf):
    """V with a binary label: minority = label 3."""
    v = DT.vectors(spark, sf)
    return v.select("vec_id", "features", (F.col("label") == 3).cast("bigint").alias("minority"))


@query("smote_rows")
def q_smote_rows(spark, sf):
    syn = SA.smote(binary_vectors(spark, sf), "minority", "vec_id", "features", k=5, seed=42)
    return syn.select("syn_id", "base_id", "neighbor_id", round_half_away(F.col("gap"), 9).alias("gap"),
                      round_half_away(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("feature_sum"),
                      round_half_away(F.element_at("features", 1), 6).alias("feature_1"), "minority")


@query("smote_counts")
def q_smote_counts(spark, sf):
    b = binary_vectors(spark, sf)
    syn = SA.smote(b, "minority", "vec_id", "features", k=5, seed=42)
    return (b.select("minority").unionByName(syn.select("minority"))
            .groupBy("minority").agg(F.count(F.lit(1)).cast("bigint").alias("count")))


def l_vectors(spark, sf):
    """Labelled, scaled L with its sensor values as a vector and a row id."""
    from wearline.plans.prepare import prepare_data
    tr, _, _ = prepare_data(L(spark, sf), threshold=90)
    vec = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in
                    ("operational_setting_1", "operational_setting_2", "sensor_measurement_4",
                     "sensor_measurement_7", "sensor_measurement_11")])
    return SA.numbered(tr.select(UNIT, CYCLE, vec.alias("features"), "failure"), [UNIT, CYCLE], "row_id")


@query("rebalance_counts")
def q_rebalance_counts(spark, sf):
    return rounded(SA.rebalance_counts(l_vectors(spark, sf), "failure", "row_id", "features", [UNIT, CYCLE]), 6)


@query("knn_join")
def q_knn_join(spark, sf):
    v = DT.vectors(spark, sf)
    nn = KN.knn_join(v, v, 5, exclude_self=True)
    return nn.select(F.col("q_id").alias("vec_id"), F.col("s_id").alias("neighbor_id"), "rank",
                     round_half_away(F.col("distance"), 6).alias("distance"))


@query("knn_classify")
def q_knn_classify(spark, sf):
    v = DT.vectors(spark, sf)
    return KN.knn_classify(v, v, 5).select("vec_id", F.col("predicted").cast("bigint").alias("predicted"),
                                           "votes", round_half_away(F.col("probability"), 9).alias("probability"))


# ---- step 7/8: sources, sinks, artifacts, requests --------------------------------------

import time  # noqa: E402

from wearline.session import shared_path, stored_removed  # noqa: E402
from wearline.sources import artifacts as AR  # noqa: E402
from wearline.sources import reports as RP  # noqa: E402
from wearline.sources import requests as RQ  # noqa: E402
from wearline.sources import telemetry as TX  # noqa: E402


L_OUT = [UNIT, CYCLE, "operational_setting_1", "operational_setting_2", "operational_setting_3",
         "sensor_measurement_4", "sensor_measurement_7", "sensor_measurement_11", "sensor_measurement_22"]


@query("read_telemetry_text")
def q_read_telemetry_text(spark, sf):
    path = shared_path(spark, "telemetry-text")
    TX.write_telemetry_text(L(spark, sf), path, n_sensors=21)
    return TX.read_telemetry(spark, path, n_sensors=26).select(*L_OUT)


@query("read_final_rul")
def q_read_final_rul(spark, sf):
    path = shared_path(spark, "rul-text")
    (DT.final_rul(L(spark, sf)).orderBy(UNIT)
     .select(F.col("RUL").cast("string").alias("value")).write.text(path))
    return TX.read_final_rul(spark, path)


@query("read_csv_telemetry")
def q_read_csv_telemetry(spark, sf):
    path = shared_path(spark, "telemetry-csv")
    L(spark, sf).write.option("header", True).csv(path)
    return TX.read_csv_telemetry(spark, path).select(*L_OUT)


#: Rows of L that one file written by a query holds, about.
ROWS_PER_FILE = 500_000


def _parts(spark, sf, least: int) -> int:
    """Files for the whole of L: their number follows its rows."""
    return max(least, -(-DT.table(spark, sf, "lineitem").count() // ROWS_PER_FILE))


@query("read_csv_without_unit")
def q_read_csv_without_unit(spark, sf):
    """An upload without unit/cycle columns, in several part files: one unit,
    cycle = row order over all of them."""
    path = shared_path(spark, "telemetry-csv-nounit")
    (L(spark, sf).repartitionByRange(_parts(spark, sf, 5), UNIT, CYCLE).sortWithinPartitions(UNIT, CYCLE).drop(UNIT, CYCLE)
     .write.option("header", True).csv(path))
    return TX.read_csv_telemetry(spark, path).select(UNIT, CYCLE, "sensor_measurement_4", "sensor_measurement_7")


def l_requests(spark, sf):
    return DT.requests(L(spark, sf), steps=5)


@query("request_explode")
def q_request_explode(spark, sf):
    return RQ.explode_requests(l_requests(spark, sf))


def spoiled(requests):
    r = requests.withColumn("origin", F.col("unit_id"))
    ts = F.col("time_steps")
    nan_first = F.transform(ts, lambda s, i: F.when(i == 0, F.concat(F.array(F.lit(float("nan"))), F.slice(s, 2, 28))).otherwise(s))
    narrow = F.transform(ts, lambda s, i: F.when(i == 0, F.slice(s, 1, 28)).otherwise(s))
    return (r.withColumn("variant", F.lit("ok"))
            .unionByName(r.withColumn("time_steps", F.slice(ts, 2, 4)).withColumn("variant", F.lit("short")))
            .unionByName(r.withColumn("time_steps", narrow).withColumn("variant", F.lit("narrow")))
            .unionByName(r.withColumn("time_steps", nan_first).withColumn("variant", F.lit("nan")))
            .unionByName(r.withColumn("unit_id", F.lit(0).cast("bigint")).withColumn("variant", F.lit("unit0"))))


@query("request_validate")
def q_request_validate(spark, sf):
    return RQ.validate_requests(spoiled(l_requests(spark, sf))).select("unit_id", "variant", "valid", "reason")


def manual_rows(requests):
    own = ["request_id"] if "request_id" in requests.columns else []
    ex = requests.select(*own, "unit_id", F.posexplode("time_steps").alias("step", "v"))
    txt = ex.select(*own, "unit_id", "step", F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))).alias("text"))
    both = F.array(F.struct(F.col("text"), F.lit("ok").alias("variant")),
                   F.struct(F.concat("text", F.lit(",abc")).alias("text"), F.lit("junk").alias("variant")))
    txt = txt.select(*own, "unit_id", "step", F.inline(both))
    p = RQ.parse_manual_rows(txt)
    return p.select(*own, "unit_id", F.col("step").cast("bigint").alias("step"), "variant", "valid",
                    F.size("values").cast("bigint").alias("n_values"),
                    round_half_away(F.aggregate("values", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 4).alias("value_sum"))


@query("parse_manual_rows")
def q_parse_manual_rows(spark, sf):
    return manual_rows(l_requests(spark, sf))


@query("latest_report")
def q_latest_report(spark, sf):
    base = shared_path(spark, "reports")
    m = MT.binary_metrics(scored(spark, sf)).select("accuracy", "precision", "recall", "f1_score")
    RP.write_report(m.withColumn("model", F.lit("first")), f"{base}/results_a")
    time.sleep(1.1)
    RP.write_report(m.withColumn("model", F.lit("second")), f"{base}/results_b")
    schema = "accuracy double, precision double, recall double, f1_score double, model string"
    return RP.read_latest_report(spark, f"{base}/results_*", schema)


@query("write_read_predictions")
def q_write_read_predictions(spark, sf):
    path = shared_path(spark, "predictions")
    s = scored(spark, sf).select(UNIT, CYCLE, "failure", "p_qty", "p_price", "prediction")
    RP.write_report(s, path)
    return RP.read_report(spark, path, "unit_number bigint, time_in_cycles bigint, failure bigint, "
                                       "p_qty double, p_price double, prediction bigint")


@query("artifact_roundtrip")
def q_artifact_roundtrip(spark, sf):
    base = shared_path(spark, "artifacts")
    l = L(spark, sf)
    stats = SC.fit_scaler(l)
    AR.save_artifacts(base, "L", "cost_sensitive", scaler=stats, removed=["operational_setting_3"], spark=spark)
    back = AR.load_table(spark, base, "L", "cost_sensitive", "scaler")
    assert AR.load_removed(spark, base, "L", "cost_sensitive") == ["operational_setting_3"]
    assert AR.load_table(spark, base, "L", "missing", "scaler") is None
    return back.select("column", "min", "max", "scale", "offset", F.col("ordinal").cast("bigint").alias("ordinal"))


@query("policy_roundtrip")
def q_policy_roundtrip(spark, sf):
    path = shared_path(spark, "policy-json")
    AR.save_policy(_q(spark, sf), path)
    return rounded(AR.load_policy(spark, path), 6)


@query("unit_filter")
def q_unit_filter(spark, sf):
    """P1 for the unit with the longest life (ties: smallest id)."""
    life = LB.unit_life(L(spark, sf))
    u = life.agg(F.max_by(UNIT, F.struct("max_cycle", -F.col(UNIT)))).first()[0]
    return L(spark, sf).filter(F.col(UNIT) == u)


@query("preview_rows")
def q_preview_rows(spark, sf):
    return L(spark, sf).orderBy(UNIT, CYCLE).limit(10)


@query("curve_union")
def q_curve_union(spark, sf):
    s = scored(spark, sf)
    return (MT.roc_curve(s, score="p_qty").withColumn("model", F.lit("qty"))
            .unionByName(MT.roc_curve(s, score="p_price").withColumn("model", F.lit("price"))))


@query("model_ranking")
def q_model_ranking(spark, sf):
    """K2: two scores as two models; rank per metric (value desc, model)."""
    s = scored(spark, sf)
    s2 = s.withColumn("prediction", (F.col("p_price") >= 0.5).cast("bigint"))
    rows = (MT.metric_rows(s, score="p_qty").withColumn("model", F.lit("qty"))
            .unionByName(MT.metric_rows(s2, score="p_price").withColumn("model", F.lit("price"))))
    from pyspark.sql import Window
    w = Window.partitionBy("metric", "average").orderBy(F.desc("value"), "model")
    return rounded(rows.withColumn("rank", F.row_number().over(w).cast("bigint")), 12)


# ---- learning and jobs (rows-only checks: no SQL equivalent) -------------------------------

from wearline.operators import models as MD  # noqa: E402
from wearline.plans import score as SCO  # noqa: E402
from wearline.plans import train as TR  # noqa: E402

def splits(spark, sf, **kw):
    l = L(spark, sf)
    return TR.prepare_splits(l, DT.final_rul(l), **kw)


def trained(prepared, method="cost_sensitive"):
    """(model, threshold, result row, features) of the forest that the queries use."""
    return TR.train_and_evaluate(*prepared[:3], method, MD.QUERY_FOREST)


@query("engineer_features")
def q_engineer_features(spark, sf):
    """Flagship W12 on prepared telemetry: scale -> drop low variance ->
    all features in one Window node."""
    lab = labelled(spark, sf)
    params, removed = SC.fit_scaler_and_variance(lab)
    tr = SC.apply_scaler(lab, params)
    return rounded(FE.engineer_features(SC.drop_columns(tr, removed)), 6)


@query("rf_score")
def q_rf_score(spark, sf):
    """M1 and M3 with the reference's forest: 500 trees of depth 30."""
    f_tr, _, f_te, _, _ = splits(spark, sf, store_held_out=False)
    scored = MD.fit_and_predict(f_tr, f_te, FE.feature_columns(f_tr), params=MD.REFERENCE_FOREST)
    return scored.select(UNIT, CYCLE, "failure", "probability", "prediction")


@query("rf_balanced_score")
def q_rf_balanced_score(spark, sf):
    prepared = splits(spark, sf)
    model, thr, _, _ = trained(prepared)
    return MD.predict(model, prepared[2], thr).select(UNIT, CYCLE, "failure", "probability", "prediction")


@query("gbt_score")
def q_gbt_score(spark, sf):
    f_tr, _, f_te, _, _ = splits(spark, sf)
    model = MD.fit_gbt(f_tr, FE.feature_columns(f_tr), pos_weight=True)
    return MD.predict(model, f_te).select(UNIT, CYCLE, "failure", "probability", "prediction")


@query("feature_importance_topk")
def q_feature_importance_topk(spark, sf):
    model, _, _, feats = trained(splits(spark, sf))
    return MD.top_features(MD.feature_importances(model, feats), 20)


@query("common_top_features")
def q_common_top_features(spark, sf):
    """Features in both top-20 lists (balanced forest, boosted trees)."""
    prepared = splits(spark, sf)
    model, _, _, feats = trained(prepared)
    gbt = MD.fit_gbt(prepared[0], feats, pos_weight=True)
    a = MD.top_features(MD.feature_importances(model, feats), 20).select("feature")
    b = MD.top_features(MD.feature_importances(gbt, feats), 20).select("feature")
    return a.intersect(b)


@query("model_selection")
def q_model_selection(spark, sf):
    f_tr, _, _, _, _ = splits(spark, sf, store_held_out=False, store_train=False)
    return MD.model_selection(f_tr, FE.feature_columns(f_tr), folds=3)


@query("model_selection_halving")
def q_model_selection_halving(spark, sf):
    """M7 up to 50 trees of depth 12, by successive halving."""
    f_tr, _, _, _, _ = splits(spark, sf, store_held_out=False, store_train=False)
    return MD.halving_search(f_tr, FE.feature_columns(f_tr))


@query("pca_2d")
def q_pca_2d(spark, sf):
    v = DT.vectors(spark, sf)
    cols = [F.element_at("features", i + 1).alias(f"f{i}") for i in range(64)]
    wide = v.select("vec_id", "label", *cols)
    return MD.pca_2d(wide, [f"f{i}" for i in range(64)]).select("vec_id", "label", "pc1", "pc2")


@query("model_comparison")
def q_model_comparison(spark, sf):
    l = L(spark, sf)
    return TR.model_comparison(l, DT.final_rul(l), forest=MD.QUERY_FOREST)


REPORT = ("model string, dataset string, imbalance_method string, accuracy double, precision double, "
          "recall double, f1_score double, roc_auc double, threshold double")


@query("train_report")
def q_train_report(spark, sf):
    """The whole train job on L (cost-sensitive), its run published; the
    result row as the job's report has it."""
    l = L(spark, sf)
    path = TR.train_pipeline(l, DT.final_rul(l), shared_path(spark, "train-artifacts"), forest=MD.QUERY_FOREST)
    return RP.read_report(spark, path, REPORT)


@query("score_fleet")
def q_score_fleet(spark, sf):
    """Run the train job, load what its manifest names, and score the
    held-out units (full history), with risk bands and the policy's maintenance
    action."""
    base, l = shared_path(spark, "fleet-artifacts"), L(spark, sf)
    TR.train_pipeline(l, DT.final_rul(l), base, forest=MD.QUERY_FOREST)
    run = AR.latest_run(spark, base, "L", "cost_sensitive")
    model = AR.load_model(run, "L", "cost_sensitive")
    scaler = AR.load_table(spark, run, "L", "cost_sensitive", "scaler")
    removed = AR.load_removed(spark, run, "L", "cost_sensitive")
    _, test_tel = TR.split_units(l)
    test = LB.attach_final_rul(test_tel, DT.final_rul(l))
    pol = PO.greedy_policy(_q(spark, sf))
    return SCO.score_fleet(test, model, scaler, removed, policy=pol, threshold=0.5)


@query("score_requests")
def q_score_requests(spark, sf):
    """C4: a table of requests (every unit's whole life, plus spoiled
    copies) -> responses; spoiled ones land in quarantine."""
    with stored_removed(spark):      # scoring needs the model, the scaler's numbers and names only
        prepared = splits(spark, sf, store_held_out=False)
        model, _, _, _ = trained(prepared)
        scaler, removed = SC.scaler_params(prepared[3]), prepared[4]
    req = spoiled(DT.life_requests(L(spark, sf))).withColumn("request_id", F.concat_ws("-", "request_id", "variant"))
    resp, bad = SCO.score_requests(req.drop("variant", "origin", "part"), model, scaler, removed)
    return (resp.withColumn("status", F.lit("scored"))
            .unionByName(bad.select("request_id", "unit_id", F.lit(None).cast("double").alias("failure_probability"),
                                    F.lit(None).cast("bigint").alias("failure_prediction"),
                                    F.lit(None).cast("string").alias("risk_level"),
                                    F.lit(None).cast("string").alias("recommendation"),
                                    F.concat(F.lit("quarantine:"), F.col("reason")).alias("status"))))


# ---- step 9: streaming -----------------------------------------------------------------

from wearline.streaming import features as SF  # noqa: E402
from wearline.streaming import risk as SR  # noqa: E402

L_VALUES = ["operational_setting_1", "operational_setting_2", "operational_setting_3",
            "sensor_measurement_4", "sensor_measurement_7", "sensor_measurement_11", "sensor_measurement_22"]


def _stream_source(spark, sf, name, extra=None, bucket=200, spread=2):
    """Lay L out as a file source: one job writes a folder per block of
    ``bucket`` cycles, in ``spread`` files by unit, or as many as the units'
    rows need; the files' times are then set in the order of the blocks, so later
    cycles arrive in later files. Returns the path, the schema and the files of
    a block."""
    l = L(spark, sf)
    units = DT.table(spark, sf, "lineitem").select("l_suppkey").distinct().count()
    spread = max(spread, -(-units * bucket // ROWS_PER_FILE))
    src = shared_path(spark, name)
    block = F.floor((F.col(CYCLE) - 1) / bucket).cast("int")
    (l.select("*", block.alias("_block")).repartition("_block", F.pmod(F.xxhash64(UNIT), F.lit(spread)))
     .write.partitionBy("_block").parquet(src))
    if extra is not None:
        extra(l).select("*", F.lit(2 ** 31 - 1).alias("_block")).write.partitionBy("_block").mode("append").parquet(src)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(src)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    blocks = sorted(((int(f.getPath().getName().split("=")[1]), f) for f in fs.listStatus(root) if f.isDirectory()), key=lambda x: x[0])
    for place, (_, folder) in enumerate(blocks):
        for f in fs.listStatus(folder.getPath()):
            fs.setTimes(f.getPath(), blocks[0][1].getModificationTime() + 1000 * (place - len(blocks)), -1)
    return src, l.schema, spread


@query("stream_features")
def q_stream_features(spark, sf):
    from wearline.session import ship_package
    ship_package(spark)
    src, schema, files = _stream_source(spark, sf, "stream-src")
    out, ck = shared_path(spark, "stream-out"), shared_path(spark, "stream-ckpt")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2 * files).parquet(src)
    feats = SF.stream_features(stream, L_VALUES)
    # with processing-time timeouts pending, no-data micro-batches would keep
    # an availableNow run alive; timeouts still fire on the next data batch
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    old = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        q = (feats.writeStream.format("parquet").option("checkpointLocation", ck).outputMode("append")
             .trigger(availableNow=True).start(out))
        q.awaitTermination()
    finally:
        spark.conf.set(key, old)
    res = spark.read.parquet(out).filter(F.col("status") == "ok").drop("status")
    return rounded(res, 4, _cumsum=2)


def _det_score(df):
    return df.withColumn("probability", F.least(F.lit(1.0), F.col("sensor_measurement_4") / 50.0))


@query("stream_latest_risk")
def q_stream_latest_risk(spark, sf):
    def spoiled(l):
        first = l.filter(F.col(CYCLE) == 1)
        return (first.withColumn(UNIT, F.lit(0).cast("bigint"))
                .unionByName(first.withColumn("sensor_measurement_4", F.lit(float("nan")))))
    src, schema, files = _stream_source(spark, sf, "risk-src", extra=spoiled)
    base, ck = shared_path(spark, "risk-tables"), shared_path(spark, "risk-ckpt")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(src)
    cols = ["operational_setting_1", "operational_setting_2", "sensor_measurement_4",
            "sensor_measurement_7", "sensor_measurement_11"]
    q = (stream.writeStream.foreachBatch(SR.make_batch_fn(base, cols, _det_score))
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    n_bad = SR.quarantined(spark, base).count()
    return SR.latest_risk(spark, base).withColumn("quarantined_rows", F.lit(n_bad).cast("bigint"))


@query("action_distribution")
def q_action_distribution(spark, sf):
    """A6 over the schedule: count and share per recommended action."""
    r = LB.compute_rul(L(spark, sf))
    sched = PO.maintenance_schedule(r, PO.greedy_policy(_q(spark, sf)))
    return PR.value_counts(sched, "recommended_action")


@query("best_recall")
def q_best_recall(spark, sf):
    """The best positive-class recall over the result rows of two models."""
    s = scored(spark, sf)
    s2 = s.withColumn("prediction", (F.col("p_price") >= 0.5).cast("bigint"))
    rows = (MT.metric_rows(s, score=None).withColumn("model", F.lit("qty"))
            .unionByName(MT.metric_rows(s2, score=None).withColumn("model", F.lit("price"))))
    rec = rows.filter((F.col("metric") == "recall") & (F.col("average") == "binary"))
    return rec.agg(F.max("value").alias("best_recall"),
                   F.max_by("model", F.struct(F.col("value"), F.col("model"))).alias("model"))


@query("engineer_features_events")
def q_engineer_features_events(spark, sf):
    """W12 on fixture E (user telemetry, label threshold 20)."""
    e = LB.label_failure(LB.compute_rul(DT.user_telemetry(spark, sf)), 20)
    return rounded(FE.engineer_features(e), 6)
