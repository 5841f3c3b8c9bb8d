"""Training and model comparison as one lazy plan per stage.

Features are per-unit windows and splits are by unit, so features are
computed once on the prepared table and then split — equal to computing
them per split, with one exchange instead of three."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.operators import features as FE
from wearline.operators import metrics as MT
from wearline.operators import models as MD
from wearline.operators import sampling as SA
from wearline.operators import scaling as SC
from wearline.plans.prepare import prepare_data
from wearline.schema import CYCLE, FAILURE, UNIT
from wearline.session import stored, stored_removed

METHODS = ("none", "smote", "undersample", "cost_sensitive")


def split_units(telemetry: DataFrame, test_size: float = 0.2, seed: int = 7):
    """Hold out whole units as a test set (seeded)."""
    test_units = SA.validation_units(telemetry, test_size, seed)
    return (telemetry.join(test_units, UNIT, "left_anti"), telemetry.join(test_units, UNIT, "left_semi"))


def rebalance(train: DataFrame, features: list[str], method: str, seed: int = 42) -> tuple[DataFrame, bool]:
    """Returns (training rows, use balanced weights)."""
    if method == "undersample":
        return SA.undersample(train, FAILURE, [UNIT, CYCLE], seed), False
    if method == "smote":
        vec = SA.numbered(train.select(UNIT, CYCLE, F.array(*[F.col(c).cast("double") for c in features]).alias("_v"), FAILURE),
                          [UNIT, CYCLE], "_id").drop(UNIT, CYCLE)
        syn = SA.smote(vec, FAILURE, "_id", "_v", k=5, seed=seed)
        extra = syn.select(*[F.element_at("_v", i + 1).alias(c) for i, c in enumerate(features)],
                           F.col(FAILURE).cast("bigint").alias(FAILURE))
        return train.select(*features, FAILURE).unionByName(extra), False
    if method == "cost_sensitive":
        return train, True
    return train, False


def prepare_splits(telemetry: DataFrame, final_rul: DataFrame, threshold: float = 90,
                   val_size: float = 0.2, seed: int = 42, fit_on: str = "all", store_held_out: bool = True,
                   store_train: bool = True):
    """prepare -> unit split -> variance filter (fitted on train) -> features.

    ``fit_on="all"`` fits the scaler on every training unit before the
    validation split (the reference's order, Q7); ``"train_only"`` fits it
    on the units left after the split. The telemetry is stored once; splits,
    scaler, variances and features read that, and so are the features: those of
    validation and test rows only with ``store_held_out``, since a job that goes
    over them once needs no copy. Without either, ``store_train=False`` leaves the
    training features to a caller that stores them in a form of its own."""
    telemetry = stored(telemetry, "telemetry")
    train_tel, test_tel = split_units(telemetry)
    if fit_on == "train_only":
        val_units = SA.validation_units(train_tel, val_size, seed)
        fit_rows = train_tel.join(val_units, UNIT, "left_anti")
        _, _, stats = prepare_data(fit_rows, None, None, threshold)
        params = SC.scaler_params(stats)
        train, test, _ = prepare_data(train_tel, test_tel, final_rul, threshold, scaler=params)
        scaler = stats
    else:
        train, test, scaler = prepare_data(train_tel, test_tel, final_rul, threshold)
    val_units = stored(SA.validation_units(train, val_size, seed), "validation-units")
    removed = SC.removed_columns(SC.variance_report(train.join(val_units, UNIT, "left_anti")))
    if not store_held_out:
        f_tr, f_va, f_te = (FE.engineer_features(SC.drop_columns(x, removed)) for x in (
            train.join(val_units, UNIT, "left_anti"), train.join(val_units, UNIT, "left_semi"), test))
        return stored(f_tr, "features-train") if store_train else f_tr, f_va, f_te, scaler, removed
    f_train = stored(FE.engineer_features(SC.drop_columns(train, removed)), "features-train")
    f_te = stored(FE.engineer_features(SC.drop_columns(test, removed)), "features-test")
    f_tr, f_va = f_train.join(val_units, UNIT, "left_anti"), f_train.join(val_units, UNIT, "left_semi")
    return f_tr, f_va, f_te, scaler, removed


def train_and_evaluate(f_tr, f_va, f_te, method: str = "cost_sensitive", forest=None,
                       dataset: str = "L", min_recall: float = 0.60, seed: int = 42):
    """Fit, tune the threshold on validation, evaluate on test; returns
    (model, threshold, result row DataFrame, features). Predictions are stored
    (label, score, decision), so features and trees are gone through once."""
    features = FE.feature_columns(f_tr)
    rows, balanced = rebalance(f_tr, features, method, seed)
    model = MD.fit_forest(rows, features, balanced=balanced, params=forest)
    val = stored(MD.predict(model, f_va).select(FAILURE, "probability"), "validation-scores")
    thr = MT.optimal_threshold(val, FAILURE, "probability", min_recall, 0.4).first()["threshold"]
    test = stored(MD.predict(model, f_te, thr).select(FAILURE, "probability", "prediction"), "test-scores")
    m = MT.binary_metrics(test, FAILURE, "prediction", score="probability")
    name = "Random Forest (Balanced)" if balanced else "Random Forest"
    res = m.select(F.lit(name).alias("model"), F.lit(dataset).alias("dataset"), F.lit(method).alias("imbalance_method"),
                   "accuracy", "precision", "recall", "f1_score", "roc_auc", F.lit(float(thr)).alias("threshold"))
    return model, thr, res, features


def model_comparison(telemetry: DataFrame, final_rul: DataFrame, methods=METHODS, forest=None) -> DataFrame:
    """M9: one result row per imbalance method (same splits, cached)."""
    f_tr, f_va, f_te, _, _ = prepare_splits(telemetry, final_rul)
    out = None
    for m in methods:
        _, _, res, _ = train_and_evaluate(f_tr, f_va, f_te, m, forest)
        out = res if out is None else out.unionByName(res)
    return out


def write_run(base: str, model, threshold: float, result: DataFrame, features: list[str], scaler: DataFrame,
              removed: list[str], dataset: str = "L", method: str = "cost_sensitive") -> str:
    """Store what scoring needs (model, scaler, removed columns, threshold), the
    feature importances and the result row in a folder of the run's own, then
    publish it; the report's path. A run that breaks off is never loaded."""
    from wearline.sources import artifacts as AR
    from wearline.sources import reports as RP
    spark = result.sparkSession
    run = AR.new_run(base, dataset, method)
    row = spark.createDataFrame([("random_forest", dataset, method, float(threshold))],
                                "model string, dataset string, method string, threshold double")
    AR.save_artifacts(run, dataset, method, scaler=scaler, removed=removed, thresholds=row, model=model, spark=spark)
    MD.feature_importances(model, features).write.parquet(f"{run}/importances")
    RP.write_report(result, f"{run}/report")
    own = [f"{dataset}_{method}/{p}" for p in ("scaler", "removed", "thresholds", "model")]
    AR.publish_run(spark, base, dataset, method, run, own + ["importances", "report"])
    return f"{run}/report"


def train_pipeline(telemetry: DataFrame, final_rul: DataFrame, base: str, dataset: str = "L",
                   method: str = "cost_sensitive", forest=None, threshold: float = 90) -> str:
    """C2, the whole job: prepare, split by unit, fit, tune the threshold on
    validation units, evaluate on held-out ones, and publish the run below
    ``base`` (a shared folder). Returns the report's path; ``latest_run`` finds
    the run's folder for scoring. Telemetry and features are gone by then."""
    with stored_removed(telemetry.sparkSession):
        f_tr, f_va, f_te, scaler, removed = prepare_splits(telemetry, final_rul, threshold, store_held_out=False)
        model, thr, result, features = train_and_evaluate(f_tr, f_va, f_te, method, forest, dataset)
        return write_run(base, model, thr, result, features, scaler, removed, dataset, method)
