"""Evaluation: confusion matrix, metrics, report, curves, AUC, threshold
choice, cost-benefit (A9–A11, A14–A19, A23, A24, J7).

Curves follow scikit-learn: points at distinct scores, cumulated along
descending score. The cumulation uses the range-partitioned scan after a
``groupBy(score)`` — never a window over the whole table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.operators.scan import ranked
from wearline.schema import COST_DEFAULTS, NOTEBOOK_BASELINE


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, label: str = "failure", pred: str = "prediction") -> DataFrame:
    """1 row: tp, fp, fn, tn (conditional sums, partial aggregation)."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(n)
                    for n, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))])


def confusion_matrix(df: DataFrame, label: str = "failure", pred: str = "prediction") -> DataFrame:
    """The 2x2 matrix as rows (actual, predicted, count), zero cells present."""
    c = confusion_counts(df, label, pred)
    arr = F.array(*[F.struct(F.lit(a).cast("bigint").alias("actual"), F.lit(b).cast("bigint").alias("predicted"),
                             F.col(n).alias("count"))
                    for a, b, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(F.inline(arr))


def metrics_from_counts(c: DataFrame) -> DataFrame:
    """A10: accuracy, precision, recall, F1 with zero_division = 0."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return c.select("tp", "fp", "fn", "tn",
                    _div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    _div(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def binary_metrics(df: DataFrame, label: str = "failure", pred: str = "prediction",
                   score: str | None = None) -> DataFrame:
    m = metrics_from_counts(confusion_counts(df, label, pred))
    if score is not None:
        auc = roc_auc(df, label, score)
        m = _attach(m, auc)
    return m


def _attach(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a 1-row frame as literals (bounded)."""
    r = one_row.first()
    return left.select("*", *[F.lit(r[c]).alias(c) for c in one_row.columns])


def classification_report(df: DataFrame, label: str = "failure", pred: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and
    weighted averages (rows keyed by ``label``)."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    # class 1: tp/fp/fn ; class 0: tn/fn/fp
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    f1 = _div(2 * tp, 2 * tp + fp + fn)
    f0 = _div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    acc = _div(tp + tn, n)
    rows = F.array(
        F.struct(F.lit("0").alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1_score"),
                 s0.cast("bigint").alias("support")),
        F.struct(F.lit("1").alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1_score"),
                 s1.cast("bigint").alias("support")),
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), acc.alias("f1_score"),
                 n.cast("bigint").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"),
                 ((r0 + r1) / 2).alias("recall"), ((f0 + f1) / 2).alias("f1_score"),
                 n.cast("bigint").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), _div(p0 * s0 + p1 * s1, n).alias("precision"),
                 _div(r0 * s0 + r1 * s1, n).alias("recall"), _div(f0 * s0 + f1 * s1, n).alias("f1_score"),
                 n.cast("bigint").alias("support")),
    )
    return c.select(F.inline(rows))


# ---- curves ------------------------------------------------------------------------

def score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct scores with positive/negative counts, cumulated along
    descending score: ``tps``/``fps`` include the group itself."""
    g = (df.filter(F.col(score).isNotNull())
         .groupBy(F.col(score).cast("double").alias("score"))
         .agg(F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("pos"),
              F.sum(F.when(F.col(label) == 1, 0.0).otherwise(1.0)).alias("neg")))
    r = ranked(g, [], [F.desc("score")], ["pos", "neg"], nexts=["pos", "neg"])
    return r.select("score", "pos", "neg", F.col("_rn").alias("rank"),
                    F.col("pos_cum").alias("tps"), F.col("neg_cum").alias("fps"), "pos_next", "neg_next")


def _totals(groups: DataFrame):
    r = groups.agg(F.sum("pos"), F.sum("neg"), F.count(F.lit(1))).first()
    return float(r[0] or 0.0), float(r[1] or 0.0), int(r[2])


def roc_auc(df: DataFrame, label: str = "failure", score: str = "probability") -> DataFrame:
    """Tie-averaged AUC = sum_g pos_g*(neg_below_g + neg_g/2) / (P*N);
    null when one class is empty."""
    g = score_groups(df, label, score)
    P, N, _ = _totals(g)
    if P == 0 or N == 0:
        return df.sparkSession.createDataFrame([(None,)], "roc_auc double")
    s = g.agg(F.sum(F.col("pos") * (F.lit(N) - F.col("fps") + F.col("neg") / 2)).alias("_u"))
    return s.select((F.col("_u") / F.lit(P * N)).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str = "failure", score: str = "probability",
              drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) from (0, 0, +inf); collinear points are
    dropped by the second-difference rule."""
    g = score_groups(df, label, score)
    P, N, m = _totals(g)
    pts = g
    if drop_intermediate and m > 2:
        pts = g.filter((F.col("rank") == 1) | (F.col("rank") == m)
                       | (F.col("neg_next") != F.col("neg")) | (F.col("pos_next") != F.col("pos")))
    spark = df.sparkSession
    start = spark.createDataFrame([(float("inf"), 0.0, 0.0, 0)], "threshold double, fps double, tps double, rank bigint")
    body = pts.select(F.col("score").alias("threshold"), "fps", "tps", "rank")
    allp = start.unionByName(body)
    return allp.select("threshold",
                       (F.col("fps") / F.lit(N) if N else F.lit(None).cast("double")).alias("fpr"),
                       (F.col("tps") / F.lit(P) if P else F.lit(None).cast("double")).alias("tpr"))


def pr_curve(df: DataFrame, label: str = "failure", score: str = "probability") -> DataFrame:
    """(threshold, precision, recall) at every distinct score plus the
    end point (precision 1, recall 0, threshold null)."""
    g = score_groups(df, label, score)
    P, _, _ = _totals(g)
    prec = F.when(F.col("tps") + F.col("fps") > 0, F.col("tps") / (F.col("tps") + F.col("fps"))).otherwise(0.0)
    rec = F.col("tps") / F.lit(P) if P else F.lit(1.0)
    body = g.select(F.col("score").alias("threshold"), prec.alias("precision"), rec.alias("recall"))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return body.unionByName(end)


def optimal_threshold(df: DataFrame, label: str = "failure", score: str = "probability",
                      min_recall: float = 0.60, min_threshold: float = 0.4) -> DataFrame:
    """Max F1 (with +1e-10) among points with recall >= min_recall and
    threshold >= min_threshold; else recall only; else 0.5. The end point
    carries threshold 1.0; ties go to the lowest threshold."""
    pr = pr_curve(df, label, score).withColumn("threshold", F.coalesce("threshold", F.lit(1.0)))
    f1 = 2 * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + F.lit(1e-10))
    pr = pr.withColumn("f1", f1)
    t1 = (F.col("recall") >= min_recall) & (F.col("threshold") >= min_threshold)
    t2 = F.col("recall") >= min_recall
    tier = F.when(t1, 1).when(t2, 2)
    best = pr.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    agg = best.agg(
        F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                 F.struct(F.when(F.col("tier") == 1, 1).otherwise(0), F.col("f1"), -F.col("threshold")))
        .alias("b"), F.min("tier").alias("tier"))
    out = agg.select(F.coalesce(F.col("b.threshold"), F.lit(0.5)).alias("threshold"),
                     F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"),
                     F.col("b.f1").alias("f1_score"),
                     F.coalesce(F.col("tier"), F.lit(3)).cast("bigint").alias("tier"))
    return out


def cost_benefit(counts: DataFrame, maintenance_cost: float = COST_DEFAULTS["maintenance_cost"],
                 failure_cost: float = COST_DEFAULTS["failure_cost"]) -> DataFrame:
    """Scheduled, unexpected, total, avoided, net, ROI % (0 if nothing
    was scheduled)."""
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    sched = (tp + fp) * maintenance_cost
    unexp = fn * failure_cost
    avoided = tp * (failure_cost - maintenance_cost)
    net = avoided - fp * maintenance_cost
    roi = F.when(sched > 0, net / sched * 100).otherwise(0.0)
    return counts.select(sched.alias("scheduled_maintenance_cost"), unexp.alias("unexpected_failure_cost"),
                         (sched + unexp).alias("total_cost"), avoided.alias("avoided_failure_cost"),
                         net.alias("net_benefit"), roi.alias("roi_percent"))


def prediction_summary(df: DataFrame, pred: str = "prediction", prob: str = "probability") -> DataFrame:
    """A19."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_records"),
                  F.sum(F.col(pred).cast("bigint")).cast("bigint").alias("predicted_failures"),
                  F.avg(F.col(pred).cast("double")).alias("predicted_share"),
                  F.avg(F.col(prob).cast("double")).alias("mean_probability"))


def class_weights(df: DataFrame, label: str = "failure") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return c.select(F.col(label), F.col("n_c").cast("bigint").alias("count"),
                    (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def scale_pos_weight(df: DataFrame, label: str = "failure") -> DataFrame:
    """Negatives / positives."""
    return df.agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("bigint").alias("negatives"),
                  F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("positives")) \
        .withColumn("scale_pos_weight", F.try_divide(F.col("negatives").cast("double"),
                                                     F.col("positives").cast("double")))


def metric_rows(df: DataFrame, label: str = "failure", pred: str = "prediction",
                score: str | None = "probability") -> DataFrame:
    """Our metrics as rows ``(metric, average, value)``: positive-class
    ('binary') and support-weighted ('weighted') averages, AUC as binary."""
    rep = classification_report(df, label, pred)
    b = rep.filter(F.col("label") == "1")
    wgt = rep.filter(F.col("label") == "weighted avg")
    acc = rep.filter(F.col("label") == "accuracy").select(F.col("f1_score").alias("value"))

    def rows(frame, average):
        return frame.select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.lit(average).alias("average"), F.col(c).alias("value"))
            for m, c in (("precision", "precision"), ("recall", "recall"), ("f1_score", "f1_score"))])))
    out = rows(b, "binary").unionByName(rows(wgt, "weighted"))
    for avg in ("binary", "weighted"):
        out = out.unionByName(acc.select(F.lit("accuracy").alias("metric"), F.lit(avg).alias("average"), "value"))
    if score is not None:
        out = out.unionByName(roc_auc(df, label, score).select(
            F.lit("roc_auc").alias("metric"), F.lit("binary").alias("average"), F.col("roc_auc").alias("value")))
    return out


def baseline_rows(spark, baseline: dict | None = None) -> DataFrame:
    b = baseline or NOTEBOOK_BASELINE
    rows = [(k, "binary" if k == "roc_auc" else "weighted", float(v)) for k, v in b.items()]
    return spark.createDataFrame(rows, "metric string, average string, baseline double")


def metric_delta(ours: DataFrame, baseline: DataFrame) -> DataFrame:
    """Our metrics minus the baseline, matched on (metric, average)."""
    return (ours.join(baseline, ["metric", "average"], "left")
            .withColumn("delta", F.col("value") - F.col("baseline")))
