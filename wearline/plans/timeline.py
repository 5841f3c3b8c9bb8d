"""Risk timeline per unit, ground-truth check, summary —
all units at once instead of a per-unit loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions.expressions import percent, risk_level, threshold_decision
from wearline.operators import features as FE
from wearline.operators.labels import with_unit_last
from wearline.schema import CYCLE, UNIT


def timeline_points(scored: DataFrame, start: int = 5, step: int = 5, prob: str = "probability") -> DataFrame:
    """Every ``step``-th cycle from ``start``: probability, band, and the
    dashboard's text columns (percentages, lifecycle share)."""
    pts = FE.every_nth_cycle(with_unit_last(scored, "total_cycles"), start, step)
    return pts.select(UNIT, CYCLE, "total_cycles", F.col(prob).alias("probability"),
                      percent(prob).alias("probability_text"), risk_level(prob).alias("risk_level"),
                      percent(F.col(CYCLE) / F.col("total_cycles")).alias("lifecycle_text"))


def timeline_summary(points: DataFrame) -> DataFrame:
    """Initial, final and peak risk, first cycle with p > 0.5 (null = never)."""
    return (points.groupBy(UNIT)
            .agg(F.min_by("probability", CYCLE).alias("initial_risk"),
                 F.max_by("probability", CYCLE).alias("final_risk"),
                 F.max("probability").alias("peak_risk"),
                 F.min(F.when(F.col("probability") > 0.5, F.col(CYCLE))).alias("first_cycle_above_half")))


def ground_truth_check(points: DataFrame, final_rul: DataFrame, failure_threshold: float = 90,
                       strict: bool = True) -> DataFrame:
    """remaining = total - cycle + final RUL; the dashboard counts a
    unit as failing when remaining < threshold (``strict``)."""
    fin = final_rul.select(UNIT, F.col("RUL").alias("final_rul"))
    rem = F.col("total_cycles") - F.col(CYCLE) + F.col("final_rul")
    failing = rem < failure_threshold if strict else rem <= failure_threshold
    pred = threshold_decision("probability", 0.5)
    return (points.join(fin, UNIT, "left")
            .select(UNIT, CYCLE, (F.col("total_cycles") + F.col("final_rul")).cast("bigint").alias("failure_cycle"),
                    rem.cast("bigint").alias("cycles_remaining"),
                    failing.cast("bigint").alias("actually_failing"), pred.alias("prediction"),
                    (pred == failing.cast("bigint")).cast("bigint").alias("correct")))
