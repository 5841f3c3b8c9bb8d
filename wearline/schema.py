"""Telemetry schema and fixed reference values.

FIXED VALUES — these must equal the reference's for equal results.
"""

from __future__ import annotations

from pyspark.sql import types as T

UNIT = "unit_number"
CYCLE = "time_in_cycles"
RUL = "RUL"
FAILURE = "failure"

# --- fixed values -----------------------------------------------------------
N_SETTINGS = 3
N_SENSORS = 26
# sensors that get rate-of-change and cumulative-sum features
DEGRADATION_SENSORS = [4, 7, 11, 12, 15, 17, 20, 21]
WINDOW_SIZES = (3, 5)
EMA_SPAN = 5
FAILURE_THRESHOLD = 90
VARIANCE_THRESHOLD = 0.01
ID_TARGET_COLUMNS = ["unit_number", "time_in_cycles", "RUL", "failure"]
# risk bands: probability < upper bound -> level (last band is >= 0.75)
RISK_LEVELS = [
    ("LOW", 0.0, 0.3, "#28a745", "Continue normal operations."),
    ("MEDIUM", 0.3, 0.5, "#ffc107", "Schedule maintenance inspection."),
    ("HIGH", 0.5, 0.75, "#fd7e14", "Schedule immediate maintenance."),
    ("CRITICAL", 0.75, None, "#dc3545", "URGENT: Emergency maintenance required!"),
]
# wear states by RUL: > 100 healthy, > 50 moderate, > 20 severe, else failed
WEAR_STATES = ["healthy", "moderate_wear", "severe_wear", "failed"]
WEAR_BOUNDS = (100, 50, 20)
POLICY_ACTIONS = ["no_maintenance", "immediate_maintenance", "schedule_maintenance", "maintenance"]
COST_DEFAULTS = {"maintenance_cost": 10000.0, "failure_cost": 100000.0}
# weighted-average baseline of the exploration notebook
NOTEBOOK_BASELINE = {
    "recall": 0.9520464263897374,
    "precision": 0.9948470096735572,
    "f1_score": 0.9729762531629744,
    "roc_auc": 0.47297479116356866,
    "accuracy": 0.9520464263897374,
}
# --- end of fixed values ----------------------------------------------------


def setting_columns(n: int = N_SETTINGS) -> list[str]:
    return [f"operational_setting_{i}" for i in range(1, n + 1)]


def sensor_columns(n: int = N_SENSORS) -> list[str]:
    return [f"sensor_measurement_{i}" for i in range(1, n + 1)]


def telemetry_columns(n_sensors: int = N_SENSORS) -> list[str]:
    return [UNIT, CYCLE] + setting_columns() + sensor_columns(n_sensors)


def value_columns(n_sensors: int = N_SENSORS) -> list[str]:
    return setting_columns() + sensor_columns(n_sensors)


def telemetry_schema(n_sensors: int = N_SENSORS) -> T.StructType:
    fields = [T.StructField(UNIT, T.LongType(), True), T.StructField(CYCLE, T.LongType(), True)]
    fields += [T.StructField(c, T.DoubleType(), True) for c in value_columns(n_sensors)]
    return T.StructType(fields)


def present(df_columns, wanted) -> list[str]:
    """Keep the wanted columns that exist, in wanted order (absent ones are
    skipped, as the reference does)."""
    have = set(df_columns)
    return [c for c in wanted if c in have]
