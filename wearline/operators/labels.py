"""RUL and failure labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.operators.chunks import BEFORE, CHUNK, CHUNK_ROWS, chunked, unit_last
from wearline.schema import CYCLE, FAILURE, FAILURE_THRESHOLD, RUL, UNIT


def unit_keys(df: DataFrame, unit_col: str = UNIT) -> list[str]:
    """Partition keys of a telemetry table: ``dataset`` (if present) + unit."""
    return (["dataset"] if "dataset" in df.columns else []) + [unit_col]


def unit_window(df: DataFrame, unit_col: str = UNIT, order_col: str = CYCLE):
    return Window.partitionBy(*unit_keys(df, unit_col)).orderBy(order_col)


def compute_rul(df: DataFrame, unit_col: str = UNIT, cycle_col: str = CYCLE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``RUL = max(cycle) over unit - cycle``, null for a null cycle. A
    long unit is cut into chunks; null units are a unit."""
    return (with_unit_last(df, "_max", unit_col, cycle_col, chunk_rows)
            .withColumn(RUL, (F.col("_max") - F.col(cycle_col)).cast("bigint")).drop("_max"))


def label_failure(df: DataFrame, threshold: float = FAILURE_THRESHOLD,
                  strict: bool = False, rul_col: str = RUL) -> DataFrame:
    """``failure = int(RUL <= threshold)`` (``<`` with ``strict``); null RUL -> 0."""
    cond = F.col(rul_col) < threshold if strict else F.col(rul_col) <= threshold
    return df.withColumn(FAILURE, F.coalesce(cond, F.lit(False)).cast("bigint"))


def unit_life(df: DataFrame, unit_col: str = UNIT, cycle_col: str = CYCLE) -> DataFrame:
    """A1: life length per unit (partial + final hash aggregate)."""
    return (df.groupBy(*unit_keys(df, unit_col))
            .agg(F.max(cycle_col).cast("bigint").alias("max_cycle"),
                 F.count(F.lit(1)).cast("bigint").alias("n_cycles")))


def attach_final_rul(test: DataFrame, final: DataFrame, unit_col: str = UNIT,
                     cycle_col: str = CYCLE, on_missing: str = "error", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``RUL = final_rul + (max_cycle - cycle)`` for a test set whose
    last cycle is not the failure. ``final`` has one row per unit
    (``unit_number``, ``RUL``). Units without a final RUL are an error, or
    with ``on_missing="null"`` keep a null RUL; ``unmatched_units`` lists them.
    The join is a plain equi-join: the
    per-unit side is small, so AQE turns it into a broadcast at run time
    when its measured size allows, and a sort-merge join otherwise."""
    keys = unit_keys(test, unit_col)
    if on_missing == "error":
        lost = [tuple(r) for r in unmatched_units(test, final, unit_col).limit(5).collect()]
        if lost:
            raise ValueError(f"units without a final RUL, among them {lost}")
    fin = final.select(*keys, F.col(RUL).cast("bigint").alias("_final_rul"))
    t = test.drop(RUL) if RUL in test.columns else test
    t = with_unit_last(t, "_mx", unit_col, cycle_col, chunk_rows)
    return (t.join(fin, keys, "left")
            .withColumn(RUL, (F.col("_final_rul") + F.col("_mx") - F.col(cycle_col)).cast("bigint"))
            .drop("_final_rul", "_mx"))


def duplicate_keys(df: DataFrame, unit_col: str = UNIT, cycle_col: str = CYCLE) -> DataFrame:
    """(unit, cycle, n) of the keys that several rows share: an order by cycle
    does not tell these rows apart."""
    return (df.groupBy(*unit_keys(df, unit_col), cycle_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .filter(F.col("n") > 1))


def require_unique_keys(df: DataFrame, unit_col: str = UNIT, cycle_col: str = CYCLE) -> DataFrame:
    """``df``; an error if rows share a (unit, cycle) key."""
    found = [tuple(r) for r in duplicate_keys(df, unit_col, cycle_col).limit(5).collect()]
    if found:
        raise ValueError(f"rows share a key (unit, cycle), among them {found}")
    return df


def unmatched_units(test: DataFrame, final: DataFrame, unit_col: str = UNIT) -> DataFrame:
    keys = unit_keys(test, unit_col)
    return test.select(*keys).distinct().join(final.select(*keys), keys, "left_anti")


# ---- per-unit helpers for units of any length ---------------------------------------

def with_positions(df: DataFrame, unit_col: str = UNIT, order_col: str = CYCLE, name: str = "_pos", then: tuple[str, ...] = (),
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """1-based position of each row in its unit, by ``order_col`` and then by
    the columns ``then``."""
    keys = unit_keys(df, unit_col)
    place = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(order_col, *then))
    c = chunked(df, keys, order_col, chunk_rows=chunk_rows)
    return c.select(*df.columns, (F.col(BEFORE) + place).cast("bigint").alias(name))


def with_unit_last(df: DataFrame, name: str, unit_col: str = UNIT, order_col: str = CYCLE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The unit's greatest ``order_col`` on every row."""
    keys = unit_keys(df, unit_col)
    c = chunked(df, keys, order_col, chunk_rows=chunk_rows)
    return c.select(*df.columns, unit_last(keys, order_col).alias(name))
