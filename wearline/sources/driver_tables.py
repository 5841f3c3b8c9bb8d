"""Adapters that turn the driver's tables into telemetry.

The reference's engine text files are not shipped, so runs use stand-ins
derived by Spark from the given tables (their work grows with them):

* L — supplier telemetry from ``lineitem``: one unit per supplier.
* E — user telemetry from ``events``: one unit per user.
* V — labelled vectors from ``embeddings`` (kNN, SMOTE, PCA).

The unit column is named in a ``select`` *before* ``row_number`` so the
output stays hash-partitioned by ``unit_number`` and the feature windows
downstream reuse that exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.operators.chunks import CHUNK_ROWS
from wearline.operators.labels import with_positions
from wearline.schema import CYCLE, UNIT
from wearline.session import compiled_methods


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    compiled_methods(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def supplier_telemetry(spark: SparkSession, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Fixture L: a supplier's rows numbered in the order of shipping, a
    supplier with very many rows by many tasks."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("bigint").alias(UNIT),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        "l_extendedprice", "l_tax", "l_quantity", "l_discount",
    )
    li = with_positions(li, order_col="l_shipdate", then=("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), name=CYCLE,
                        chunk_rows=chunk_rows)
    return li.select(
        UNIT,
        CYCLE,
        F.col("l_linenumber").cast("double").alias("operational_setting_1"),
        F.col("l_tax").cast("double").alias("operational_setting_2"),
        F.lit(100.0).alias("operational_setting_3"),
        F.col("l_quantity").cast("double").alias("sensor_measurement_4"),
        F.col("l_extendedprice").cast("double").alias("sensor_measurement_7"),
        F.col("l_discount").cast("double").alias("sensor_measurement_11"),
        F.lit(None).cast("double").alias("sensor_measurement_22"),
    )


def user_telemetry(spark: SparkSession, sf_dir: str, keep_ts: bool = False) -> DataFrame:
    """Fixture E."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("bigint").alias(UNIT), "ts", "event_id", "value")
    cols = [UNIT, CYCLE, F.col("value").cast("double").alias("sensor_measurement_4")] + (["ts"] if keep_ts else [])
    return with_positions(ev, order_col="ts", then=("event_id",), name=CYCLE).select(*cols)


def final_rul(telemetry: DataFrame) -> DataFrame:
    """Per-unit final RUL for the test-set join: ``(unit * 37) % 146``."""
    return (telemetry.select(UNIT).distinct()
            .select(UNIT, ((F.col(UNIT) * 37) % 146).cast("bigint").alias("RUL")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture V: ``vec_id``, ``features`` array<double>, ``label``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        F.col("label").cast("bigint").alias("label"),
    )


def requests(telemetry: DataFrame, steps: int = 5, values: list[str] | None = None) -> DataFrame:
    """Per unit, the last ``steps`` rows packed as a scoring request
    ``(unit_id, time_steps array<array<double>>)`` with 29 values per step."""
    from wearline.schema import value_columns
    cols = values or value_columns()
    have = set(telemetry.columns)
    # absent columns are sent as 0.0 so every step carries 29 finite values
    row = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0) for c in cols])
    # the array of rows is ordered by cycle: sort the collected (cycle, row) structs
    last = (telemetry
            .withColumn("_r", F.row_number().over(
                Window.partitionBy(UNIT).orderBy(F.col(CYCLE).desc())))
            .filter(F.col("_r") <= steps)
            .groupBy(UNIT)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(CYCLE), row.alias("v")))).alias("s")))
    return last.select(F.col(UNIT).alias("unit_id"),
                       F.expr("transform(s, x -> x.v)").alias("time_steps"))


def life_requests(telemetry: DataFrame, steps: int = 10) -> DataFrame:
    """Every unit's whole life as requests of ``steps`` consecutive steps."""
    from wearline.schema import value_columns
    from wearline.sources.requests import REQUEST
    have = set(telemetry.columns)
    values = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0) for c in value_columns()])
    part = F.floor((F.col(CYCLE) - 1) / steps).cast("bigint")
    packed = (telemetry.select(UNIT, part.alias("part"), F.struct(CYCLE, values.alias("v")).alias("s")).groupBy(UNIT, "part")
              .agg(F.sort_array(F.collect_list("s")).alias("s")))
    return packed.select(F.concat_ws("-", F.col(UNIT), F.col("part")).alias(REQUEST), F.col(UNIT).alias("unit_id"), "part",
                         F.col("s.v").alias("time_steps"))
