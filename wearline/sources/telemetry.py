"""Telemetry text / CSV readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.operators.scan import ranked
from wearline.schema import CYCLE, N_SENSORS, UNIT, telemetry_columns


def nan_to_null(c):
    """Q19: NaN becomes null at ingest (Spark's max/avg would propagate NaN
    where pandas skips it)."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def read_telemetry(spark: SparkSession, path: str, n_sensors: int = N_SENSORS,
                   dataset: str | None = None) -> DataFrame:
    """Whitespace-separated, headerless lines; leading/trailing blanks
    ignored; a short row gives nulls for its missing trailing fields."""
    names = telemetry_columns(n_sensors)
    parts = F.split(F.trim(F.col("value")), r"\s+")
    cols = []
    for i, n in enumerate(names):
        v = F.try_element_at(parts, F.lit(i + 1))
        v = F.when(v == "", None).otherwise(v)
        cols.append((v.cast("bigint") if n in (UNIT, CYCLE) else nan_to_null(v.cast("double"))).alias(n))
    df = spark.read.text(path).filter(F.trim("value") != "").select(*cols)
    return df.withColumn("dataset", F.lit(dataset)) if dataset else df


def _line_numbers(df: DataFrame) -> DataFrame:
    """1-based line numbers over all files in path order: the parts of one
    folder are one text. Within a file blocks are in order of their offset and
    lines in the order they are read."""
    d = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
                        "_mid": F.monotonically_increasing_id()})
    return ranked(d, [], ["_file", "_block", "_mid"]).withColumnRenamed("_rn", "_line").drop("_mid", "_file", "_block")


def read_final_rul(spark: SparkSession, path: str) -> DataFrame:
    """S3: one RUL per line; the unit is the line number, counted over all
    part files in path order."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    r = _line_numbers(lines)
    return r.select(F.col("_line").cast("bigint").alias(UNIT),
                    F.split(F.trim("value"), r"\s+")[0].cast("bigint").alias("RUL"))


def read_csv_telemetry(spark: SparkSession, path: str, n_sensors: int = N_SENSORS) -> DataFrame:
    """Header CSV; columns by name, absent ones null; without
    ``unit_number`` all files together are unit 1 with cycle = row position."""
    raw = spark.read.option("header", True).csv(path)
    names = telemetry_columns(n_sensors)
    have = set(raw.columns)
    if UNIT not in have:
        raw = _line_numbers(raw).withColumn(UNIT, F.lit(1)).withColumn(CYCLE, F.col("_line"))
    cols = []
    for n in names:
        t = "bigint" if n in (UNIT, CYCLE) else "double"
        c = (F.col(n) if n in raw.columns else F.lit(None)).cast(t)
        cols.append((c if t == "bigint" else nan_to_null(c)).alias(n))
    return raw.select(*cols)


def write_telemetry_text(df: DataFrame, path: str, n_sensors: int = N_SENSORS, trailing: str = "  ") -> None:
    """Writes the reference's text layout: unit, cycle, 3 settings and
    ``n_sensors`` sensors separated by blanks (plus trailing blanks, as in
    the original files); absent columns are 0."""
    names = telemetry_columns(n_sensors)
    have = set(df.columns)
    vals = [F.coalesce(F.col(n).cast("string"), F.lit("0")) if n in have else F.lit("0") for n in names]
    df.select(F.concat(F.concat_ws(" ", *vals), F.lit(trailing)).alias("value")).write.mode("overwrite").text(path)
