"""Score a telemetry stream, quarantine bad rows, keep the latest risk
per unit.

``foreachBatch``: each micro-batch is split into valid rows and a
quarantine (unit < 1, non-finite values); valid rows are scored, and the
batch's latest row per unit is written as the epoch's delta, so that bytes
written follow the batch and not the number of units. Every
``compact_every`` epochs the deltas are merged with the last base into a new
base. A table counts once its ``_SUCCESS`` is there; that is the pointer
readers follow. All tables are keyed by the epoch, and what the last base was
made from stays until the next one is complete, so a replayed epoch, also one
that compacts, ends in the same state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.functions.expressions import risk_level
from wearline.schema import CYCLE, UNIT


def bad_row(cols) -> F.Column:
    """Rows that cannot be scored; never null, so that every row is either
    scored or quarantined. A missing value is bad like a non-finite one."""
    c = F.col(UNIT).isNull() | (F.col(UNIT) < 1) | F.col(CYCLE).isNull()
    for x in cols:
        c = c | F.col(x).isNull() | F.isnan(x) | (F.abs(F.col(x)) == F.lit(float("inf")))
    return F.coalesce(c, F.lit(True))


def _newest(df: DataFrame) -> DataFrame:
    """The row of the greatest cycle per unit; of equal cycles, the greater risk."""
    row = F.max(F.struct(CYCLE, "probability")).alias("_l")
    return df.groupBy(UNIT).agg(row).select(UNIT, F.col(f"_l.{CYCLE}").alias(CYCLE), F.col("_l.probability").alias("probability"))


def make_batch_fn(base: str, value_cols: list[str], score_fn, compact_every: int = 16):
    def run(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        flagged = batch.withColumn("_bad", bad_row(value_cols))
        flagged.filter("_bad").drop("_bad").write.mode("overwrite").parquet(f"{base}/quarantine/v={epoch:012d}")
        scored = score_fn(flagged.filter(~F.col("_bad")).drop("_bad"))
        _newest(scored).write.mode("overwrite").parquet(f"{base}/delta/v={epoch:012d}")
        if (epoch + 1) % compact_every == 0:
            compact(spark, base, epoch)
    return run


def compact(spark: SparkSession, base: str, epoch: int) -> None:
    """Merge the deltas up to ``epoch`` with the last base before it into the
    base of ``epoch``; then remove what only older bases were made from."""
    tables = _tables(spark, base, epoch, before=epoch)
    if not tables:
        return
    _newest(_read(spark, tables)).write.mode("overwrite").parquet(f"{base}/latest/v={epoch:012d}")
    bases = [v for v in _versions(spark, f"{base}/latest") if v < epoch]
    if bases:
        stale = [("latest", v) for v in bases[:-1]]
        stale += [("delta", v) for v in _versions(spark, f"{base}/delta") if v <= bases[-1]]
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for kind, v in stale:
            path = jvm.org.apache.hadoop.fs.Path(f"{base}/{kind}/v={v:012d}")
            path.getFileSystem(conf).delete(path, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Epochs with a complete table below ``path``; none if it is not there.
    Any other failure to list it is raised."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _tables(spark: SparkSession, base: str, upto: int | None = None, before: int | None = None) -> list[str]:
    """Paths whose newest rows are the latest risk: the newest base (older than
    epoch ``before``, if given) and the deltas after it, up to epoch ``upto``."""
    bases = [v for v in _versions(spark, f"{base}/latest") if before is None or v < before]
    start = bases[-1] if bases else -1
    deltas = [v for v in _versions(spark, f"{base}/delta") if v > start and (upto is None or v <= upto)]
    return ([f"{base}/latest/v={start:012d}"] if bases else []) + [f"{base}/delta/v={v:012d}" for v in deltas]


def _read(spark: SparkSession, tables: list[str]) -> DataFrame:
    first = spark.read.parquet(tables[0])
    return spark.read.schema(first.schema).parquet(*tables).select(UNIT, CYCLE, "probability")


def quarantined(spark: SparkSession, base: str) -> DataFrame:
    """Bad rows of all epochs, with their epoch ``v``."""
    return spark.read.parquet(f"{base}/quarantine")


def latest_risk(spark: SparkSession, base: str) -> DataFrame:
    """The latest risk per unit: the newest base merged with the deltas since."""
    df = _newest(_read(spark, _tables(spark, base)))
    return df.select(UNIT, CYCLE, "probability", risk_level("probability").alias("risk_level"))
