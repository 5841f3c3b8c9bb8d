"""Profiles: rates, value counts, describe, info, histogram, density
(A5–A8, A12, A13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.operators.selection import exact_quantiles

NUMERIC = ("double", "float", "long", "integer", "short", "byte", "decimal")


def failure_rate(df: DataFrame, label: str = "failure") -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.sum(label).cast("bigint").alias("n_failures"),
                  F.avg(F.col(label).cast("double")).alias("failure_rate"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts and share of total. The total is a one-row aggregate
    read first, so no window spans the (possibly large) count table."""
    total = df.agg(F.count(F.lit(1))).first()[0]
    c = df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return c.withColumn("share", F.col("count") / F.lit(float(total)) if total else F.lit(None).cast("double"))


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, 25%, 50%, 75%, max per numeric column; the
    quantiles are exact (``selection.exact_quantiles``)."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    found, row = exact_quantiles(df, cols, more=aggs)
    rows = [(c, *[row[f"{x}{i}"] for x in "nmsa"], *[found.get((c, q)) for q in (0.25, 0.5, 0.75)], row[f"b{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, count bigint, mean double, std double, min double, "
                                                 "p25 double, p50 double, p75 double, max double")


def column_profile(df: DataFrame) -> DataFrame:
    """Row count, non-null count and type per column (one pass)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                             F.col(f"_c{i}").cast("bigint").alias("non_null"),
                             F.lit(i).cast("bigint").alias("ordinal"))
                    for i, c in enumerate(cols)])
    return row.select(F.col("_n").cast("bigint").alias("n_rows"), F.inline(arr))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max], the last bin closed; empty
    bins are present. Edges as numpy: ``lo = min + i*(max-min)/bins``.
    The 1-row min/max is read first and enters the plan as literals."""
    x = F.col(col).cast("double")
    mn, mx = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin bigint, lo double, hi double, count bigint")
    lmn, lmx = F.lit(float(mn)), F.lit(float(mx))
    idx = (F.lit(0) if mx == mn else
           F.least(F.floor((x - lmn) * bins / (lmx - lmn)), F.lit(bins - 1))).cast("bigint")
    counts = (df.filter(x.isNotNull()).select(idx.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    width = (lmx - lmn) / bins
    grid = spark.range(bins).select(F.col("id").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (lmn + F.col("bin") * width).alias("lo"),
                    (lmn + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def density(df: DataFrame, col: str, grid_size: int = 200) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth (``sigma = std * n^(-1/5)``)
    on ``grid_size`` points spanning [min, max]. Equal values are grouped
    first; each distinct value then adds its contribution to every grid
    point through ``posexplode`` + a partial aggregate (no join)."""
    x = F.col(col).cast("double")
    vals = df.select(x.alias("v")).filter(F.col("v").isNotNull())
    n, sd, mn, mx = vals.agg(F.count(F.lit(1)), F.stddev_samp("v"), F.min("v"), F.max("v")).first()
    if not n or sd is None:
        return df.sparkSession.createDataFrame([], "point bigint, x double, density double")
    sigma = float(sd) * float(n) ** -0.2
    step = (float(mx) - float(mn)) / (grid_size - 1)
    grouped = vals.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    g = grouped.select("w", "v", F.posexplode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("i", "_"))
    gx = F.lit(float(mn)) + F.col("i") * F.lit(step)
    contrib = F.col("w") * F.exp(-F.pow(gx - F.col("v"), 2) / F.lit(2 * sigma * sigma))
    z = float(n) * sigma * (2 * 3.141592653589793) ** 0.5
    return (g.groupBy("i").agg(F.sum(contrib).alias("_s"))
            .select(F.col("i").cast("bigint").alias("point"), gx.alias("x"),
                    (F.col("_s") / F.lit(z)).alias("density")))
