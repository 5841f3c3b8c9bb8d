"""Min-max scaling and the low-variance filter.

The fitted scaler is a small long table ``(column, min, max, scale,
offset)`` — one row per column — stored as an artifact and applied by
literal injection (its size is bounded by the column count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.schema import ID_TARGET_COLUMNS, VARIANCE_THRESHOLD, present, value_columns

NUMERIC = ("double", "float", "long", "integer", "short", "byte", "decimal")


def fit_scaler(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A2: min and max of every column in one aggregate (partial + final)."""
    cols = present(df.columns, columns or value_columns())
    row = df.agg(*[e for c in cols for e in (F.min(F.col(c).cast("double")).alias(f"_mn{cols.index(c)}"),
                                            F.max(F.col(c).cast("double")).alias(f"_mx{cols.index(c)}"))])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_mn{i}").alias("min"),
                               F.col(f"_mx{i}").alias("max"), F.lit(i).alias("ordinal"))
                      for i, c in enumerate(cols)])
    rng = F.col("max") - F.col("min")
    scale = F.when(rng == 0, F.lit(1.0)).otherwise(F.lit(1.0) / rng)
    return (row.select(F.inline(pairs))
            .withColumn("scale", scale)
            .withColumn("offset", F.lit(0.0) - F.col("min") * F.col("scale")))


def scaler_params(stats: DataFrame) -> dict[str, tuple]:
    """Collect the fitted table (one row per column: bounded)."""
    return {r["column"]: (r["scale"], r["offset"]) for r in stats.collect()}


def apply_scaler(df: DataFrame, stats: DataFrame | dict) -> DataFrame:
    """A3: ``x * scale + offset`` (the sklearn formula: no clipping, a
    constant column maps to 0, a column all-null at fit stays null)."""
    params = scaler_params(stats) if isinstance(stats, DataFrame) else stats
    out = []
    for c in df.columns:
        if c in params:
            s, o = params[c]
            if s is None:
                out.append(F.lit(None).cast("double").alias(c))
            else:
                out.append((F.col(c).cast("double") * F.lit(s) + F.lit(o)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def variance_report(df: DataFrame, threshold: float = VARIANCE_THRESHOLD,
                    protected: list[str] | None = None) -> DataFrame:
    """A4: sample variance of every numeric column in one pass; a column is
    removed when its variance is below the threshold (a null variance is
    kept) unless it is protected."""
    prot = set(ID_TARGET_COLUMNS if protected is None else protected)
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC]
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("variance"))
                    for i, c in enumerate(cols)])
    rep = row.select(F.inline(arr))
    removed = (F.coalesce(F.col("variance") < threshold, F.lit(False))
               & ~F.col("column").isin(*prot))
    return rep.withColumn("removed", removed.cast("bigint"))


def removed_columns(report: DataFrame) -> list[str]:
    return [r["column"] for r in report.filter("removed = 1").select("column").collect()]


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the listed columns that are present."""
    return df.drop(*present(df.columns, cols))


def fit_scaler_and_variance(df: DataFrame, columns: list[str] | None = None,
                            threshold: float = VARIANCE_THRESHOLD, protected: list[str] | None = None):
    """A2 + A4 in one aggregate pass, for the common case where both are
    fitted on the same rows: min/max of the value columns and the sample
    variance of every numeric column; a scaled column's variance is
    ``var * scale^2``. Returns (scaler params, removed columns)."""
    prot = set(ID_TARGET_COLUMNS if protected is None else protected)
    cols = present(df.columns, columns or value_columns())
    nums = [f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"_mn{i}"), F.max(x).alias(f"_mx{i}")]
    aggs += [F.var_samp(F.col(c).cast("double")).alias(f"_v{j}") for j, c in enumerate(nums)]
    r = df.agg(*aggs).first()
    params, removed = {}, []
    for i, c in enumerate(cols):
        mn, mx = r[f"_mn{i}"], r[f"_mx{i}"]
        if mn is None:
            params[c] = (None, None)
            continue
        scale = 1.0 if mx - mn == 0 else 1.0 / (mx - mn)
        params[c] = (scale, 0.0 - mn * scale)
    for j, c in enumerate(nums):
        v = r[f"_v{j}"]
        if c in params and v is not None:
            v = None if params[c][0] is None else v * params[c][0] ** 2
        if v is not None and v < threshold and c not in prot:
            removed.append(c)
    return params, removed
