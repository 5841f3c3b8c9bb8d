"""Units of any length for bounded windows: halo partitions by cycle.

A window per unit puts a unit into one task. Units of more than ``chunk_rows``
rows are cut into chunks instead, by native operators alone:

1. a partial aggregate counts the rows per unit; most tables have no longer
   unit, and then every unit is one chunk and nothing else runs;
2. of the longer ones, a histogram over equal ranges of the order column
   (``CELLS`` per chunk, a partial aggregate again) gives each cell the number
   of rows before it, and chunks are runs of cells with about ``chunk_rows``
   rows. Rows of one cell are never parted, so ties and gaps do no harm;
3. cells within ``back`` rows of the next chunk's start (``ahead`` rows of the
   last one's end) are copied there as ghost rows: as many neighbours as a
   window of that length can see, whatever the gaps in the order column.

Windows then run per (unit, chunk), a position is the chunk's count of rows
before it plus the place inside, and ghosts are dropped. The results do not
depend on ``chunk_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.session import ensure_checkpoint_dir

#: Rows of a unit that one task holds (a chunk has up to a cell more).
CHUNK_ROWS = 1_000_000
CELLS = 32

#: Plans whose units are known to be short. A table that grows later still gets
#: right results, only from fewer tasks.
_SHORT: set = set()

CHUNK, GHOST, BEFORE, LAST = "_chunk", "_ghost", "_before", "_unit_last"


def long_units(df: DataFrame, keys: list[str], order_col: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame | None:
    """(``_k0``.., rows, lo, hi) of the units with more than ``chunk_rows``
    rows, one in as many rows of ``df`` at most; None if there are none."""
    spark = df.sparkSession
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    known = (spark.sparkContext.applicationId, df.select(*named).semanticHash(), chunk_rows)
    if known in _SHORT:
        return None
    rows = df.select(*named, F.col(order_col).alias("_o")).groupBy(*ks)
    if rows.agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > chunk_rows).isEmpty():
        _SHORT.add(known)
        return None
    ensure_checkpoint_dir(spark)
    return (rows.agg(F.count(F.lit(1)).alias("rows"), F.min("_o").alias("lo"), F.max("_o").alias("hi"))
            .filter(F.col("rows") > chunk_rows).checkpoint())


def same_unit(keys: list[str]) -> Column:
    """Null-safe equality of the keys with ``_k0``, ``_k1``, ..."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out


def _number(c: Column, kind: str) -> Column:
    """An order column as a number that never falls where the column rises."""
    if kind == "timestamp_ntz":      # by its own calendar: a cast would go through the session's time zone
        return F.unix_date(c.cast("date")) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.unix_date(c).cast("double") if kind == "date" else c.cast("double")


def _layout(rows: DataFrame, ks: list[str], chunk_rows: int, back: int, ahead: int) -> DataFrame:
    """(keys, cell, chunk, ghost, before) of the cells of long units: their own
    chunk, and those that they are copied to."""
    unit = Window.partitionBy(*ks)
    h = rows.groupBy(*ks, "_cell").agg(F.count(F.lit(1)).alias("n"))
    h = h.withColumn("end", F.sum("n").over(unit.orderBy("_cell"))).withColumn("start", F.col("end") - F.col("n"))
    h = h.withColumn("chunk", F.floor(F.col("start") / chunk_rows).cast("bigint"))
    h = h.withColumn("before", F.min("start").over(Window.partitionBy(*ks, "chunk"))).checkpoint()
    out = h.select(*ks, "_cell", F.col("chunk").alias(CHUNK), F.lit(False).alias(GHOST), F.col("before").alias(BEFORE))
    for reach, at, near, step in ((back, "end", (1 - back, 0), F.lead), (ahead, "start", (0, ahead - 1), F.lag)):
        if reach:
            by = unit.orderBy(at)
            to = h.select(*ks, step("chunk").over(by).alias(CHUNK), step("before").over(by).alias(BEFORE), F.col("chunk").alias("own"),
                          F.collect_list("_cell").over(by.rangeBetween(*near)).alias("cells"))
            to = to.filter(F.col(CHUNK) != F.col("own"))
            out = out.unionByName(to.select(*ks, F.explode("cells").alias("_cell"), CHUNK, F.lit(True).alias(GHOST), BEFORE))
    return out.groupBy(*ks, "_cell").agg(F.collect_list(F.struct(CHUNK, GHOST, BEFORE)).alias("_to")).checkpoint()


def chunked(df: DataFrame, keys: list[str], order_col: str, back: int = 0, ahead: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with the chunk of every row, whether it is a ghost there, the rows
    of its unit before that chunk, and the unit's last order value (null for
    units that are one chunk: a window sees it). Nulls of the order column come
    first, as in Spark's windows; null keys are a unit."""
    units = long_units(df, keys, order_col, chunk_rows)
    order_type = df.schema[order_col].dataType
    if units is None:
        return df.select("*", F.lit(0).cast("bigint").alias(CHUNK), F.lit(False).alias(GHOST), F.lit(0).cast("bigint").alias(BEFORE),
                         F.lit(None).cast(order_type).alias(LAST))
    ks = [f"_k{i}" for i in range(len(keys))]
    at, lo, hi = (_number(F.col(c), order_type.typeName()) for c in (order_col, "lo", "hi"))
    place = at - lo
    width = F.greatest((hi - lo) * chunk_rows / (F.col("rows") * CELLS), F.lit(1e-9))
    cell = F.when(F.col("rows").isNotNull(), F.coalesce(F.floor(place / width).cast("bigint"), F.lit(-1)))
    found = df.join(units, same_unit(keys), "left").withColumn("_cell", cell)
    layout = _layout(found.filter(F.col("rows").isNotNull()).select(*ks, "_cell"), ks, chunk_rows, back, ahead)
    layout = layout.select(*[F.col(k).alias(f"{k}_") for k in ks], F.col("_cell").alias("_cell_"), "_to")
    on = F.col("_cell") == F.col("_cell_")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}_"))
    alone = F.array(F.struct(F.lit(0).cast("bigint").alias(CHUNK), F.lit(False).alias(GHOST), F.lit(0).cast("bigint").alias(BEFORE)))
    return (found.join(layout, on, "left").select(*df.columns, F.col("hi").alias(LAST), F.explode(F.coalesce("_to", alone)).alias("_x"))
            .select(*df.columns, f"_x.{CHUNK}", f"_x.{GHOST}", f"_x.{BEFORE}", LAST))


def chunk_window(keys: list[str], order_col: str):
    return Window.partitionBy(*keys, CHUNK).orderBy(order_col)


def own_rows(df: DataFrame) -> DataFrame:
    """Without ghosts and helper columns."""
    return df.filter(~F.col(GHOST)).drop(CHUNK, GHOST, BEFORE, LAST)


def unit_last(keys: list[str], order_col: str) -> Column:
    """The unit's last order value on every row of a ``chunked`` frame."""
    whole = chunk_window(keys, order_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.col(LAST), F.max(order_col).over(whole))
