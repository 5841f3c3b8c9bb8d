"""Per-unit time-series features.

Bounded windows share one partition/order spec and are written in a single
``select`` (one exchange, one sort, one Window operator); running values come
from the prefix scan.

Semantics (pandas parity):
* rolling mean / sample std need a full window (``min_periods = window``),
  otherwise null, and nulls become 0 afterwards;
* EMA ``span=5, adjust=False`` (alpha = 1/3, seeded with the first value); over
  a gap the earlier average decays with every row, and a row without a value
  keeps the average;
* rate of change = first difference (first row 0) and cumulative sum for
  the degradation sensors; ``cycle_norm = cycle / max(cycle)`` per unit;
* with ``include_rolling`` every null is filled with 0 *before* the
  degradation features, as the reference does.

``history=N`` computes what the features would be if only the last N rows
up to each row existed (trailing-window scoring): EMA and cumulative sums
use the N-row frame, ``cycle_norm`` is 1, rolling windows wider than N are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.operators.chunks import CHUNK, CHUNK_ROWS, GHOST, LAST, chunked, long_units, same_unit
from wearline.operators.labels import unit_keys, unit_window, with_positions
from wearline.operators.scaling import NUMERIC
from wearline.operators.scan import ema_batches, feature_batches, ranked
from wearline.schema import (CYCLE, DEGRADATION_SENSORS, EMA_SPAN, ID_TARGET_COLUMNS,
                             UNIT, WINDOW_SIZES, present, value_columns)


def ema_weights(span: int = EMA_SPAN) -> tuple[float, float]:
    """(decay, alpha) for ``adjust=False``: alpha = 2/(span+1)."""
    return (span - 1.0) / (span + 1.0), 2.0 / (span + 1.0)


def ema_fold(rows: Column, span: int = EMA_SPAN) -> Column:
    """Fold an ordered array of ``struct(v)``, nulls included: a value ``g``
    rows after the last one weighs ``alpha`` against ``decay**g``."""
    decay, alpha = ema_weights(span)
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(1.0).alias("w"))

    def step(a, x):
        old, v = a["w"] * F.lit(decay), x["v"].cast("double")
        mean = F.when(a["v"].isNull(), v).otherwise((old * a["v"] + F.lit(alpha) * v) / (old + F.lit(alpha)))
        return F.when(v.isNull(), F.struct(a["v"].alias("v"), F.when(a["v"].isNull(), a["w"]).otherwise(old).alias("w"))) \
            .otherwise(F.struct(mean.alias("v"), F.lit(1.0).alias("w")))

    return F.aggregate(rows, start, step, lambda a: a["v"])


#: Trailing averages over so many rows take their values from ``lag`` columns.
MOST_LAGS = 64


def trailing_lags(w, cols: list[str], history: int) -> list[Column]:
    """The earlier values of every column, and whether there is such a row."""
    return ([F.lag(F.lit(True), j).over(w).alias(f"_row{j}") for j in range(1, history)]
            + [F.lag(c, j).over(w).alias(f"_lag{j}_{c}") for c in cols for j in range(1, history)])


def trailing_weights(history: int, span: float) -> list[Column]:
    """``_w<j>``: the weight of the value ``j`` rows back in an average without
    gaps, null where there is no such row."""
    decay, alpha = ema_weights(span)
    out = []
    for j in range(history):
        oldest = F.lit(True) if j == history - 1 else F.col(f"_row{j + 1}").isNull()
        weight = F.when(oldest, F.lit(decay ** j)).otherwise(F.lit(alpha * decay ** j))
        out.append((weight if j == 0 else F.when(F.col(f"_row{j}").isNotNull(), weight)).alias(f"_w{j}"))
    return out


def trailing_average(c: str, history: int, span: float) -> Column:
    """The average of the last ``history`` rows: a weighted sum, or the fold
    over gaps where a value is missing; null if all are."""
    value = lambda j: F.col(c if j == 0 else f"_lag{j}_{c}").cast("double")
    total = value(0) * F.col("_w0")
    for j in range(1, history):
        total = total + F.when(F.col(f"_w{j}").isNull(), F.lit(0.0)).otherwise(value(j) * F.col(f"_w{j}"))
    fold = ema_fold(F.array(*[F.struct(value(j).alias("v")) for j in range(history - 1, -1, -1)]), span)
    return F.coalesce(total, F.when(F.coalesce(*[value(j) for j in range(history)]).isNotNull(), fold))


def earlier(c: str, j: int) -> Column:
    """The value ``j`` rows back."""
    return F.col(c if j == 0 else f"_lag{j}_{c}")


def rolling_by_lags(df: DataFrame, cols: list[str], window_sizes) -> DataFrame:
    """Rolling means and deviations (0 where the window is not full) from the
    ``lag`` columns: no frame is gone through again for every row."""
    means = []
    for n in window_sizes:
        for c in cols:
            total = earlier(c, n - 1)
            for j in range(n - 2, -1, -1):
                total = total + earlier(c, j)
            means.append((total / F.lit(float(n))).alias(f"_mean{n}_{c}"))     # null if any value is
    df = df.select("*", *means)
    out = []
    for n in window_sizes:
        for c in cols:
            mean = F.col(f"_mean{n}_{c}")
            squares = [(earlier(c, j) - mean) * (earlier(c, j) - mean) for j in range(n)]
            std = F.sqrt(sum(squares[1:], squares[0]) / F.lit(float(n - 1))) if n > 1 else F.lit(0.0)
            out += [F.coalesce(mean, F.lit(0.0)).alias(f"{c}_rolling_mean_{n}"), F.coalesce(std, F.lit(0.0)).alias(f"{c}_rolling_std_{n}")]
    return df.select("*", *out)


def trailing_sum(c: str, history: int) -> Column:
    """The sum of the last ``history`` rows, missing values as 0."""
    total = F.coalesce(earlier(c, history - 1), F.lit(0.0))
    for j in range(history - 2, -1, -1):
        total = total + F.coalesce(earlier(c, j), F.lit(0.0))
    return total


def degradation_columns(df_columns) -> list[str]:
    return present(df_columns, [f"sensor_measurement_{i}" for i in DEGRADATION_SENSORS])


def feature_names(value_cols: list[str], degr_cols: list[str], window_sizes=WINDOW_SIZES,
                  include_rolling: bool = True, include_degradation: bool = True) -> list[str]:
    out = []
    if include_rolling:
        for w in window_sizes:
            for c in value_cols:
                out += [f"{c}_rolling_mean_{w}", f"{c}_rolling_std_{w}"]
        out += [f"{c}_ema" for c in value_cols]
    if include_degradation:
        out.append("cycle_norm")
        out += [f"{c}_rate_of_change" for c in degr_cols]
        out += [f"{c}_cumsum" for c in degr_cols]
    return out


def averaged(df: DataFrame, keys: list[str], order_col: str, cols: list[str], span: float) -> DataFrame:
    """``df``, whose tasks hold whole runs of ``keys`` in their order, with the
    exponential average ``<c>_ema`` of every column: one Arrow pass."""
    df = df.sortWithinPartitions(*keys, order_col)      # as the window left it: costs nothing, and is stated
    return ema_batches(df, keys, cols, span)


def engineer_features(df: DataFrame, window_sizes=WINDOW_SIZES, include_rolling: bool = True,
                      include_degradation: bool = True, history: int | None = None,
                      unit_col: str = UNIT, order_col: str = CYCLE, ema_span: float = EMA_SPAN,
                      value_cols: list[str] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All features.

    * With ``history`` all windows are bounded, and a unit of any length is cut
      into chunks with a halo (``chunks.chunked``).
    * Without, units of up to ``chunk_rows`` rows take one exchange and one
      Window operator on the unit, running sums and the unit's maximum
      included, and one Arrow pass over its sorted rows for the averages.
    * Longer units are split off; their positions, cumulative sums and averages
      come from the range-partitioned scan (``scan.ranked``), which spreads a
      unit over many tasks, and their bounded windows run per (unit, chunk).

    Both ways give the same features, exact for any span and over gaps. Rows
    that share a (unit, cycle) key have no order of their own: see
    ``labels.require_unique_keys``."""
    keys = unit_keys(df, unit_col)
    cols = present(df.columns, value_cols or value_columns())
    degr = degradation_columns(df.columns)
    back = max([1, *([n - 1 for n in window_sizes] if include_rolling else []), *([] if history is None else [history - 1])])
    if chunk_rows <= back:
        raise ValueError("chunk_rows must exceed the look-back")
    args = (df.columns, keys, order_col, cols, degr, window_sizes, include_rolling, include_degradation, history, ema_span,
            {f.name: f.dataType for f in df.schema.fields})
    if history is not None:
        return _windows(chunked(df, keys, order_col, back=back, chunk_rows=chunk_rows), Window.partitionBy(*keys, CHUNK).orderBy(order_col),
                        F.col(GHOST), *args)
    units = long_units(df, keys, order_col, chunk_rows)
    if units is None:
        return _windows(df, unit_window(df, unit_col, order_col), None, *args)
    short = df.join(units, same_unit(keys), "left_anti")
    long = df.join(units.withColumnRenamed("hi", LAST), same_unit(keys)).select(*df.columns, LAST)
    return (_windows(short, unit_window(df, unit_col, order_col), None, *args)
            .unionByName(_scanned(long, back, chunk_rows, *args)))


def _scanned(df: DataFrame, back: int, chunk_rows: int, names, keys, order_col, cols, degr, window_sizes, include_rolling,
             include_degradation, *rest) -> DataFrame:
    """Features of units of any length: the rows just before a chunk of
    ``chunk_rows`` positions are copied into it, as many as the widest window
    looks back."""
    ema_span = rest[1]
    sums = [f"_cs_{c}" for c in degr] if include_degradation else []
    pre = df.select("*", *[F.col(c).cast("double").alias(f"_cs_{c}") for c in degr if sums])
    r = ranked(pre, keys, [order_col], sums, emas=cols if include_rolling else [], span=ema_span)
    chunk = F.floor((F.col("_rn") - 1) / chunk_rows).cast("bigint")
    late = (F.col("_rn") - 1) % chunk_rows >= chunk_rows - back
    r = r.select("*", F.posexplode(F.when(late, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))).alias("_copy", CHUNK))
    return _windows(r, Window.partitionBy(*keys, CHUNK).orderBy("_rn"), F.col("_copy") > 0, names, keys, order_col, cols, degr,
                    window_sizes, include_rolling, include_degradation, *rest, scanned=True)


def _windows(r: DataFrame, w, ghost, names, keys, order_col, cols, degr, window_sizes, include_rolling, include_degradation, history,
             ema_span, types, scanned: bool = False) -> DataFrame:
    """The features of rows ``r`` by the window ``w``, without the rows marked
    as ``ghost``. ``scanned``: sums and averages are there already."""
    fill, all_rows = include_rolling, history is None
    if include_rolling and all_rows and not scanned and all(types[c].typeName() == "double" for c in (*cols, *degr)):
        return _one_pass(r, w, names, keys, order_col, cols, degr if include_degradation else [], window_sizes, include_degradation, ema_span, types)
    numeric = {c for c, t in types.items() if t.typeName() in NUMERIC}
    base = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if fill else F.col(c)
    late = include_rolling and all_rows and not scanned      # averages are added after the windows
    lagged = include_rolling and not all_rows and history <= MOST_LAGS
    by_lags = lagged and all(types[c].typeName() == "double" for c in (*cols, *degr))
    new: list[Column] = []
    if include_rolling:
        for n in window_sizes if not by_lags else ():
            frame = w.rowsBetween(-(n - 1), 0)
            fits = all_rows or n <= history
            for c in cols:
                full = F.count(c).over(frame) == n
                mean = F.when(full, F.avg(c).over(frame)) if fits else F.lit(None)
                std = F.when(full, F.stddev_samp(c).over(frame)) if fits else F.lit(None)
                new.append(F.coalesce(mean.cast("double"), F.lit(0.0)).alias(f"{c}_rolling_mean_{n}"))
                new.append(F.coalesce(std.cast("double"), F.lit(0.0)).alias(f"{c}_rolling_std_{n}"))
        if lagged:
            new += trailing_lags(w, cols, history)
        elif not all_rows:
            new += [ema_fold(F.collect_list(F.struct(F.col(c).alias("v"))).over(w.rowsBetween(-(history - 1), 0)), ema_span)
                    .alias(f"{c}_ema") for c in cols]
        elif scanned:
            new += [F.col(f"{c}_ema") for c in cols]
    if include_degradation:
        cyc = F.col(order_col)
        if all_rows:
            top = F.col(LAST) if scanned else F.max(order_col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            new.append(F.when(top > 0, cyc / top).otherwise(F.lit(0.0)).cast("double").alias("cycle_norm"))
        else:
            new.append(F.when(cyc > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("cycle_norm"))
        for c in degr:
            diff = base(c) - F.lag(base(c), 1).over(w)
            if not all_rows and history < 2:
                diff = F.lit(None)
            new.append(F.coalesce(diff.cast("double"), F.lit(0.0)).alias(f"{c}_rate_of_change"))
        for c in degr:
            first = Window.unboundedPreceding if all_rows else -(history - 1)
            if by_lags and c in cols:
                continue
            s = F.col(f"_cs_{c}_cum") if scanned else F.sum(base(c)).over(w.rowsBetween(first, 0))
            if not fill:
                s = F.when(F.col(c).isNotNull(), s)   # pandas cumsum keeps NaN in place
            new.append(s.cast("double").alias(f"{c}_cumsum"))
    made = r.select(*names, *new, *([] if ghost is None else [ghost.alias("_gone")]))
    if ghost is not None:
        made = made.filter(~F.col("_gone")).drop("_gone")
    if late:
        made = averaged(made, keys, order_col, cols, ema_span)
    if by_lags:
        made = rolling_by_lags(made, cols, [n for n in window_sizes if n <= history])
        zero = F.lit(0.0)
        made = made.select("*", *[zero.alias(f"{c}_rolling_{kind}_{n}") for n in window_sizes if n > history for c in cols for kind in ("mean", "std")],
                           *[trailing_sum(c, history).alias(f"{c}_cumsum") for c in degr if include_degradation and c in cols])
    if lagged:
        made = made.select("*", *trailing_weights(history, ema_span))
        made = made.select("*", *[trailing_average(c, history, ema_span).alias(f"{c}_ema") for c in cols])
    if not include_rolling:
        return made
    # the reference fills nulls of every numeric column but not the keys
    out = [F.coalesce(F.col(c), F.lit(0).cast(types[c])).alias(c) if c in numeric and c not in (*keys, order_col) else F.col(c) for c in names]
    for n in window_sizes:
        out += [F.col(f"{c}_rolling_{kind}_{n}") for c in cols for kind in ("mean", "std")]
    out += [F.coalesce(F.col(f"{c}_ema"), F.lit(0.0)).alias(f"{c}_ema") for c in cols]
    if include_degradation:
        out += [F.col("cycle_norm"), *[F.col(f"{c}_rate_of_change") for c in degr], *[F.col(f"{c}_cumsum") for c in degr]]
    return made.select(*out)


def _one_pass(df: DataFrame, w, names, keys, order_col, cols, degr, window_sizes, norm: bool, span, types) -> DataFrame:
    """All features of units that fit a task: the Window operator brings a
    unit's rows together, in order, and one Arrow pass over the values makes
    the rest, so that no frame is gone through again for every row."""
    top = F.max(order_col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if norm else F.row_number().over(w)
    made = df.select(*names, top.alias("_top")).sortWithinPartitions(*keys, order_col)      # as the window left it: costs nothing
    if norm:
        made = made.select(*names, _share(order_col, "_top"))
    return _passed(made, names, keys, order_col, cols, degr, window_sizes, norm, span, types)


def _share(order_col: str, top: str) -> Column:
    return F.when(F.col(top) > 0, F.col(order_col) / F.col(top)).otherwise(F.lit(0.0)).cast("double").alias("cycle_norm")


def _passed(made: DataFrame, names, keys, order_col, cols, degr, window_sizes, norm: bool, span, types) -> DataFrame:
    """The Arrow pass over rows that lie by unit, in order."""
    made = feature_batches(made, keys, cols, degr, window_sizes, span)
    # the reference fills nulls of every numeric column but not the keys
    own = [F.coalesce(F.col(c), F.lit(0).cast(types[c])).alias(c)
           if types[c].typeName() in NUMERIC and c not in (*keys, order_col) else F.col(c) for c in names]
    return made.select(*own, *feature_names(cols, degr, window_sizes, True, norm))


def last_of_runs(df: DataFrame, top: str, window_sizes=WINDOW_SIZES, unit_col: str = UNIT, order_col: str = CYCLE,
                 ema_span: float = EMA_SPAN) -> DataFrame:
    """The last row of every unit with all its features, where the rows of a
    unit already follow each other in one task, in their order, and ``top`` has
    the unit's last cycle: no exchange, no sort. Value columns are doubles."""
    keys, names = unit_keys(df, unit_col), df.columns
    cols, degr = present(names, value_columns()), degradation_columns(names)
    types = {f.name: f.dataType for f in df.schema.fields}
    made = _passed(df.select(*names, _share(order_col, top)), names, keys, order_col, cols, degr, window_sizes, True, ema_span, types)
    return made.filter(F.col(order_col) == F.col(top)).drop(top)


def select_features(df: DataFrame, exclude=None) -> DataFrame:
    """Every column but the id/target list."""
    ex = set(exclude if exclude is not None else ID_TARGET_COLUMNS)
    return df.select(*[c for c in df.columns if c not in ex])


def feature_columns(df: DataFrame, exclude=None) -> list[str]:
    ex = set(exclude if exclude is not None else ID_TARGET_COLUMNS)
    return [c for c in df.columns if c not in ex]


def fill_zero(df: DataFrame) -> DataFrame:
    """P5: null -> 0 over numeric columns."""
    return df.na.fill(0)


def latest_per_unit(df: DataFrame, unit_col: str = UNIT, order_col: str = CYCLE) -> DataFrame:
    """The last row per unit, a partial aggregate. Of rows that share the
    last cycle, the one whose values have the greatest hash stays, wherever
    the rows lie."""
    keys = unit_keys(df, unit_col)
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(F.col(order_col), F.xxhash64(*rest))).alias("_last")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def every_nth_cycle(df: DataFrame, start: int = 5, step: int = 5, unit_col: str = UNIT, order_col: str = CYCLE,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows whose position p (1-based, by cycle) satisfies
    ``p >= start and (p - start) % step == 0``."""
    return (with_positions(df, unit_col, order_col, chunk_rows=chunk_rows)
            .filter((F.col("_pos") >= start) & (((F.col("_pos") - start) % step) == 0))
            .drop("_pos"))
