"""Per-unit stateful features on a stream.

``groupBy(unit).applyInPandasWithState``: the state of a unit holds its
last ``max(window) - 1`` rows, the EMA, the running sums, the last value
and the last cycle (a small JSON document). Each arriving cycle emits the
rolling mean/std (full-window rule), EMA, rate of change and cumulative
sum — equal to the batch features of W2–W6. ``cycle_norm`` needs the
unit's last cycle and is 1.0 on arrival, so it is not emitted. A cycle at
or below the last seen cycle is late: it is emitted with
``status = 'late'`` and does not touch the state. Averages over gaps are those
of the batch features, however the rows are cut into batches. State is kept
for good, unless ``timeout_ms`` is given: then idle units expire with a row
``status = 'expired'``, and start anew."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from wearline.operators.features import degradation_columns, ema_weights
from wearline.operators.scan import EMPTY, joined, segmented_ema
from wearline.schema import CYCLE, EMA_SPAN, UNIT, WINDOW_SIZES


def output_schema(value_cols, degr, windows=WINDOW_SIZES) -> T.StructType:
    f = [T.StructField(UNIT, T.LongType()), T.StructField(CYCLE, T.LongType())]
    for n in windows:
        for c in value_cols:
            f += [T.StructField(f"{c}_rolling_mean_{n}", T.DoubleType()),
                  T.StructField(f"{c}_rolling_std_{n}", T.DoubleType())]
    f += [T.StructField(f"{c}_ema", T.DoubleType()) for c in value_cols]
    f += [T.StructField(f"{c}_rate_of_change", T.DoubleType()) for c in degr]
    f += [T.StructField(f"{c}_cumsum", T.DoubleType()) for c in degr]
    f.append(T.StructField("status", T.StringType()))
    return T.StructType(f)


def _window_stats(v: np.ndarray, n: int):
    """Full-window mean and sample std (two-pass per window) of every column,
    NaN where the window is short or holds a null; then 0."""
    m = np.zeros(v.shape)
    s = np.zeros(v.shape)
    if len(v) >= n:
        w = np.lib.stride_tricks.sliding_window_view(v, n, axis=0)
        ok = ~np.isnan(w).any(2)
        mu = w.mean(2)
        sd = np.sqrt(((w - mu[:, :, None]) ** 2).sum(2) / (n - 1)) if n > 1 else np.full(mu.shape, np.nan)
        m[n - 1:] = np.where(ok, mu, 0.0)
        s[n - 1:] = np.where(ok, np.nan_to_num(sd, nan=0.0), 0.0)
    return m, s


def make_state_fn(value_cols, degr, windows=WINDOW_SIZES, span=EMA_SPAN, timeout_ms: int | None = None):
    decay, alpha = ema_weights(span)
    keep = max(windows) - 1
    schema = output_schema(value_cols, degr, windows)

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            gone = {f.name: [np.nan] for f in schema.fields}
            gone[UNIT], gone[CYCLE], gone["status"] = [key[0]], [json.loads(state.get[0])["cycle"]], ["expired"]
            state.remove()
            yield pd.DataFrame(gone)
            return
        st = json.loads(state.get[0]) if state.exists else {"tail": [], "ema": {}, "cum": {}, "last": {}, "cycle": None}
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(CYCLE, kind="stable")
        out_rows = []
        last_cycle = st["cycle"]
        cyc = pdf[CYCLE].to_numpy()
        # sorted, so a cycle exceeds every earlier one if it exceeds the one before
        late = np.r_[False, cyc[1:] == cyc[:-1]][:len(cyc)]
        if last_cycle is not None:
            late |= cyc <= last_cycle
        fresh = pdf[~late].reset_index(drop=True)
        if len(fresh):
            tail = np.array(st["tail"], dtype=float).reshape(-1, len(value_cols))
            vals = np.vstack([tail, fresh[value_cols].to_numpy(dtype=float, na_value=np.nan)])
            off = len(tail)
            res = {UNIT: fresh[UNIT].to_numpy(), CYCLE: fresh[CYCLE].to_numpy()}
            for n in windows:
                m, s = _window_stats(vals, n)
                for i, c in enumerate(value_cols):
                    # rows of the tail belong to earlier windows only
                    res[f"{c}_rolling_mean_{n}"] = m[off:, i]
                    res[f"{c}_rolling_std_{n}"] = s[off:, i]
            for c in value_cols:
                x = fresh[c].astype("float64").to_numpy()
                before = tuple(st["ema"].get(c, EMPTY))
                e, own, _ = segmented_ema(x, np.array([0]), before, decay, alpha)
                st["ema"][c] = joined(before, own, decay, alpha)
                res[f"{c}_ema"] = np.nan_to_num(e, nan=0.0)
            for c in degr:
                x = np.nan_to_num(fresh[c].astype("float64").to_numpy(), nan=0.0)
                prev = st["last"].get(c)
                d = np.diff(np.r_[x[0] if prev is None else prev, x])
                res[f"{c}_rate_of_change"] = d
                cs = np.cumsum(x) + st["cum"].get(c, 0.0)
                res[f"{c}_cumsum"] = cs
                st["last"][c] = float(x[-1])
                st["cum"][c] = float(cs[-1])
            res["status"] = "ok"
            out_rows.append(pd.DataFrame(res))
            st["tail"] = [[None if v != v else float(v) for v in row] for row in vals[-keep:]]
            st["cycle"] = int(fresh[CYCLE].max())
        if late.any():
            lp = pdf[late]
            lr = {f.name: np.full(len(lp), np.nan) for f in schema.fields}
            lr[UNIT], lr[CYCLE] = lp[UNIT].to_numpy(), lp[CYCLE].to_numpy()
            lr["status"] = "late"
            out_rows.append(pd.DataFrame(lr))
        state.update((json.dumps(st),))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        for r in out_rows:
            yield r[[f.name for f in schema.fields]]
    return fn, schema


def stream_features(stream: DataFrame, value_cols: list[str], windows=WINDOW_SIZES,
                    timeout_ms: int | None = None, span: float = EMA_SPAN) -> DataFrame:
    from wearline.session import ship_package
    ship_package(stream.sparkSession)     # the state function runs in Python workers
    degr = degradation_columns(stream.columns)
    fn, schema = make_state_fn(value_cols, degr, windows, span, timeout_ms)
    state_schema = T.StructType([T.StructField("json", T.StringType())])
    return stream.groupBy(UNIT).applyInPandasWithState(
        fn, schema, state_schema, "append",
        GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
