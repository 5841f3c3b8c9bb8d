"""Segmented prefix scan without a single-task window.

``ranked(df, keys, order, sums, emas)`` adds, for every row, its 1-based
position ``_rn`` within its key group (ordered by ``order``), running totals
``<s>_cum`` of the ``sums`` columns, exponential averages ``<c>_ema`` of the
``emas`` columns and the following row's values ``<c>_next`` of the ``nexts``
columns (null at a group's end), but a hot key group (or no key at all: a global order) is
spread over many tasks:

1. ``repartitionByRange(keys, order)`` + ``sortWithinPartitions``; the result
   is checkpointed to the cluster's checkpoint folder so partition contents and
   ids stay fixed between the two passes and across executor loss;
2. pass 1 emits, per partition, a summary of its first and last key run (at
   most 2 rows per partition): only these can continue across a boundary;
3. the driver joins these summaries into the state with which the first run
   of each partition begins, and the row that follows its last one;
4. pass 2 adds the running values (numpy, Arrow batches).

Keys are compared null-safe. Rows tied on ``(keys, order)`` fall into one
partition; their relative order is arbitrary, so callers add tie-breakers
where order matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.session import ensure_checkpoint_dir, ship_package


def run_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First rows of the runs of equal keys (nulls equal nulls, NaN NaN)."""
    n = batch.num_rows
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        col = batch.column(k)
        a, b = col.slice(1), col.slice(0, n - 1)
        same = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.and_(a.is_null(), b.is_null()), pc.equal(a, b))
        if pa.types.is_floating(col.type):
            same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        change[1:] |= ~same.to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(change)


def row_key(batch: pa.RecordBatch, keys: list[str], i: int) -> tuple:
    """A comparable key: NaN, which differs from itself, as text."""
    out = [batch.column(k)[i].as_py() for k in keys]
    return tuple("NaN" if isinstance(v, float) and v != v else v for v in out)


# --- exponential averages over gaps ------------------------------------------------
#
# A series' summary is (rows, lead, first, factor, value, tail): rows in all,
# rows before the first value, that value, the factor by which a change of the
# average there reaches the end, the average at the end, and rows after the
# last value. ``lead`` is None without any value.

EMPTY = (0, None, 0.0, 0.0, 0.0, 0)


def _keep(gap, decay: float, alpha: float):
    """Weight that the earlier average keeps at a value ``gap`` rows later."""
    old = decay ** np.asarray(gap, float)
    return old / (old + alpha)


def joined(s: tuple, t: tuple, decay: float, alpha: float) -> tuple:
    """Summary of two parts of one series, one after the other."""
    if t[1] is None:
        return (s[0] + t[0], *s[1:5], s[5] + t[0]) if s[1] is not None else (s[0] + t[0], None, 0.0, 0.0, 0.0, 0)
    if s[1] is None:
        return (s[0] + t[0], s[0] + t[1], *t[2:])
    p = float(_keep(s[5] + t[1] + 1, decay, alpha))
    at = p * s[4] + (1 - p) * t[2]
    return (s[0] + t[0], s[1], s[2], s[3] * p * t[3], t[3] * (at - t[2]) + t[4], t[5])


def segmented_ema(x: np.ndarray, starts: np.ndarray, before: tuple, decay: float, alpha: float):
    """Averages of ``x`` (NaN: no value) restarted at ``starts``; the first
    segment continues a series with the summary ``before``. Returns them and
    the summaries, without ``before``, of the first and the last segment."""
    n = len(x)
    ends = np.append(starts[1:], n)
    seg = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.flatnonzero(~np.isnan(x))
    own = seg[at]
    first = np.ones(len(at), bool)
    first[1:] = own[1:] != own[:-1]
    gap = np.ones(len(at))
    gap[1:] = np.diff(at)
    a = np.where(first, 0.0, _keep(gap, decay, alpha))
    weight = a.copy()
    v = np.where(first, 1.0, 1.0 - a) * x[at]
    if len(at) and own[0] == 0 and before[1] is not None:
        p = float(_keep(before[5] + at[0] + 1, decay, alpha))
        v[0] = p * before[4] + (1 - p) * x[at[0]]
    step = 1
    while step < len(a) and a.any():
        v[step:] += a[step:] * v[:-step].copy()
        a[step:] *= a[:-step].copy()
        a[a < 1e-300] = 0.0
        step *= 2
    last = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(n)))
    filled = np.full(n, np.nan)
    held = (last >= 0) & (last >= starts[seg])
    place = np.zeros(n, np.int64)
    place[at] = np.arange(len(at))
    filled[held] = v[place[last[held]]]
    if before[1] is not None:
        filled[(seg == 0) & ~held] = before[4]

    def summary(s: int, value_shift: float) -> tuple:
        mine = np.flatnonzero(own == s)
        rows = int(ends[s] - starts[s])
        if not len(mine):
            return (rows, None, 0.0, 0.0, 0.0, 0)
        factor = float(np.prod(weight[mine[1:]]))
        x1 = float(x[at[mine[0]]])
        return (rows, int(at[mine[0]] - starts[s]), x1, factor, float(v[mine[-1]]) - factor * value_shift,
                int(ends[s] - 1 - at[mine[-1]]))

    shift = float(v[0] - x[at[0]]) if len(at) and own[0] == 0 else 0.0
    return filled, summary(0, shift), summary(len(starts) - 1, shift if len(starts) == 1 else 0.0)


def _floats(batch: pa.RecordBatch, c: str) -> np.ndarray:
    return pc.cast(batch.column(c), pa.float64(), safe=False).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


class _Carry:
    """State of the current run at the start of a batch."""

    def __init__(self, sums: int, emas: int):
        self.count, self.sums, self.emas = 0, [0.0] * sums, [EMPTY] * emas


def _scan_batch(b: pa.RecordBatch, starts: np.ndarray, carry: _Carry, sums: list[str], emas: list[str], decay: float,
                alpha: float):
    """Running values of a batch whose first run continues ``carry``, and the
    states of its first and last run at their ends in this batch."""
    n = b.num_rows
    size = np.diff(np.append(starts, n))
    rn = np.arange(n) - np.repeat(starts, size) + 1
    rn[:size[0]] += carry.count
    first, last = _Carry(0, 0), _Carry(0, 0)
    first.count = carry.count + int(size[0])
    last.count = first.count if len(starts) == 1 else int(size[-1])
    totals = []
    for j, s in enumerate(sums):
        v = np.nan_to_num(_floats(b, s), nan=0.0)
        tot = _segment_cumsum(v, starts, size)
        tot[:size[0]] += carry.sums[j]
        totals.append(tot)
        first.sums.append(float(tot[size[0] - 1]))
        last.sums.append(float(tot[-1]))
    averages = []
    for j, c in enumerate(emas):
        e, s0, s1 = segmented_ema(_floats(b, c), starts, carry.emas[j], decay, alpha)
        averages.append(e)
        whole = joined(carry.emas[j], s0, decay, alpha)
        first.emas.append(whole)
        last.emas.append(whole if len(starts) == 1 else s1)
    return rn, totals, averages, first, last


def _segment_cumsum(v: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running sums within segments; no total of other segments enters (and
    leaves) a sum. Many segments take their steps at once."""
    out = v.copy()
    if len(starts) < 64:
        for a, n in zip(starts.tolist(), size.tolist()):
            np.cumsum(out[a:a + n], out=out[a:a + n])
        return out
    by = np.argsort(-size, kind="stable")
    s, n = starts[by], size[by]
    for off in range(1, int(n[0])):
        live = s[:np.searchsorted(-n, -off, "left")]
        out[live + off] += out[live + off - 1]
    return out


def ranked(df: DataFrame, keys: list[str] | None = None, order: list | None = None,
           sums: list[str] | None = None, n_parts: int | None = None, emas: list[str] | None = None,
           span: float = 5, nexts: list[str] | None = None) -> DataFrame:
    keys = list(keys or [])
    nexts = list(nexts or [])
    order = list(order or [])
    sums = list(sums or [])
    emas = list(emas or [])
    decay, alpha = (span - 1.0) / (span + 1.0), 2.0 / (span + 1.0)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    sort_cols = [F.col(k) for k in keys] + [o if isinstance(o, Column) else F.col(o) for o in order]
    # without an explicit count AQE may merge adjacent ranges (order is kept);
    # the range-partition id is stored as data after that: TaskContext ids
    # shift when the output is later unioned with other frames
    rp = df.repartitionByRange(n_parts, *sort_cols) if n_parts else df.repartitionByRange(*sort_cols)
    base = (rp.sortWithinPartitions(*sort_cols)
            .withColumn("_pid", F.spark_partition_id())
            .checkpoint(eager=True))

    # ---- pass 1: first/last run summaries per partition ---------------------------
    parts = ("rows", "lead", "first", "factor", "value", "tail")
    p1 = T.StructType(
        [T.StructField("_pid", T.IntegerType()), T.StructField("_edge", T.IntegerType())]
        + [T.StructField(f"_k{i}", df.schema[k].dataType, True) for i, k in enumerate(keys)]
        + [T.StructField("_cnt", T.LongType())]
        + [T.StructField(f"_s{i}", T.DoubleType()) for i in range(len(sums))]
        + [T.StructField(f"_e{i}_{x}", T.DoubleType()) for i in range(len(emas)) for x in parts]
        + [T.StructField(f"_n{i}", df.schema[c].dataType, True) for i, c in enumerate(nexts)])
    need = ["_pid", *dict.fromkeys(keys + sums + emas + nexts)]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = cur = key = None
        for b in batches:
            if b.num_rows == 0:
                continue
            starts = run_starts(b, keys)
            goes_on = key is not None and row_key(b, keys, 0) == key
            carry = cur[1] if goes_on else _Carry(len(sums), len(emas))
            *_, a, z = _scan_batch(b, starts, carry, sums, emas, decay, alpha)
            if goes_on:
                cur[1] = a
            else:
                cur = [b.slice(0, 1), a]
                first = first or cur
            if len(starts) > 1:
                cur = [b.slice(b.num_rows - 1, 1), z]
            key = row_key(b, keys, b.num_rows - 1)
        rows = [] if first is None else [(0, first)] + ([(1, cur)] if cur is not first else [])
        if not rows:
            return
        cols = [pa.concat_arrays([r.column("_pid") for _, (r, _) in rows]), pa.array([e for e, _ in rows], pa.int32())]
        cols += [pa.concat_arrays([r.column(k) for _, (r, _) in rows]) for k in keys]
        cols += [pa.array([c.count for _, (_, c) in rows], pa.int64())]
        cols += [pa.array([c.sums[i] for _, (_, c) in rows], pa.float64()) for i in range(len(sums))]
        for i in range(len(emas)):
            for j in range(len(parts)):
                vals = [c.emas[i][j] for _, (_, c) in rows]
                cols.append(pa.array([None if v is None else float(v) for v in vals], pa.float64()))
        cols += [pa.concat_arrays([r.column(c) for _, (r, _) in rows]) for c in nexts]
        yield pa.RecordBatch.from_arrays(cols, names=p1.names)

    found = base.select(*need).mapInArrow(edges, p1).collect()
    begin: dict[int, tuple] = {}
    key = state = None
    for r in sorted(found, key=lambda r: (r["_pid"], r["_edge"])):
        k = tuple("NaN" if isinstance(v, float) and v != v else v for v in (r[f"_k{i}"] for i in range(len(keys))))
        own = (r["_cnt"], [r[f"_s{i}"] for i in range(len(sums))],
               [tuple(int(v) if x in ("rows", "lead", "tail") and v is not None else v
                      for x, v in ((x, r[f"_e{i}_{x}"]) for x in parts)) for i in range(len(emas))])
        if r["_edge"] == 0 and key is not None and k == key:
            begin[r["_pid"]] = state
            own = (own[0] + state[0], [a + b for a, b in zip(own[1], state[1])],
                   [joined(a, b, decay, alpha) for a, b in zip(state[2], own[2])])
        key, state = k, own

    # the first row of the partition that follows, by partition
    after: dict[int, tuple] = {}
    following = None
    for r in sorted(found, key=lambda r: (-r["_pid"], r["_edge"])):
        if r["_edge"] == 0:
            after[r["_pid"]] = following
            k = tuple("NaN" if isinstance(v, float) and v != v else v for v in (r[f"_k{i}"] for i in range(len(keys))))
            following = (k, [r[f"_n{i}"] for i in range(len(nexts))])

    # ---- pass 2: running values -----------------------------------------------------
    out_fields = [f for f in base.schema.fields if f.name != "_pid"]
    names = [f.name for f in out_fields]
    out_schema = T.StructType(out_fields + [T.StructField("_rn", T.LongType())]
                              + [T.StructField(f"{s}_cum", T.DoubleType()) for s in sums]
                              + [T.StructField(f"{c}_ema", T.DoubleType()) for c in emas]
                              + [T.StructField(f"{c}_next", df.schema[c].dataType) for c in nexts])

    def with_next(out: pa.RecordBatch, first: tuple | None) -> pa.RecordBatch:
        """``nexts`` of a batch's rows; ``first``: key and values of the row after it."""
        last = out.num_rows - 1
        same = np.ones(out.num_rows, bool)
        same[run_starts(out, keys)[1:] - 1] = False
        same[last] = first is not None and row_key(out, keys, last) == first[0]
        cols = []
        for i, c in enumerate(nexts):
            col = out.column(c)
            end = pa.array([first[1][i] if same[last] else None], col.type)
            cols.append(pc.if_else(pa.array(same), pa.concat_arrays([col.slice(1), end]), pa.scalar(None, col.type)))
        return pa.RecordBatch.from_arrays([*out.columns, *cols], names=out_schema.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = cur = held = pid = None
        for b in batches:
            if b.num_rows == 0:
                continue
            carry = _Carry(len(sums), len(emas))
            if key is None:
                known = begin.get(b.column("_pid")[0].as_py())
                if known is not None:
                    carry.count, carry.sums, carry.emas = known
            elif row_key(b, keys, 0) == key:
                carry = cur
            rn, totals, averages, _, cur = _scan_batch(b, run_starts(b, keys), carry, sums, emas, decay, alpha)
            key = row_key(b, keys, b.num_rows - 1)
            out = pa.RecordBatch.from_arrays(
                [b.column(x) for x in names] + [pa.array(rn, pa.int64())] + [pa.array(t) for t in totals]
                + [pa.array(e, from_pandas=True) for e in averages], names=out_schema.names[:len(out_schema.names) - len(nexts)])
            if not nexts:
                yield out
                continue
            if held is not None:      # one batch behind: its last row needs this one's first
                yield with_next(held, (row_key(b, keys, 0), [b.column(c)[0].as_py() for c in nexts]))
            held, pid = out, b.column("_pid")[0].as_py()
        if held is not None:
            yield with_next(held, after.get(pid))

    return base.mapInArrow(scan, out_schema)


def ema_batches(df: DataFrame, keys: list[str], cols: list[str], span: float) -> DataFrame:
    """``df`` with the averages ``<c>_ema`` of its columns, one series per run of
    equal ``keys``; the rows of a run follow each other in one task."""
    ship_package(df.sparkSession)
    decay, alpha = (span - 1.0) / (span + 1.0), 2.0 / (span + 1.0)
    names = df.columns
    schema = T.StructType(df.schema.fields + [T.StructField(f"{c}_ema", T.DoubleType()) for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, [EMPTY] * len(cols)
        for b in batches:
            if b.num_rows == 0:
                continue
            starts = run_starts(b, keys)
            if key is None or row_key(b, keys, 0) != key:
                state = [EMPTY] * len(cols)
            made = []
            for j, c in enumerate(cols):
                e, head, tail = segmented_ema(_floats(b, c), starts, state[j], decay, alpha)
                made.append(pa.array(e, from_pandas=True))
                state[j] = joined(state[j], head, decay, alpha) if len(starts) == 1 else tail
            key = row_key(b, keys, b.num_rows - 1)
            yield pa.RecordBatch.from_arrays([b.column(x) for x in names] + made, names=schema.names)

    return df.mapInArrow(run, schema)


def _stats(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of windows, given as their oldest values, the
    next ones, and so on; step by step as Spark's aggregates take them."""
    total, avg, m2 = x[0] + 0.0, x[0] + 0.0, x[0] * 0.0
    for i, v in enumerate(x[1:], 2):
        total = total + v
        delta = v - avg
        part = delta / i
        avg = avg + part
        m2 = m2 + delta * (delta - part)
    return total / len(x), np.sqrt(m2 / (len(x) - 1)) if len(x) > 1 else np.zeros(len(m2))


def feature_batches(df: DataFrame, keys: list[str], cols: list[str], degr: list[str], windows, span: float) -> DataFrame:
    """``df`` with rolling means and deviations of its double columns ``cols``
    (0 where a window is not full), their exponential averages (0 before the
    first value), and differences and running sums of ``degr``, nulls counting
    as 0. One series per run of equal ``keys``; the rows of a run follow each
    other in one task. What a window looks back on is kept from batch to batch."""
    ship_package(df.sparkSession)
    decay, alpha = (span - 1.0) / (span + 1.0), 2.0 / (span + 1.0)
    back = max([1, *[n - 1 for n in windows]])
    new = [f"{c}_rolling_{kind}_{n}" for n in windows for c in cols for kind in ("mean", "std")]
    new += [f"{c}_ema" for c in cols] + [f"{c}_rate_of_change" for c in degr] + [f"{c}_cumsum" for c in degr]
    names = df.columns
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.DoubleType()) for c in new])
    series = list(dict.fromkeys([*cols, *degr]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, sums = None, [EMPTY] * len(cols), dict.fromkeys(degr, 0.0)
        tail = {c: (np.zeros(back), np.zeros(back, bool)) for c in series}
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            starts = run_starts(b, keys)
            size = np.diff(np.append(starts, n))
            place = np.arange(n) - np.repeat(starts, size)
            if key is not None and row_key(b, keys, 0) == key:
                place[:size[0]] += back
            else:
                state, sums = [EMPTY] * len(cols), dict.fromkeys(degr, 0.0)
                tail = {c: (np.zeros(back), np.zeros(back, bool)) for c in series}
            key = row_key(b, keys, n - 1)
            there = [place >= j for j in range(back + 1)]
            made: dict[str, np.ndarray] = {}
            for c in series:
                col = b.column(c)
                x = np.concatenate([tail[c][0], pc.fill_null(col, 0.0).to_numpy(zero_copy_only=False)])
                ok = np.concatenate([tail[c][1], col.is_valid().to_numpy(zero_copy_only=False)])
                lag = [x[back - j:back - j + n] for j in range(back + 1)]
                if c in cols:
                    with np.errstate(all="ignore"):
                        full = np.ones(n, bool)
                        for j in range(max(windows, default=0)):
                            full = full & there[j] & ok[back - j:back - j + n]
                            if j + 1 in windows:
                                for kind, v in zip(("mean", "std"), _stats(lag[j::-1])):
                                    made[f"{c}_rolling_{kind}_{j + 1}"] = np.where(full, v, 0.0)
                    i = cols.index(c)
                    e, head, last = segmented_ema(_floats(b, c), starts, state[i], decay, alpha)
                    state[i] = joined(state[i], head, decay, alpha) if len(starts) == 1 else last
                    made[f"{c}_ema"] = np.where(np.isnan(e), 0.0, e)
                if c in sums:
                    with np.errstate(all="ignore"):
                        made[f"{c}_rate_of_change"] = np.where(there[1], lag[0] - lag[1], 0.0)
                        v = lag[0].copy()
                        v[0] += sums[c]
                        made[f"{c}_cumsum"] = _segment_cumsum(v, starts, size)
                    sums[c] = float(made[f"{c}_cumsum"][-1])
                seen = ok[n:].copy()
                if len(starts) > 1:       # only rows of the last run go on
                    seen &= np.arange(n, n + back) >= back + starts[-1]
                tail[c] = x[n:].copy(), seen
            yield pa.RecordBatch.from_arrays([b.column(x) for x in names] + [pa.array(made[c]) for c in new], names=schema.names)

    return df.mapInArrow(run, schema)
