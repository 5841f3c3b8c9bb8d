"""Order statistics and smallest-n selection without sorting the table.

Both narrow a bracket that holds the wanted rank: one aggregate counts the rows
per cell of the bracket (``CELLS`` rows per bracket reach the driver), the cell
with the rank is the next bracket. Tables of any size take a few scans of the
columns concerned and a partial aggregate each; nothing is sorted but the last
few rows, or the narrow band around the cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wearline.operators.scan import ranked
from wearline.session import ensure_checkpoint_dir

#: Cells a bracket is cut into by one pass.
CELLS = 1024
#: A bracket of so many rows is sorted and read instead of cut again.
NEAR_ROWS = 2000
#: Label values that count as classes; more are an error, not a collect.
MOST_CLASSES = 1000


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows of every class, a null class included."""
    rows = df.groupBy(label).count().limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"{label} has over {MOST_CLASSES} values: not a class label")
    return {r[0]: r[1] for r in rows}


# --- the n rows of smallest hash, by class -----------------------------------------

HASH = "_selection_hash"


def _cuts(df: DataFrame, label: str, ties: list[str], take: dict, top: int) -> tuple[dict, dict]:
    """By class: the (hash, ties) of its ``take``-th row, and how many rows
    with just these values to take if that is not all of them."""
    inside = lambda c, lo, hi: F.col(label).eqNullSafe(F.lit(c)) & (F.col(HASH) >= lo) & (F.col(HASH) < hi)
    open_, near, stuck = {c: (0, top, n) for c, n in take.items()}, {}, {}
    while open_:
        cond, cell = F.lit(False), F.lit(None).cast("bigint")
        for c, (lo, hi, _) in open_.items():
            mine = inside(c, lo, hi)
            cond, cell = cond | mine, F.when(mine, F.floor((F.col(HASH) - lo) / -(-(hi - lo) // CELLS))).otherwise(cell)
        found: dict = {c: {} for c in open_}
        for r in df.filter(cond).groupBy(label, cell.alias("cell")).count().collect():
            found[r[0]][r["cell"]] = r["count"]
        for c, (lo, hi, need) in list(open_.items()):
            width = -(-(hi - lo) // CELLS)
            for k in sorted(found[c]):
                if need <= found[c][k]:
                    break
                need -= found[c][k]
            open_[c] = (lo + k * width, min(hi, lo + (k + 1) * width), need)
            if found[c][k] <= NEAR_ROWS:
                near[c] = open_.pop(c)
            elif open_[c][1] - open_[c][0] <= 1:
                stuck[c] = open_.pop(c)
    cuts: dict = {}
    extra: dict = {}
    part = df.filter(_any(inside(c, lo, hi) for c, (lo, hi, _) in near.items())).orderBy(label, HASH, *ties)
    rows: dict = {c: [] for c in near}
    for r in part.collect() if near else ():
        rows[r[label]].append(tuple(r[c] for c in (HASH, *ties)))
    for c, (_, _, need) in near.items():
        cut = cuts[c] = rows[c][need - 1]
        if rows[c].count(cut) > 1 and rows[c][need:need + 1] == [cut]:
            extra[c] = need - rows[c].index(cut)
    if stuck:      # very many rows of one hash: their ties are ranked
        need = F.lit(None).cast("bigint")
        for c, (lo, hi, n) in stuck.items():
            need = F.when(inside(c, lo, hi), F.lit(n)).otherwise(need)
        rank = ranked(df.withColumn("_need", need).filter(F.col("_need").isNotNull()), [label], [HASH, *ties])
        cuts |= {r[label]: tuple(r[c] for c in (HASH, *ties)) for r in rank.filter(F.col("_rn") == F.col("_need")).collect()}
        same = rank.filter(_by_class(label, {c: cuts[c] for c in stuck}, lambda cut: _row(rank, ties).eqNullSafe(_lit(rank, ties, cut))))
        extra |= {r[label]: r["need"] - r["first"] + 1 for r in same.groupBy(label).agg(
            F.min("_rn").alias("first"), F.max("_rn").alias("last"), F.max("_need").alias("need")).collect() if r["last"] > r["need"]}
    return cuts, extra


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _row(df: DataFrame, ties: list[str]) -> Column:
    return F.struct(F.col(HASH), *[F.col(c) for c in ties])


def _lit(df: DataFrame, ties: list[str], cut: tuple) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip((HASH, *ties), cut)])


def _by_class(label: str, cuts: dict, test) -> Column:
    out = F.lit(False)
    for c, cut in cuts.items():
        out = F.when(F.col(label).eqNullSafe(F.lit(c)), test(cut)).otherwise(out)
    return out


def flag_smallest(df: DataFrame, hash_col: Column, ties: list[str], take, label: str | None, name: str,
                  top: int = 1 << 32) -> DataFrame:
    """``df`` with a boolean ``name``: whether the row is among its class's
    ``take`` rows of smallest hash (integers in [0, ``top``)), equal hashes by
    the columns ``ties`` (nulls first). Of rows that agree in all of these,
    as many as fit are marked, any of them. ``take`` maps the rows of every
    class to those wanted of it; without ``label`` the table is one class,
    None. Classes without an entry have no row marked; a number of at least
    the class's rows marks all.

    The columns concerned are stored once, so ``df`` runs once for the cut and
    once for its rows."""
    own = label or "_selection_class"
    rows = df.withColumn(HASH, hash_col)
    if label is None:
        rows = rows.withColumn(own, F.lit(None).cast("int"))
    ensure_checkpoint_dir(df.sparkSession)
    narrow = rows.select(own, HASH, *[c for c in ties if c != own]).checkpoint()
    counts = class_counts(narrow, own)
    wanted = take(counts)
    whole = [c for c, n in wanted.items() if n >= counts.get(c, 0)]
    part = {c: n for c, n in wanted.items() if 0 < n < counts.get(c, 0)}
    cuts, extra = _cuts(narrow, own, ties, part, top) if part else ({}, {})
    chosen = _by_class(own, cuts, lambda cut: _row(rows, ties) <= _lit(rows, ties, cut))
    for c in whole:
        chosen = F.when(F.col(own).eqNullSafe(F.lit(c)), F.lit(True)).otherwise(chosen)
    if not extra:
        return rows.select(*df.columns, chosen.alias(name))
    tied = _by_class(own, {c: cuts[c] for c in extra}, lambda cut: _row(rows, ties).eqNullSafe(_lit(rows, ties, cut)))
    fits = _by_class(own, extra, lambda n: F.col("_rn") <= n)
    return (rows.filter(~tied).select(*df.columns, chosen.alias(name))
            .unionByName(ranked(rows.filter(tied), [own], [HASH, *ties]).select(*df.columns, fits.alias(name))))


# --- exact order statistics ---------------------------------------------------------

def order_statistics(df: DataFrame, wanted: list[tuple[str, int]], brackets: dict[str, tuple[float, float]],
                     below: dict | None = None) -> dict:
    """(column, rank) -> value for 1-based ranks among the finite values of
    double columns; ``brackets`` hold them (by column, or by (column, rank)
    with the rows ``below`` them)."""
    out, open_ = {}, {}
    for c, rank in wanted:
        lo, hi = brackets.get((c, rank)) or brackets[c]
        open_[c, rank] = (lo, hi, (below or {}).get((c, rank), 0))
    while True:
        for key, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                out[key] = lo
                del open_[key]
        if not open_:
            return out
        kinds = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_.items()})
        items = []
        for i, (c, lo, hi) in enumerate(kinds):
            v = F.col(c)
            cell = F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * CELLS), F.lit(CELLS - 1)).cast("int")
            inside = (v >= lo) & (v <= hi)
            items.append(F.when(inside, F.struct(F.lit(i).alias("i"), cell.alias("cell"), v.alias("v"))))
        cells = (df.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.cell")
                 .agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")).collect())
        by_kind: dict = {i: [] for i in range(len(kinds))}
        for r in sorted(cells, key=lambda r: (r["i"], r["cell"])):
            by_kind[r["i"]].append(r)
        for (c, rank), (lo, hi, under) in list(open_.items()):
            for r in by_kind[kinds.index((c, lo, hi))]:
                if rank <= under + r["n"]:
                    open_[c, rank] = (r["lo"], r["hi"], under)
                    break
                under += r["n"]


def exact_quantiles(df: DataFrame, cols: list[str], qs=(0.25, 0.5, 0.75), accuracy: int = 1000, more=()) -> tuple[dict, Row]:
    """(column, q) -> the linearly interpolated quantile (as ``quantile_cont``)
    of the column's values but nulls and NaN; columns without values have none. And a
    row with the aggregates ``more`` of ``df``, from the first pass.

    1. One pass: counts, extremes, and a mergeable quantile sketch whose values
       bracket every wanted rank within ``3 / accuracy`` of all rows.
    2. One pass: the rows below and up to the brackets. A bracket that does not
       hold its rank after all is replaced by the column's extremes.
    3. The bands are cut until the cell with the rank holds one value
       (``order_statistics``), by one pass as a rule."""
    named = {f"_q{i}": c for i, c in enumerate(cols)}
    data = df.select(*[F.col(c).cast("double").alias(n) for n, c in named.items()])
    whole = df.select("*", *[F.col(c).cast("double").alias(n) for n, c in named.items()]) if more else data
    real = {n: F.when(~F.isnan(n) & (F.abs(n) < math.inf), F.col(n)) for n in named}
    marks = sorted({min(1.0, max(0.0, q + s)) for q in qs for s in (-3 / accuracy, 3 / accuracy)})
    aggs = []
    for n, x in real.items():
        aggs += [F.count(x).alias(f"{n}_n"), F.min(x).alias(f"{n}_lo"), F.max(x).alias(f"{n}_hi"),
                 F.count_if(F.col(n) == -math.inf).alias(f"{n}_neg"), F.count_if(F.col(n) == math.inf).alias(f"{n}_pos"),
                 F.percentile_approx(x, F.array(*[F.lit(m) for m in marks]), F.lit(accuracy)).alias(f"{n}_at")]
    first = whole.agg(*aggs, *more).first()
    targets: dict = {}
    values: dict = {}
    for n in named:
        size, neg, pos = first[f"{n}_n"], first[f"{n}_neg"], first[f"{n}_pos"]
        for q in qs if size + neg + pos else ():
            place = (size + neg + pos - 1) * q
            for rank in {math.floor(place) + 1, math.ceil(place) + 1}:
                if neg < rank <= neg + size:
                    at = dict(zip(marks, first[f"{n}_at"]))
                    targets[n, rank - neg] = (at[min(1.0, max(0.0, q - 3 / accuracy))], at[min(1.0, max(0.0, q + 3 / accuracy))])
                else:
                    values[n, rank] = -math.inf if rank <= neg else math.inf
    if targets:
        finite = data.select(*[x.alias(n) for n, x in real.items()])
        keys, seen = list(targets), sorted({(n, *at) for (n, _), at in targets.items()})
        counts = finite.agg(*[e for i, (n, lo, hi) in enumerate(seen) for e in (
            F.count_if(F.col(n) < lo).alias(f"b{i}"), F.count_if(F.col(n) <= hi).alias(f"u{i}"))]).first()
        below = {}
        for n, rank in keys:
            i = seen.index((n, *targets[n, rank]))
            held = counts[f"b{i}"] < rank <= counts[f"u{i}"]
            below[n, rank] = counts[f"b{i}"] if held else 0
            if not held:
                targets[n, rank] = (first[f"{n}_lo"], first[f"{n}_hi"])
        for (n, rank), v in order_statistics(finite, keys, targets, below).items():
            values[n, rank + first[f"{n}_neg"]] = v
    out = {}
    for n, c in named.items():
        size = first[f"{n}_n"] + first[f"{n}_neg"] + first[f"{n}_pos"]
        for q in qs if size else ():
            place = (size - 1) * q
            a, b = values[n, math.floor(place) + 1], values[n, math.ceil(place) + 1]
            out[c, q] = a if a == b else a + (b - a) * (place - math.floor(place))
    return out, first
