"""Exact search for the k rows of greatest integer inner product.

Components become integers, ``floor(scale * x)``. A query meets all rows, in
cells of a block of queries and a shard of rows, and in a cell most pairs are
settled by segment statistics, coarse to fine: cut into segments of length
``L`` with means ``m`` and standard deviations ``s``, the squared distance of
two vectors is at least ``sum L ((m - m')^2 + (s - s')^2)``. With both norms
known, a lower bound of the distance is an upper bound of the inner product,
``sum L (m m' + s s')``. Pairs whose bound is below the query's k-th best score
so far are done; the next level has shorter segments; survivors of the last
level are computed exactly.

Bounds are floats with a margin for their rounding, exact scores are integer
sums (floats where these hold every partial sum exactly, else 64-bit or Python
integers). Of equal vectors only the ``k + 1`` first by id can be among
anyone's k best, so a large group of copies enters the search as that many
rows and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm.common import each, map_batches, materialise
from wearline.session import ship_package

#: Segments of the levels, as far as a vector has more components than that.
LEVELS = (1, 4, 16)
#: Rows of a cell that are looked at together: queries, and rows of the table.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 128, 1 << 14
_LONG = (1 << 63) - 1

_CODED = T.StructType([T.StructField("id", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("code", T.BinaryType())])


def encode(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, dim, code) of the rows that take part; a code holds the integers
    of 16 bits, or of 64 where those do not do (limited to a long)."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd)

    def codes(b: pa.RecordBatch) -> Iterator[list]:
        ids, col = b.column("id"), b.column("v")
        ends = np.asarray(col.offsets)
        with np.errstate(over="ignore"):
            x = np.floor(scale * col.values.to_numpy(zero_copy_only=False)[: ends[-1]]) if ends[-1] else np.zeros(0)
        out = []
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
            v = x[s:e]
            if len(v) and np.abs(v).max() > 32767:
                whole = np.where(np.abs(v) < 2.0 ** 63, v, 0).astype(np.int64)
                out.append(np.where(v >= 2.0 ** 63, _LONG, np.where(v <= -(2.0 ** 63), -_LONG, whole)).astype("<i8").tobytes())
            else:
                out.append(v.astype("<i2").tobytes())
        yield [ids, np.diff(ends).astype(np.int32), out]

    return map_batches(rows, _CODED, codes)


def matrix(codes: pa.Array, dim: int) -> np.ndarray:
    """Codes of one length as integer rows."""
    if dim == 0:
        return np.zeros((len(codes), 0), np.int64)
    raw = [c.as_buffer() for c in codes]
    wide = [len(r) == 8 * dim for r in raw]
    if not any(wide):
        return np.frombuffer(b"".join(raw), "<i2").reshape(-1, dim)
    return np.stack([np.frombuffer(r, "<i8" if w else "<i2").astype(np.int64) for r, w in zip(raw, wide)])


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of their length:
    the product of two such rows bounds the inner product from above."""
    dim = x.shape[1]
    cut = np.linspace(0, dim, segments + 1).astype(int)
    size = np.diff(cut).astype(np.float64)
    v = x.astype(np.float64)
    total = np.add.reduceat(v, cut[:-1], axis=1)
    mean = total / size
    rest = np.add.reduceat((v - np.repeat(mean, np.diff(cut), axis=1)) ** 2, cut[:-1], axis=1)
    return np.concatenate([total / np.sqrt(size), np.sqrt(rest)], axis=1)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def exact_kind(q: np.ndarray, x: np.ndarray):
    """A type in which all partial sums of the products are exact."""
    most = _largest(q) * _largest(x) * max(1, q.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most <= _LONG else object


def _scores(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (a[i], b[i]), many pairs through one product."""
    if len(a) * 8 >= q.shape[0] * x.shape[0]:
        s = (q @ x.T)[a, b]
    else:
        s = np.concatenate([(q[a[i:i + 65536]] * x[b[i:i + 65536]]).sum(axis=1) for i in range(0, len(a), 65536)] or [np.zeros(0, q.dtype)])
    if s.dtype == object:
        return np.array([max(-_LONG, min(_LONG, int(v))) for v in s.tolist()], np.int64)
    return s.astype(np.int64)


def _first_k(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each one's k best, by falling score and rising id."""
    by = np.lexsort((ids, -score, who))
    w = who[by]
    starts = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, int)
    place = np.arange(len(w)) - np.repeat(starts, np.diff(np.append(starts, len(w))))
    return by[place < k]


def search_cell(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int,
                tally: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of the k best rows of ``x`` for each query,
    its own row left out. ``tally`` counts the pairs left after each level."""
    kind = exact_kind(q, x)
    bounds = np.float32 if kind in (np.float32, np.float64) else np.float64
    levels = [m for m in LEVELS if m < q.shape[1]]
    by = np.argsort(x_ids, kind="stable")
    x, x_ids = x[by], x_ids[by]
    first = np.searchsorted(x_ids, q_ids)
    out = []
    for s in range(0, len(q), QUERIES_AT_ONCE):
        qs = q[s:s + QUERIES_AT_ONCE]
        n = len(qs)
        q_exact = qs.astype(kind)
        q_stats = [segment_stats(qs, m).astype(bounds) for m in levels]
        q_norm = np.sqrt((qs.astype(np.float64) ** 2).sum(axis=1))
        own = {}
        for i, at in enumerate(first[s:s + n].tolist()):
            while at < len(x_ids) and x_ids[at] == q_ids[s + i]:
                if np.array_equal(x[at], qs[i]):
                    own.setdefault(at // ROWS_AT_ONCE, []).append((i, at % ROWS_AT_ONCE))
                    break
                at += 1
        who, best, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        limit = np.full(n, -np.inf)
        for c in range(0, len(x), ROWS_AT_ONCE):
            xs, ids = x[c:c + ROWS_AT_ONCE], x_ids[c:c + ROWS_AT_ONCE]
            x_exact = xs.astype(kind)
            x_norm = np.sqrt((xs.astype(np.float64) ** 2).sum(axis=1).max())
            slack = 1e-5 * q_norm * x_norm + 1e-3
            alive = np.ones((n, len(xs)), bool)
            for i, at in own.get(c // ROWS_AT_ONCE, []):
                alive[i, at] = False
            for level, m in enumerate(levels):
                rows = np.flatnonzero(alive.any(axis=0))
                if not len(rows):
                    break
                bound = q_stats[level] @ segment_stats(xs[rows], m).astype(bounds).T + slack[:, None]
                if level + 1 == len(levels) and not np.isfinite(limit).all():
                    # no k-th best yet: the pairs of greatest bound give one
                    bound[~alive[:, rows]] = -np.inf
                    top = min(len(rows), 4 * k)
                    cols = np.argpartition(-bound, top - 1, axis=1)[:, :top]
                    a, b = np.repeat(np.arange(n), top), rows[cols.ravel()]
                    ok = alive[a, b]
                    a, b = a[ok], b[ok]
                    score = _scores(q_exact, x_exact, a, b)
                    kept = _first_k(a, score, ids[b], k)
                    full = np.bincount(a[kept], minlength=n) >= k
                    least = np.full(n, np.inf)
                    np.minimum.at(least, a[kept], score[kept].astype(np.float64))
                    limit = np.where(full, np.maximum(limit, least), limit)
                alive[:, rows] &= bound >= limit[:, None]
                if tally is not None:
                    tally[m] = tally.get(m, 0) + int(alive.sum())
            a, b = np.nonzero(alive)
            if tally is not None:
                tally["pairs"] = tally.get("pairs", 0) + n * len(xs)
                tally["exact"] = tally.get("exact", 0) + len(a)
            score = _scores(q_exact, x_exact, a, b)
            good = score >= limit[a]
            who, best, found = np.append(who, a[good]), np.append(best, score[good]), np.append(found, ids[b[good]])
            kept = _first_k(who, best, found, k)
            who, best, found = who[kept], best[kept], found[kept]
            full = np.bincount(who, minlength=n) >= k
            least = np.full(n, np.inf)
            np.minimum.at(least, who, best.astype(np.float64))
            limit = np.where(full, np.maximum(limit, least), limit)
        out.append((who + s, found, best))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


_FOUND = T.StructType([T.StructField("q", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int = 1 << 19, block_queries: int = 1 << 17) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``every`` the ``k`` other rows of greatest inner product, all if fewer;
    equal scores go by smaller id.

    Rows with a null id, a null vector, or null or non-finite components take
    no part. Vectors are compared with those of their own length; empty ones
    have inner product 0. A repeated id is a row, and as a query a search, of
    its own, in which only the row itself is left out. Scores beyond a long are
    given as the nearest long. An empty table gives no rows. A cell has about
    ``shard_rows`` rows and ``block_queries`` queries at most."""
    spark = vectors.sparkSession
    ship_package(spark)
    coded = materialise(encode(vectors, id_col, vec_col, scale), "coded")
    asked = coded.filter(F.col("id") % every == 0).groupBy("id", "dim", "code").agg(F.count(F.lit(1)).alias("times"))
    asked = materialise(asked.select(F.monotonically_increasing_id().alias("q"), "*"), "asked")
    copies = F.row_number().over(Window.partitionBy("dim", "code").orderBy("id"))
    held = materialise(coded.withColumn("r", copies).filter(F.col("r") <= k + 1).drop("r"), "held")
    rows, queries = held.count(), asked.count()
    width = spark.sparkContext.defaultParallelism
    shards = max(-(-rows // shard_rows), min(width, -(-rows // 4096)), 1)
    blocks = max(-(-queries // block_queries), 1)
    # equal vectors share a shard, so a query's own row is found once
    cells = held.select("dim", F.pmod(F.xxhash64("code"), F.lit(shards)).alias("shard"),
                        each(blocks).alias("block"),
                        F.lit(None).cast("bigint").alias("q"), "id", "code")
    cells = cells.unionByName(asked.select(
        "dim", each(shards).alias("shard"),
        F.pmod("q", F.lit(blocks)).alias("block"), "q", "id", "code"))

    def cell(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        is_row = t.column("q").is_null()
        xs, qs = t.filter(is_row), t.filter(pc.invert(is_row))
        got = (np.zeros(0, np.int64),) * 3
        if xs.num_rows and qs.num_rows:
            who, ids, score = search_cell(matrix(qs.column("code").combine_chunks(), dim), qs.column("id").to_numpy(),
                                          matrix(xs.column("code").combine_chunks(), dim), xs.column("id").to_numpy(), k)
            got = (qs.column("q").to_numpy()[who], ids, score)
        return pa.table([pa.array(c, pa.int64()) for c in got], names=_FOUND.names)

    found = cells.groupBy("dim", "shard", "block").applyInArrow(cell, _FOUND)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return (best.join(asked.select("q", F.col("id").alias("query_id"), "times"), "q")
            .select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("t")).drop("t"))
