"""Near-duplicate vectors (operator 2).

Equal vectors become one node. Unit vectors are rotated by three rounds of
random signs and fast Hadamard transforms and hashed to the nearest vertex of
the cross-polytope, several hashes to a table and several tables; probes of the
next nearest vertices look into more buckets. Vectors that meet in a bucket are
compared exactly, in double precision. A bucket is cut into blocks, and every
pair of its blocks is a task of its own, so large buckets are compared in full
by many bounded tasks. A pair that meets in several buckets counts in the first
of them only. Tasks return link counts and a spanning forest of the links, not
the links themselves.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing; vectors of different lengths are
never linked; equal vectors are linked. Rows with a null id link with nothing,
have a null component and are not kept. Rows that share an id count as rows of
their own. Other columns are ignored. The hashes miss a few pairs: tables are
as many as random pairs at ``min_cosine`` need to meet with a share of
``LEAST_RECALL``, whatever the number of hashes, and so of rows; tests compare
with brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm.common import map_batches, materialise, ship_package
from wearline.llm.components import components

#: Vectors of one block of a bucket.
BLOCK = 1024
#: Share of pairs at ``min_cosine`` that meet, and the fewest and most tables for it.
LEAST_RECALL, FEWEST_TABLES, MOST_TABLES = 0.995, 10, 80


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, hashes: int, tables: int, probes: int, seed: int) -> np.ndarray:
    """Bucket numbers (vector, table, 1 + probes) of unit vectors: the own
    bucket first, then those one vertex off, the closest calls first."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    x = np.hstack([x, np.zeros((n, size - d))])
    rng = np.random.default_rng([seed, d])
    out = np.zeros((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        own, step, gap = np.zeros(n, np.int64), [], []
        for j in range(hashes):
            y = x
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], size))
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :min(3, size)]
            value = y[rows[:, None], near]
            vertex = near + size * (value < 0)
            weight = (2 * size) ** j
            own += vertex[:, 0] * weight
            for i in range(1, vertex.shape[1]):
                step.append((vertex[:, i] - vertex[:, 0]) * weight)
                gap.append(np.abs(value[:, 0]) - np.abs(value[:, i]))
        out[:, t, :] = own[:, None]
        if step:
            best = np.argsort(np.array(gap), axis=0, kind="stable")[:probes]
            out[:, t, 1:1 + len(best)] += np.array(step)[best, rows].T
    # One number for (length, table, bucket).
    return out * (tables * 65537) + np.arange(tables)[None, :, None] * 65537 + d % 65537


def _meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first table where the vectors of codes a and b meet, and
    the bucket that counts there."""
    own = a[:, :, 0] == b[:, :, 0]
    ab = (a[:, :, :1] == b[:, :, 1:]).any(axis=2)
    ba = (b[:, :, :1] == a[:, :, 1:]).any(axis=2)
    first = (own | ab | ba).argmax(axis=1)
    i = np.arange(len(a))
    x, y = a[i, first, 0], b[i, first, 0]
    ab, ba = ab[i, first], ba[i, first]
    return first, np.where(ab & ba, np.minimum(x, y), np.where(ab, x, y))


def meeting_share(size: int, min_cosine: float, hashes: int, tables: int, probes: int, seed: int) -> np.ndarray:
    """Share of random pairs at ``min_cosine`` that meet in the first 1, 2, ...
    ``tables``: as counted, or as tables of their own chance give it, if less."""
    n = min(1500, max(256, (1 << 17) // size))
    rng = np.random.default_rng([seed, size, 1])
    x, y = (_unit(rng.standard_normal((n, size))) for _ in range(2))
    if size > 1:
        y = _unit(y - (x * y).sum(axis=1, keepdims=True) * x)
        y = min_cosine * x + math.sqrt(max(0.0, 1 - min_cosine ** 2)) * y
    else:
        y = x
    a, b = (codes(v, hashes, tables, probes, seed) for v in (x, y))
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2))
    alone = 1 - (1 - met.mean()) ** np.arange(1, tables + 1)
    return np.minimum(np.logical_or.accumulate(met, axis=1).mean(axis=0), alone)


def settings(total: int, sizes: list[int], min_cosine: float, probes: int, hashes: int | None, seed: int) -> tuple[int, int]:
    """(hashes, tables) for ``total`` vectors of these padded lengths: as many
    hashes as give about a bucket for every vector, fewer if ``MOST_TABLES``
    would not hold ``LEAST_RECALL`` of the pairs; without a hash all meet."""
    base = math.log(2 * max(sizes, default=1))
    wanted = max(1, min(math.ceil(math.log(max(total, 2)) / base), int(40 * math.log(2) / base))) if hashes is None else hashes
    for k in range(wanted, 0, -1):
        tables = FEWEST_TABLES
        while True:
            share = np.min([meeting_share(d, min_cosine, k, tables, probes, seed) for d in sizes or [1]], axis=0)
            enough = np.flatnonzero(share >= LEAST_RECALL)
            if len(enough):
                return k, max(FEWEST_TABLES, int(enough[0]) + 1)
            if tables == MOST_TABLES:
                break
            need = tables * math.log(1 - LEAST_RECALL) / math.log(min(1 - 1e-9, 1 - share[-1]))
            tables = min(MOST_TABLES, max(tables + 4, math.ceil(1.1 * need)))
        if hashes is not None:
            return k, MOST_TABLES
    return 0, 1


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least reachable number of every one of n nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(bucket: int, block: np.ndarray, main: np.ndarray, x: np.ndarray, code: np.ndarray, count: np.ndarray,
             lo: int, hi: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts of the vectors of a block pair and their forest's labels."""
    n = len(x)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    links, pairs = np.zeros(n, np.int64), []
    for s in range(0, len(left), 256):
        rows = left[s:s + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= least)
        i, j = rows[i], right[j]
        ok = (main[i] | main[j]) & ((i < j) if lo == hi else True)
        i, j = i[ok], j[ok]
        for c in range(0, len(i), 100_000):
            u, v = i[c:c + 100_000], j[c:c + 100_000]
            _, counts_in = _meet(code[u], code[v])
            u, v = u[counts_in == bucket], v[counts_in == bucket]
            np.add.at(links, u, count[v])
            np.add.at(links, v, count[u])
            pairs.append((u, v))
    if not pairs:
        return links, np.arange(n)
    u, v = (np.concatenate(p) for p in zip(*pairs))
    return links, _forest(u, v, n)


_FOUND = T.StructType([T.StructField("rep", T.LongType()), T.StructField("links", T.LongType()),
                       T.StructField("other", T.LongType())])
_PAIRED = ("bucket", "lo", "hi", "rep", "main", "n", "vec", "code")


def _matrix(col: pa.Array, dtype) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(col), -1)


def _link_tasks(least: float, tables: int, probes: int):
    """Compare block pairs that arrive in order of (bucket, lo, hi)."""

    def group(t: pa.Table) -> pa.RecordBatch:
        bucket, lo, hi = (t[c][0].as_py() for c in ("bucket", "lo", "hi"))
        rep = t["rep"].to_numpy()
        block = t["block"].to_numpy()
        x = _unit(_matrix(t["vec"], np.float64))
        code = _matrix(t["code"], np.int64).reshape(len(x), tables, 1 + probes)
        links, label = _compare(bucket, block, t["main"].to_numpy(), x, code, t["n"].to_numpy(), lo, hi, least)
        some = (links > 0) | (label != np.arange(len(x)))
        other = rep[label]
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(other[some])], names=_FOUND.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            keys = np.array([held[c].to_numpy() for c in ("bucket", "lo", "hi")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
            for a, z in zip(cuts[:-1], cuts[1:]):
                yield group(held.slice(a, z - a))
            held = held.slice(cuts[-1]).combine_chunks()
        if held is not None and held.num_rows:
            yield group(held)

    return run


def similar_vectors(df: DataFrame, min_cosine: float = 0.9, tables: int | None = None, probes: int = 2, hashes: int | None = None,
                    id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11) -> DataFrame:
    """Per row: id, ``n_links`` (other rows with cosine >= ``min_cosine``),
    ``component_id`` (least id that links reach) and ``kept``. ``hashes`` per
    table and ``tables`` default to what ``settings`` chooses."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size("vec") > 0) & ~odd & F.exists("vec", lambda v: v != 0), F.lit(False))
    good = rows.filter(usable)
    nodes = materialise(good.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
                        .select("rep", "n", "vec"), "vectors")
    size = F.expr("shiftleft(1, if(size(vec) > 1, length(bin(size(vec) - 1)), 0))").alias("size")
    by_size = nodes.groupBy(size).count().collect()  # one row for each power of two
    if hashes is None or tables is None:
        best = settings(sum(r["count"] for r in by_size), [r["size"] for r in by_size], min_cosine, probes, hashes, seed)
        hashes, tables = (best[0] if hashes is None else hashes), (best[1] if tables is None else tables)

    def hashed(b: pa.RecordBatch) -> Iterator[list]:
        vecs = b.column(2)
        sizes = np.diff(np.array(vecs.offsets))
        for d in np.unique(sizes):
            part = pa.RecordBatch.from_arrays(b.columns, names=list(b.schema.names)).filter(pa.array(sizes == d))
            for s in range(0, part.num_rows, 2000):
                p = part.slice(s, 2000)
                c = codes(_unit(_matrix(p.column(2), np.float64)), hashes, tables, probes, seed)
                yield [p.column(0), p.column(1), p.column(2), list(c.reshape(len(c), -1))]

    schema = T.StructType(nodes.schema.fields + [T.StructField("code", T.ArrayType(T.LongType()))])
    coded = materialise(map_batches(nodes, schema, hashed), "vector-codes")
    spots = (coded.select("rep", F.posexplode("code").alias("i", "bucket"))
             .groupBy("rep", "bucket").agg(F.min(F.col("i") % (1 + probes)).alias("i"))
             .select("rep", "bucket", (F.col("i") == 0).alias("main")))
    sizes = (spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("main").cast("int")).alias("mains"))
             .filter("m > 1 AND mains > 0").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    placed = spots.join(sizes, "bucket").select("bucket", "rep", "main", "blocks", block)
    paired = (placed.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
              .select("bucket", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "rep", "main", "block"))
    tasks = (paired.join(coded, "rep").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi"))
    found = materialise(tasks.mapInArrow(_link_tasks(min_cosine, tables, probes), _FOUND), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    label = (nodes.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
             .select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    out = (good.join(label, "vec").select("id", "n_links", "component_id")
           .union(rows.filter(~usable).select("id", F.lit(0).cast("long"), F.col("id"))))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
