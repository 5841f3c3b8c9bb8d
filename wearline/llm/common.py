"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wearline.session import shared_path, ship_package, shuffles_removed


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the cluster's shared folder and read it
    back: cuts lineage, survives lost executors, is computed once."""
    path = shared_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def drop(*stored: DataFrame) -> None:
    """Delete tables that ``materialise`` stored; nothing may read them later."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text) with a number of its own for every row: the id where ids
    are unique and not null, else numbers stored with a copy of the rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    odd = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("id").isNull() | (F.col("n") > 1))
    if odd.isEmpty():
        return rows.select(F.col("id").alias("row"), "id", "text")
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "numbered")


def merge_spans(spans: DataFrame) -> DataFrame:
    """(row, spans): the union of the spans [a, z) of every row, as sorted
    disjoint ones that do not touch."""
    w = Window.partitionBy("row").orderBy("a", "z")
    seen = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (spans.select("row", "a", "z", F.when(F.col("a") <= seen, 0).otherwise(1).alias("new")).select("row", "a", "z", run.alias("u"))
            .groupBy("row", "u").agg(F.min("a").alias("a"), F.max("z").alias("z"))
            .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("spans")))


#: Side tables are broadcast up to this size, measured as stored.
BROADCAST_BYTES = 32 << 20


def small_side(stored: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its files are small enough."""
    jvm = stored.sparkSession._jvm
    conf = stored.sparkSession.sparkContext._jsc.hadoopConfiguration()
    size = sum(jvm.org.apache.hadoop.fs.Path(f).getFileSystem(conf).getFileStatus(jvm.org.apache.hadoop.fs.Path(f)).getLen()
               for f in stored.inputFiles())
    return F.broadcast(stored) if size <= BROADCAST_BYTES else stored


def each(n: int) -> Column:
    """Rows for the numbers from 0 to ``n`` - 1."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def _give_back() -> None:
    """Return freed memory to the system: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def append_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list],
                   drop: tuple[str, ...] = (), rows_at_once: int = 500) -> DataFrame:
    """``df`` with the columns ``fields`` computed by ``fn`` (one array per
    field) for ``rows_at_once`` rows of an Arrow batch at a time. Columns of ``df`` with the same name, in any case,
    are replaced; those in ``drop`` are not returned."""
    ship_package(df.sparkSession)
    gone = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = T.StructType(keep + fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    names, keep_names = schema.names, [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, rows_at_once) for b in batches for i in range(0, b.num_rows, rows_at_once)):
            new = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) and a.type == t else
                   (a.cast(t) if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, t))
                   for a, t in zip(fn(b), types)]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep_names] + new, names=names)
            del new
            pa.default_memory_pool().release_unused()
        _give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, schema: T.StructType, fn: Callable[[pa.RecordBatch], Iterator[list]]) -> DataFrame:
    """Rows made per Arrow batch: ``fn`` yields lists of columns."""
    ship_package(df.sparkSession)
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for cols in fn(b):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        _give_back()

    return df.mapInArrow(run, schema)


# --- hashing of word sequences, vectorised over a batch of texts -------------

U64 = np.uint64
_BASE_BYTE, _BASE_WORD = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), a bijection."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n (grown on demand)."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
        inv = U64(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inv):
            p = np.full(size, b, U64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        have = _POWERS[int(base)] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(2 * seed + 0x1234567)) | U64(1)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of ``values[s:e]`` for every span, by prefix sums of a polynomial
    modulo 2**64; equal sequences have equal hashes wherever they stand."""
    p, inv = powers(base, len(values) + 1)
    pre = np.zeros(len(values) + 1, U64)
    np.cumsum(values * p[:-1], out=pre[1:])
    return mix64((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(U64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets (null: empty)."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def split_words(buf: np.ndarray, off: np.ndarray, is_sep: np.ndarray = _SPACE):
    """Starts and ends (byte offsets) of the words of all rows and the number
    of the first word of every row; words never cross rows."""
    word = ~is_sep[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = off[1:-1][off[1:-1] < len(buf)]
    first[edge] = word[edge]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    back = off[1:-1][off[1:-1] > 0] - 1
    last[back] = word[back]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def row_slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` values, one row at least: what
    is worked on at once, so that memory follows the longest row at most."""
    row, rows = 0, len(off) - 1
    while row < rows:
        end = min(rows, max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1))
        yield row, end
        row = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


#: Words of more bytes are hashed by BLAKE2: polynomials modulo 2**64 have
#: known collisions among long words (Thue-Morse sequences of 1,024 letters).
LONG_WORD = 128


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    h = span_hashes(byte_table(seed)[buf], starts, ends, _BASE_BYTE)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i]:ends[i]], digest_size=8, key=bytes([seed])).digest(), "little")
    return h


def ngram_hashes(words: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from every word on, and whether they lie in one
    row (``firsts``: number of the first word of every row, and the total)."""
    m = len(words)
    i = np.arange(m, dtype=np.int64)
    row_end = np.repeat(firsts[1:], np.diff(firsts))
    ok = i + n <= row_end
    h = span_hashes(words, i, np.minimum(i + n, m), _BASE_WORD)
    return h, ok


def window_minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """For every start of ``w`` positions, the place of their leftmost least
    value by the hash's upper 32 bits, whatever else is in the batch (of fewer
    than 2**32 positions). Equal windows choose the same place in them,
    wherever they stand."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = U64(32)
    val = (h >> bits << bits) | np.arange(len(h), dtype=U64)
    have = 1
    while have < w:
        step = min(have, w - have)
        val = np.minimum(val[:len(val) - step], val[step:])
        have += step
    return (val & ((U64(1) << bits) - U64(1))).astype(np.int64)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

