"""Byte-level BPE encoding and decoding (operator 1).

Spark splits every text into pretokens with the vocabulary's pattern. Inside
each partition the distinct pretokens become token-position rows in DuckDB; a
recursive query joins adjacent rows with the merge table, contracts each
word's leftmost pair of least rank (and the repeats that would come next), and
goes on until no word changes; after a bounded number of steps a new query
takes up the words that are left, so that a word of any length fits. Texts
take their ids from the words; decoding joins ids with their bytes and
aggregates them in order, in DuckDB too.

Defined results: a null or empty text has no tokens and decodes to no bytes; a
null id list decodes to null; ids outside the vocabulary raise an error. Rows
are handled one by one, so repeated keys, null keys and other columns pass
through (``ids`` and the like replace columns of the same name).
"""

from __future__ import annotations

import base64
import functools
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm.common import append_columns, free_name, row_slices

#: Bytes and words encoded by one recursive query, rows that its steps may make
#: together, words kept for later batches of the worker, and tokens decoded by
#: one query: bounds on a task's memory. A longer word is encoded alone.
BYTES_AT_ONCE, WORDS_AT_ONCE, ROWS_OF_STEPS = 150_000, 20_000, 1_500_000
WORDS_KEPT, TOKENS_AT_ONCE = 200_000, 100_000

#: The same for workers that share their executor with what earlier stages left
#: there: rows handed on at once, fewer words kept, and freed memory given back
#: at once, for about one and a half times the time.
LEAN_ROWS, LEAN_WORDS_KEPT = 125, 60_000
LEAN_DB = {"allocator_flush_threshold": "1MB", "allocator_bulk_deallocation_flush_threshold": "1MB"}

#: ``n`` counts steps; words not done after ``steps`` of them are read off as
#: they stand.
_ENCODE = """
WITH RECURSIVE step(k, t, alive, n) AS (
  SELECT k, t, true, 0 FROM symbols
  UNION ALL
  (WITH pair AS (SELECT k, t, lead(t) OVER (ORDER BY k) AS nt, lead(k) OVER (ORDER BY k) AS nk
                 FROM step WHERE alive AND n < {steps}),
        mergeable AS (SELECT p.k >> 32 AS w, m.r, p.k, p.nk FROM pair p JOIN merges m ON m.a = p.t AND m.b = p.nt
                      WHERE p.nk >> 32 = p.k >> 32),
        best AS (SELECT w, min({{'r': r, 'k': k, 'nk': nk}}) AS m FROM mergeable GROUP BY w)
   SELECT s.k, CASE WHEN s.k = b.m.k THEN b.m.r ELSE s.t END, b.w IS NOT NULL, s.n + 1
   FROM step s LEFT JOIN best b ON b.w = s.k >> 32
   WHERE s.alive AND s.n < {steps} AND (b.w IS NULL OR s.k <> b.m.nk)))
SELECT k, t, alive FROM step WHERE NOT alive OR n = {steps} ORDER BY k
"""

#: The same with all repeats of a pair in one step, for what is left of long
#: words after the first query. ``many`` tells that a merge makes no pair of lower rank, so that
#: after it the word's next pair is its next repeat: then all go in one step,
#: every other one of those that overlap in a row.
_ENCODE_REPEATS = """
WITH RECURSIVE step(k, t, alive, n) AS (
  SELECT k, t, true, 0 FROM symbols
  UNION ALL
  (WITH pair AS (SELECT k, t, lead(t) OVER o AS nt, lead(k) OVER o AS nk, row_number() OVER o AS p
                 FROM step WHERE alive AND n < {steps} WINDOW o AS (ORDER BY k)),
        mergeable AS (SELECT p.k >> 32 AS w, m.r, m.many, p.k, p.nk, p.p FROM pair p
                      JOIN merges m ON m.a = p.t AND m.b = p.nt WHERE p.nk >> 32 = p.k >> 32),
        least AS (SELECT w, min(r) AS r FROM mergeable GROUP BY w),
        met AS (SELECT m.*, m.p - row_number() OVER (ORDER BY m.k) AS run FROM mergeable m JOIN least USING (w, r)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY k) AS i,
                          row_number() OVER (PARTITION BY w ORDER BY k) AS j FROM met),
        taken AS (SELECT r, k, nk FROM placed WHERE i % 2 = 1 AND (many OR j = 1))
   SELECT s.k, coalesce(h.r, s.t), l.w IS NOT NULL, s.n + 1
   FROM step s LEFT JOIN least l ON l.w = s.k >> 32 LEFT JOIN taken h ON h.k = s.k
   WHERE s.alive AND s.n < {steps} AND s.k NOT IN (SELECT nk FROM taken)))
SELECT k, t, alive FROM step WHERE NOT alive OR n = {steps} ORDER BY k
"""

_DECODE = """
SELECT d, string_agg(hx, '') AS hx
FROM (SELECT tokens.d, pieces.hx FROM tokens JOIN pieces USING (id) ORDER BY tokens.o) GROUP BY d
"""


def spark_pattern(pattern: str) -> str:
    r"""The pattern for Spark's regular expressions, where ``\s`` and ``\S``
    alone mean ASCII white space only."""
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Vocabulary:
    """A worker's tables of one vocabulary, and the words it has encoded."""

    def __init__(self, path: str, lean: bool = False):
        self.words_kept = LEAN_WORDS_KEPT if lean else WORDS_KEPT
        ranks = load_ranks(path)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items()
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": "", **(LEAN_DB if lean else {})})
        a, b, r = (np.array(c, np.int32) for c in zip(*merges)) if merges else [np.zeros(0, np.int32)] * 3
        self.side_by_side = np.zeros((256, 256), bool)
        for token in ranks:
            self.side_by_side[list(token[:-1]), list(token[1:])] = True
        lower = np.unique(np.concatenate([a[r < a], b[r < b]]))
        given = pa.table({"a": a, "b": b, "r": r, "many": ~np.isin(r, lower)})
        self.db.register("given", given)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        given = pa.table({"id": np.array(list(ranks.values()), np.int32), "hx": [t.hex() for t in ranks]})
        self.db.register("given", given)
        self.db.execute("CREATE TABLE pieces AS SELECT * FROM given")
        self.db.unregister("given")
        self.known_ids = np.sort(np.array(list(ranks.values()), np.int32))
        self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        off = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        buf = np.frombuffer(words.buffers()[2], np.uint8)[off[0]:off[-1]]
        n = np.diff(off)
        word = np.repeat(np.arange(len(words), dtype=np.int64), n)
        # Bytes that no token has side by side are never merged across, so a
        # word is encoded in the parts between them.
        apart = np.ones(len(buf), bool)
        apart[1:] = (word[1:] != word[:-1]) | ~self.side_by_side[buf[:-1], buf[1:]]
        part = np.cumsum(apart, dtype=np.int64)
        k, t, done, query = (part << 32) + np.arange(len(buf)), self.byte_ids[buf], [], _ENCODE
        while len(k):
            self.db.register("symbols", pa.table({"k": k, "t": t}))
            got = self.db.sql(query.format(steps=max(1, ROWS_OF_STEPS // len(k)))).to_arrow_table()
            self.db.unregister("symbols")
            k, t, alive = (got[c].to_numpy() for c in ("k", "t", "alive"))
            done.append((k[~alive], t[~alive]))
            k, t, query = k[alive], t[alive], _ENCODE_REPEATS
        k, t = (np.concatenate(c) for c in zip(*done)) if done else (k, t)
        return t[np.argsort(k)].astype(np.int32, copy=False), np.bincount(word[k & 0xFFFFFFFF], minlength=len(words))

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: a flat array with a start and an end per word."""
        if len(self.words) > self.words_kept:
            self.forget()
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new = words.filter(at.is_null())
            ids, counts = [self.ids], [np.diff(self.ends)]
            size = np.concatenate([[0], np.cumsum(pc.binary_length(new).to_numpy())])
            for a, z in ((i, min(i + WORDS_AT_ONCE, z)) for a, z in row_slices(size, BYTES_AT_ONCE) for i in range(a, z, WORDS_AT_ONCE)):
                part = self._encode_words(new.slice(a, z - a))
                ids.append(part[0])
                counts.append(part[1])
            self.words = pa.concat_arrays([self.words, new])
            self.ids = np.concatenate(ids)
            self.ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            at = pc.index_in(words, value_set=self.words)
        at = at.to_numpy(zero_copy_only=False)
        return self.ids, self.ends[at], self.ends[at + 1]

    def decode(self, ids: np.ndarray, firsts: np.ndarray) -> list[bytes]:
        """The bytes of the rows ``ids[firsts[i]:firsts[i + 1]]``."""
        if len(ids):
            j = np.minimum(np.searchsorted(self.known_ids, ids), len(self.known_ids) - 1)
            if (self.known_ids[j] != ids).any():
                raise ValueError(f"id {ids[self.known_ids[j] != ids][0]} is not in the vocabulary")
        rows = len(firsts) - 1
        tokens = pa.table({"d": np.repeat(np.arange(rows, dtype=np.int32), np.diff(firsts)),
                           "o": np.arange(len(ids), dtype=np.int32), "id": ids})
        self.db.register("given", tokens)
        self.db.execute("CREATE OR REPLACE TEMP TABLE tokens AS SELECT * FROM given")
        self.db.unregister("given")
        got = self.db.sql(_DECODE).to_arrow_table()
        out = [b""] * rows
        for d, hx in zip(got["d"].to_pylist(), got["hx"].to_pylist()):
            out[d] = bytes.fromhex(hx)
        return out


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str, lean: bool = False) -> _Vocabulary:
    return _Vocabulary(path, lean)


def _ship(df: DataFrame, vocabulary: str) -> str:
    """Send the vocabulary file to the workers; its name there."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    return vocabulary.rstrip("/").rsplit("/", 1)[-1]


def _list_rows(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    col = col.cast(pa.large_list(col.type.value_type))
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    return col.values.slice(off[0], off[-1] - off[0]), off - off[0]


def _encode_rows(voc: _Vocabulary, pretokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and row offsets of a column of pretoken lists."""
    words, off = _list_rows(pretokens)
    flat, counts = [], np.zeros(len(off) - 1, np.int64)
    for a, b in row_slices(off, TOKENS_AT_ONCE):
        part = words.slice(off[a], off[b] - off[a]).cast(pa.large_string()).dictionary_encode()
        ids, start, end = voc.encode(part.dictionary)
        code = part.indices.to_numpy(zero_copy_only=False)
        start, n = start[code], (end - start)[code]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        flat.append(ids[np.repeat(start - (upto - n), n) + np.arange(total)])
        upto = np.concatenate([[0], upto])
        counts[a:b] = np.diff(upto[off[a:b + 1] - off[a]])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return np.concatenate(flat) if flat else np.zeros(0, np.int32), ends


def _decode_rows(voc: _Vocabulary, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
    out: list[bytes] = []
    for a, b in row_slices(off, TOKENS_AT_ONCE):
        out += voc.decode(ids[off[a]:off[b]], off[a:b + 1] - off[a])
    return out


def _pretokens(df: DataFrame, text_col: str, pattern: str, name: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(name, F.regexp_extract_all(text, F.lit(spark_pattern(pattern)), F.lit(0)))


_IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids array<int>``: the text's tokens by the ranks in the
    file ``vocabulary``, each match of ``pattern`` encoded separately."""
    name, words = _ship(df, vocabulary), free_name(df, "__pretokens")

    def run(b: pa.RecordBatch) -> list:
        ids, off = _encode_rows(_vocabulary(SparkFiles.get(name)), b.column(words))
        return [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))]

    return append_columns(_pretokens(df, text_col, pattern, words), [T.StructField("ids", _IDS)], run, drop=(words,))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded binary``: the bytes of the ids, in order."""
    name = _ship(df, vocabulary)

    def run(b: pa.RecordBatch) -> list:
        col = b.column(ids_col)
        values, off = _list_rows(col.fill_null([]) if col.null_count else col)
        got = _decode_rows(_vocabulary(SparkFiles.get(name)), values.to_numpy(zero_copy_only=False).astype(np.int32), off)
        return [[None if null else x for x, null in zip(got, col.is_null().to_pylist())]]

    return append_columns(df, [T.StructField("decoded", T.BinaryType())], run)


def encode_decode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep_text: bool = True,
                  lean: bool = False) -> DataFrame:
    """``encode`` and then ``decode`` of the ids, in one pass over the rows.
    Without ``keep_text`` the text column is dropped, and not sent to the
    workers beside its pretokens. ``lean`` workers hold less at a time."""
    name, words = _ship(df, vocabulary), free_name(df, "__pretokens")

    def run(b: pa.RecordBatch) -> list:
        voc = _vocabulary(SparkFiles.get(name), lean)
        ids, off = _encode_rows(voc, b.column(words))
        return [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), _decode_rows(voc, ids, off)]

    split = _pretokens(df, text_col, pattern, words)
    return append_columns(split if keep_text else split.drop(text_col),
                          [T.StructField("ids", _IDS), T.StructField("decoded", T.BinaryType())], run,
                          drop=(words,), rows_at_once=LEAN_ROWS if lean else 500)
