"""Repeated passages by de Bruijn compaction (operator 3).

Edges of the graph are word k-mers; of every 35-word window the k-mer with the
least hash is taken, so equal windows have an edge in common and a twelfth of
the edges is looked at. Edges that occur twice or more are kept. An edge and
the next one of the same text are one path where every occurrence of either is
beside the other with the same words between (grouped minima and maxima, joined
back); chains of them compact into paths that each occurrence walks in full.

A window inside a path is therefore repeated. A window that holds a repeated
edge but reaches beyond its path does so at each of its occurrences; those are
cut from the source texts at the path's coordinates and verified: their 128-bit
hashes are counted over all texts and joined back. No other window is repeated.

Defined results: null and empty texts have no words; texts shorter than the
window lose nothing; every copy of a repeated passage goes, the first included.
Rows are told apart even where ids repeat or are null, and repeated rows repeat
each other's windows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm import common as C

BYTES_AT_ONCE = 500_000
_LONG = T.LongType()


def _word_rows(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, number of the first word of every row)."""
    buf, off = C.text_buffer(col)
    for a, z in C.row_slices(off, BYTES_AT_ONCE):
        part = buf[off[a]:off[z]]
        starts, ends, firsts = C.split_words(part, off[a:z + 1] - off[a])
        yield a, C.word_hashes(part, starts, ends), firsts


_EDGE = T.StructType([T.StructField(c, _LONG) for c in ("row", "seq", "pos", "h", "nxt")])


def _edges(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Sampled k-mers of every row: number, first word, hash, and the hash of
    the words from there to the end of the next one (null for the last)."""
    w = window - k + 1

    def run(b: pa.RecordBatch) -> Iterator[list]:
        ids = b.column(0).to_numpy()
        for a, words, firsts in _word_rows(b.column(1)):
            grams, ok = C.ngram_hashes(words, firsts, k)
            best = C.window_minimizers(grams, w)
            n = np.diff(firsts)
            # Only windows that lie in one row choose.
            inside = np.arange(len(best)) + window <= np.repeat(firsts[1:], n)[:len(best)]
            at = np.unique(best[inside])
            if not len(at):
                continue
            row = np.searchsorted(firsts, at, "right") - 1
            first = np.concatenate([[True], row[1:] != row[:-1]])
            seq = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            last = np.concatenate([first[1:], [True]])
            end = np.where(last, at, np.concatenate([at[1:], [0]])) + k
            span = C.signed(C.span_hashes(words, at, end, C._BASE_WORD))
            yield [ids[a + row], seq, at - firsts[row], C.signed(grams[at]), pa.array(span, mask=last)]

    return C.map_batches(rows.select("row", "text"), _EDGE, run)


def _paths(edges: DataFrame) -> DataFrame:
    """(row, units): occurrences of compacted paths, as first words of their
    first and last edge, of every row that has repeated edges."""
    twice = edges.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    own = Window.partitionBy("row").orderBy("seq")
    kept = edges.join(twice, "h")
    beside = F.lead("seq").over(own) == F.col("seq") + 1
    after = F.lag("seq").over(own) == F.col("seq") - 1
    kept = C.materialise(kept.select(
        "row", "seq", "pos", "h", F.when(beside, F.col("nxt")).alias("nxt"), F.when(beside, F.lead("h").over(own)).alias("to"),
        F.when(after, F.lag("nxt").over(own)).alias("prv"), F.when(after, F.lag("h").over(own)).alias("from")), "edges")

    def only(x: str, y: str, name: str):
        same = (F.count(x) == F.count(F.lit(1))) & (F.min(x) == F.max(x)) & (F.min(y) == F.max(y))
        return F.coalesce(same, F.lit(False)).alias(name)

    joints = kept.groupBy("h").agg(only("nxt", "to", "one_next"), only("prv", "from", "one_before"))
    marked = kept.join(joints, "h")
    joined = F.lag("one_next").over(own) & F.col("one_before") & F.col("from").isNotNull()
    cut = marked.select("row", "seq", "pos", F.coalesce(joined, F.lit(False)).alias("same"))
    unit = F.sum((~F.col("same")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return (cut.select("row", "pos", unit.alias("u")).groupBy("row", "u").agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
            .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("units")))


_CUT = T.StructType([T.StructField(c, _LONG) for c in ("row", "pos", "h1", "h2")])


def _beyond(units: list, words: int, window: int, k: int) -> np.ndarray:
    """Starts of the windows that hold an edge of a path and reach beyond it."""
    out = []
    for u in units:
        lo, hi = max(0, u["a"] + k - window), min(u["z"], words - window)
        inner_lo, inner_hi = u["a"], u["z"] + k - window  # starts of the windows inside
        if inner_hi < inner_lo:
            out.append(np.arange(lo, hi + 1))
        else:
            out += [np.arange(lo, min(hi, inner_lo - 1) + 1), np.arange(max(lo, inner_hi + 1), hi + 1)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _verified(rows: DataFrame, paths: DataFrame, window: int, k: int) -> DataFrame:
    """(row, pos): the repeated ones of the windows that leave their path."""

    def run(b: pa.RecordBatch) -> Iterator[list]:
        ids, units = b.column(0).to_numpy(), b.column(2)
        for a, words, firsts in _word_rows(b.column(1)):
            at, row = [], []
            for i in range(len(firsts) - 1):
                starts = _beyond(units[a + i].as_py(), firsts[i + 1] - firsts[i], window, k)
                at.append(starts + firsts[i])
                row.append(np.full(len(starts), a + i))
            at, row = np.concatenate(at), np.concatenate(row)
            h1 = C.span_hashes(words, at, at + window, C._BASE_WORD)
            h2 = C.span_hashes(C.mix64(words), at, at + window, C._BASE_BYTE)
            yield [ids[row], at - firsts[row - a], C.signed(h1), C.signed(h2)]

    cuts = C.map_batches(rows.join(C.small_side(paths), "row").select("row", "text", "units"), _CUT, run)
    cuts = C.materialise(cuts, "windows")
    twice = cuts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    return cuts.join(twice, ["h1", "h2"], "left_semi").select("row", "pos")


def repeated_spans(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Stored (row, spans): the repeated words of every row that has any, as
    sorted disjoint spans (first, end) of word numbers."""
    paths = C.materialise(_paths(_edges(rows, window, k)), "paths")
    cut = _verified(rows, paths, window, k)
    inside = paths.select("row", F.explode("units").alias("u")).select("row", "u.a", (F.col("u.z") + k).alias("z"))
    spans = inside.filter(F.col("z") - F.col("a") >= window).union(cut.select("row", F.col("pos").alias("a"), F.col("pos") + window))
    return C.materialise(C.merge_spans(spans), "spans")


def drop_repeats(docs: DataFrame, window: int = 35, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept`` (the kept
    words, joined by one space) and ``kept_sha256``."""
    rows = C.with_row_key(docs, id_col, text_col)
    spans = repeated_spans(rows, window, k)
    fields = [T.StructField("n_words", _LONG), T.StructField("n_removed", _LONG), T.StructField("kept", T.StringType()),
              T.StructField("kept_sha256", T.StringType())]

    def run(b: pa.RecordBatch) -> list:
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            words = (text or "").encode().split()
            n = len(words)
            for s in reversed(spans or []):
                del words[s["a"]:s["z"]]
            kept = b" ".join(words)
            out.append((n, n - len(words), kept.decode(), hashlib.sha256(kept).hexdigest()))
        return [list(c) for c in zip(*out)]

    both = rows.join(C.small_side(spans), "row", "left").select("id", "text", "spans")
    return (C.append_columns(both, fields, run, drop=("text", "spans"))
            .select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", "kept_sha256"))
