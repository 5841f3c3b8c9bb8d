"""Removal of repeated byte passages by suffix arrays (operator 7).

A passage of ``length`` bytes is removed wherever it starts but the first time.
Of every such window the 20-byte string with the least hash is its anchor, so
equal windows have equal anchors at equal places; only windows whose anchor
occurs twice or more can repeat. Neighbouring windows of one anchor form a
piece. Equal pieces need no sorting: all but the first are removed whole.
Distinct pieces go to shards by anchor. A shard sorts its suffixes by
Larsson-Sadakane refinement (only groups that are not yet in order are sorted
again, by the rank of what follows), takes common prefixes by Kasai's
recurrence, run in lanes, and so finds equal windows and the first of each.
Anchors of very many distinct pieces are dealt over several shards; pairs of
these are merged by binary search of one's sorted windows among the other's.

Defined results: null and empty texts have no bytes; copies of whole texts
follow the same rule. "Earlier" is the order of (id, start); rows with a null
id come first, and rows of one id follow each other in an arbitrary order.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm import common as C

#: Bytes of an anchor, of a batch, of a shard, and distinct pieces of one
#: anchor in a shard.
ANCHOR, BYTES_AT_ONCE, SHARD_BYTES, SHARD_PIECES = 20, 500_000, 1_500_000, 8_000
LANES = 4096
_LONG = T.LongType()


def _words(text: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes from every place on as a number (zeros after the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), dtype=f"{order}u8", buffer=padded.tobytes(), strides=(1,)).astype(np.uint64)


def _anchor_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the 20 bytes from every place on, where there are as many."""
    n = len(text) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    u = _words(text)
    h = C.mix64(u[:n] * C.U64(0x9E3779B97F4A7C15) + u[8:8 + n])
    return C.mix64(h * C.U64(0xC2B2AE3D27D4EB4F) + (u[12:12 + n] >> C.U64(32)))


def _anchors(col: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, row starts, anchor hashes, window starts within one
    row, their anchors' places)."""
    buf, off = C.text_buffer(col)
    for a, z in C.row_slices(off, BYTES_AT_ONCE):
        part, o = buf[off[a]:off[z]], off[a:z + 1] - off[a]
        h = _anchor_hashes(part)
        best = C.window_minimizers(h, length - ANCHOR + 1)
        at = np.flatnonzero(np.arange(len(best)) + length <= np.repeat(o[1:], np.diff(o))[:len(best)])
        yield a, part, o, h, at, best[at]


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """Stored (row, n): texts of at least ``length`` bytes that occur earlier as a whole."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = rows.select("id", "row", F.octet_length(text).cast("long").alias("n"), F.sha2(text, 256).alias("s")).filter(F.col("n") >= length)
    first = own.groupBy("s", "n").agg(F.min(F.struct("id", "row")).alias("f"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return C.materialise(own.join(first, ["s", "n"]).filter(F.col("row") != F.col("f.row")).select("row", "n"), "copies")


_ANCHORED = T.StructType([T.StructField(c, _LONG) for c in ("row", "p", "h")])


def _repeated_anchors(rows: DataFrame, length: int) -> DataFrame:
    """Stored (row, places) of the anchors that occur more than once."""

    def run(b: pa.RecordBatch) -> Iterator[list]:
        ids = b.column(0).to_numpy()
        for a, _, o, h, _, best in _anchors(b.column(1), length):
            p = np.unique(best)
            row = np.searchsorted(o, p, "right") - 1
            yield [ids[a + row], p - o[row], C.signed(h[p])]

    found = C.map_batches(rows.select("row", "text"), _ANCHORED, run)
    twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return C.materialise(found.join(twice, "h").groupBy("row").agg(F.collect_list(F.col("p").cast("int")).alias("places")), "anchors")


_PIECE = T.StructType([T.StructField(c, _LONG) for c in ("id", "row", "pos", "n", "h", "h1", "h2")] +
                      [T.StructField("piece", T.BinaryType())])


def _pieces(rows: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """Stored pieces: ``n`` neighbouring windows from ``pos`` on of one
    repeated anchor (hash h), their bytes and 128 bits of hash of them."""

    def run(b: pa.RecordBatch) -> Iterator[list]:
        ids, numbers, places = b.column(0), b.column(1).to_numpy(), b.column(3)
        for a, part, o, h, at, best in _anchors(b.column(2), length):
            mark = np.zeros(len(part) + 1, bool)
            for i in range(len(o) - 1):
                mark[o[i] + places[a + i].values.to_numpy()] = True
            chosen = mark[best]
            at, best = at[chosen], best[chosen]
            if not len(at):
                continue
            new = np.concatenate([[True], (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)])
            s, anchor = at[new], best[new]
            n = np.diff(np.append(np.flatnonzero(new), len(at)))
            e = s + n - 1 + length
            row = np.searchsorted(o, s, "right") - 1
            table = C.byte_table(5)[part]
            h1, h2 = C.span_hashes(table, s, e, C._BASE_BYTE), C.span_hashes(C.mix64(table), s, e, C._BASE_WORD)
            data = part.tobytes()
            for i in range(0, len(s), 5000):
                c = slice(i, i + 5000)
                yield [ids.take(pa.array(a + row[c])), numbers[a + row[c]], s[c] - o[row[c]], n[c], C.signed(h[anchor[c]]),
                       C.signed(h1[c]), C.signed(h2[c]), [data[x:y] for x, y in zip(s[c].tolist(), e[c].tolist())]]

    held = rows.join(C.small_side(marks), "row").select("id", "row", "text", "places")
    return C.materialise(C.map_batches(held, _PIECE, run), "pieces")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. Only groups that are still equal are
    sorted again, by the ranks ``h`` places on, with h doubled each time."""
    n = len(text)
    keys = _words(text, ">")
    # From the end on, so that of equal keys the shorter suffix comes first.
    sa = n - 1 - np.argsort(keys[::-1], kind="stable")
    k, left = keys[sa], np.minimum(n - sa, 8)
    start = np.concatenate([[True], (k[1:] != k[:-1]) | (left[1:] != left[:-1])])
    rank = np.zeros(n + 1, np.int64)  # 0 stands for the empty suffix
    h = 8
    while True:
        first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        rank[sa] = first + 1
        single = start & np.append(start[1:], True)
        at = np.flatnonzero(~single)
        if not len(at):
            return sa
        s = sa[at]
        both = rank[s].astype(np.uint64) * C.U64(n + 1) + rank[np.minimum(s + h, n)].astype(np.uint64)
        by = np.argsort(both, kind="stable")
        sa[at], both = s[by], both[by]
        # A group begins where it did, and where the rank that follows changes.
        start[at[1:]] |= both[1:] != both[:-1]
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of what each suffix in order has in common with
    the one before it. By Kasai's recurrence a suffix has at most one byte less
    in common than the suffix one place before it in the text; the text is cut
    into lanes that take their steps together."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words = np.concatenate([_words(text), np.zeros(most + 8, np.uint64)])
    out = np.zeros(n, np.int64)
    lanes = min(LANES, n)
    step = -(-n // lanes)
    i = np.arange(0, n, step)
    end = np.minimum(i + step, n)
    got = np.zeros(len(i), np.int64)
    for _ in range(step):
        live = np.flatnonzero((i < end) & (before[np.minimum(i, n - 1)] >= 0))
        p, q = i[live], before[i[live]]
        m = got[live]
        todo = np.arange(len(live))
        while len(todo):
            x, y = p[todo] + m[todo], q[todo] + m[todo]
            diff = words[x] ^ words[y]
            same = np.where(diff == 0, 8, np.bitwise_count((diff & (~diff + C.U64(1))) - C.U64(1)) >> 3).astype(np.int64)
            same = np.minimum(same, np.maximum(n - np.maximum(x, y), 0))
            m[todo] += same
            todo = todo[(same == 8) & (m[todo] < most)]
        m = np.minimum(m, most)
        out[p] = m
        got[:] = 0
        got[live] = np.maximum(m - 1, 0)
        i = i + 1
    return out[sa]


class _Shard:
    """Pieces in order of occurrence: their text, and equal windows in it."""

    def __init__(self, pieces: list[bytes], n: np.ndarray, length: int):
        # A number after each piece keeps suffixes of different pieces apart.
        self.text = np.frombuffer(b"".join(p + i.to_bytes(4, "big") for i, p in enumerate(pieces)), np.uint8)
        size = np.array([len(p) + 4 for p in pieces])
        self.begin = np.cumsum(size) - size
        self.n, self.length = n, length
        upto = np.cumsum(n)
        self.piece = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(int(upto[-1])) - np.repeat(upto - n, n)
        window = np.zeros(len(self.text), bool)
        window[self.begin[self.piece] + self.place] = True
        sa = suffix_array(self.text)
        lcp = common_prefixes(self.text, sa, length)
        group = np.cumsum(lcp < length)
        wanted = window[sa]
        self.at, group = sa[wanted], group[wanted]
        self.starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        #: The first occurrence of every distinct window, in order of the windows.
        self.first = np.minimum.reduceat(self.at, self.starts)

    def later(self) -> np.ndarray:
        """Places of the windows that are not the first of their kind."""
        gone = np.ones(len(self.text), bool)
        gone[self.first] = False
        return self.at[gone[self.at]]

    def window_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        piece = np.searchsorted(self.begin, at, "right") - 1
        return piece, at - self.begin[piece]

    def keys(self) -> np.ndarray:
        """Bytes of the distinct windows as rows of big-endian numbers, in order."""
        w = _words(np.concatenate([self.text, np.zeros(8, np.uint8)]), ">")
        cols = [w[self.first + i] for i in range(0, self.length - 7, 8)]
        if self.length % 8:
            cols.append(w[self.first + self.length - 8])
        return np.stack(cols, axis=1)


def _matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every row of ``a`` the number of the equal row of the sorted ``b``,
    or -1, by binary search."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), len(b), np.int64)

    def below(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether b[other] < a[rows], column by column."""
        less, equal = np.zeros(len(rows), bool), np.ones(len(rows), bool)
        for c in range(a.shape[1]):
            x, y = b[other, c], a[rows, c]
            less |= equal & (x < y)
            equal &= x == y
        return less

    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) >> 1
        up = below(open_, mid)
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]
    at = np.minimum(lo, max(len(b) - 1, 0))
    return np.where((lo < len(b)) & (b[at] == a).all(axis=1), at, -1) if len(b) else np.full(len(a), -1)


_SPAN = T.StructType([T.StructField(c, _LONG) for c in ("row", "a", "z")])


def _shard_tasks(length: int):
    """Removed spans of the pieces that arrive in order of (shard, lo, hi)."""

    def spans(row: np.ndarray, pos: np.ndarray, piece: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        by = np.lexsort((place, piece))
        piece, place = piece[by], place[by]
        if not len(piece):
            cut = np.zeros(0, np.int64)
        else:
            cut = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)]))
        n = np.diff(np.append(cut, len(piece)))
        a = pos[piece[cut]] + place[cut]
        return pa.RecordBatch.from_arrays([pa.array(row[piece[cut]]), pa.array(a), pa.array(a + n - 1 + length)], names=_SPAN.names)

    def group(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        ids = t["id"].fill_null(-(1 << 63)).to_numpy()
        row, pos, n, block = (t[c].to_numpy() for c in ("row", "pos", "n", "block"))
        pieces = t["piece"].to_pylist()
        parts = []
        for b in sorted({lo, hi}):
            own = np.flatnonzero(block == b)
            own = own[np.lexsort((pos[own], row[own], ids[own]))]
            if not len(own):
                return
            parts.append((own, _Shard([pieces[i] for i in own], n[own], length)))
        if lo == hi:
            own, shard = parts[0]
            yield spans(row[own], pos[own], *shard.window_of(shard.later()))
            return
        (own_a, a), (own_b, b) = parts
        found = _matches(a.keys(), b.keys())
        i = np.flatnonzero(found >= 0)
        if not len(i):
            return
        (pa_, oa), (pb, ob) = a.window_of(a.first[i]), b.window_of(b.first[found[i]])
        x, y = own_a[pa_], own_b[pb]
        ka, kb = (ids[x], row[x], pos[x] + oa), (ids[y], row[y], pos[y] + ob)
        a_first = (ka[0] < kb[0]) | ((ka[0] == kb[0]) & ((ka[1] < kb[1]) | ((ka[1] == kb[1]) & (ka[2] < kb[2]))))
        yield spans(row[own_b], pos[own_b], pb[a_first], ob[a_first])
        yield spans(row[own_a], pos[own_a], pa_[~a_first], oa[~a_first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            keys = np.array([held[c].to_numpy() for c in ("shard", "lo", "hi")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
            for a, z in zip(cuts[:-1], cuts[1:]):
                yield from group(held.slice(a, z - a))
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from group(held)

    return run


def removed_spans(rows: DataFrame, length: int) -> DataFrame:
    """Stored (row, spans): the bytes to remove, as sorted disjoint spans."""
    copies = _copies(rows, length)
    rows = rows.join(C.small_side(copies), "row", "left_anti")
    pieces = _pieces(rows, _repeated_anchors(rows, length), length)
    distinct = C.materialise(pieces.groupBy("h1", "h2", "n").agg(
        F.min(F.struct("id", "row", "pos")).alias("f"), F.first("h").alias("h"), F.first("piece").alias("piece")), "distinct-pieces")
    whole = (pieces.select("h1", "h2", "n", "row", "pos").join(distinct.select("h1", "h2", "n", "f"), ["h1", "h2", "n"])
             .filter((F.col("row") != F.col("f.row")) | (F.col("pos") != F.col("f.pos")))
             .select("row", F.col("pos").alias("a"), (F.col("pos") + F.col("n") - 1 + length).alias("z")))
    total = distinct.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    many = (distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)
            .select("h", F.ceil(F.col("m") / SHARD_PIECES).cast("int").alias("blocks")))
    # Windows of one piece hold the anchor at different places, so they differ:
    # an anchor of a single distinct piece needs no sorting.
    placed = distinct.join(many, "h").select(
        "f.*", "n", "piece", "blocks", F.when(F.col("blocks") == 1, F.pmod("h", F.lit(shards))).otherwise(F.col("h")).alias("shard"),
        F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("long").alias("block"))
    tasks = (placed.withColumn("o", F.explode(F.expr("sequence(0L, blocks - 1L)")))
             .withColumns({"lo": F.least("block", "o"), "hi": F.greatest("block", "o")})
             .repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi"))
    sorted_out = tasks.mapInArrow(_shard_tasks(length), _SPAN)
    whole_texts = copies.select("row", F.lit(0).cast("long").alias("a"), F.col("n").alias("z"))
    return C.materialise(C.merge_spans(whole.union(sorted_out).union(whole_texts)), "spans")


def drop_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept`` (the remaining bytes) and ``kept_sha256``."""
    rows = C.with_row_key(docs, id_col, text_col)
    spans = removed_spans(rows, length)
    fields = [T.StructField(c, _LONG) for c in ("n_bytes", "n_removed", "n_spans")] + [
        T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())]

    def run(b: pa.RecordBatch) -> list:
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            data, parts, at = (text or "").encode(), [], 0
            for s in spans or []:
                parts.append(data[at:s["a"]])
                at = s["z"]
            kept = b"".join(parts) + data[at:]
            out.append((len(data), len(data) - len(kept), len(spans or []), kept, hashlib.sha256(kept).hexdigest()))
        return [list(c) for c in zip(*out)]

    both = rows.join(C.small_side(spans), "row", "left").select("id", "text", "spans")
    return (C.append_columns(both, fields, run, drop=("text", "spans"))
            .select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"))
