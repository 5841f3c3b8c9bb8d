"""Secret scans (operator 4).

Three base rules mark assignments, access keys and hexadecimal strings. Beside
them two first-order Markov models of characters, one of random strings and
one of ordinary identifiers, score every long token; a token whose
log-likelihood ratio passes a threshold becomes a span of kind ``random``.
Both models are trained from labelled samples of the whole input: values that
the base rules mark, and every other token of eight or more characters.

Defined results: null and empty texts have no spans; offsets are code points,
end exclusive. Rows are handled one by one, so repeated keys, null keys and
other columns pass through (columns of the added names are replaced). Models
of an empty table hold the smoothing counts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm.common import append_columns, map_batches, row_slices, text_buffer

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Shortest value of each base rule, and shortest tokens that train and get a score.
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TRAIN, MIN_TOKEN = 12, 18, 16, 8, 20
#: Log-likelihood ratio, in nats, from which a token counts as random.
MIN_RATIO = 25.0
BYTES_AT_ONCE = 1_000_000

_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(256, np.uint8)  # 0: begins a token, or stands between tokens
_CODE[list(_ALPHABET)] = np.arange(1, len(_ALPHABET) + 1)
N_CODES = len(_ALPHABET) + 1
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    s, e = edge[::2], edge[1::2]
    long = e - s >= least
    return s[long], e[long]


def _joined(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a NUL between them, which no rule matches, and their starts."""
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out = np.zeros(len(buf) + len(off) - 1, np.uint8)
    out[np.arange(len(buf)) + rows] = buf
    return out, off[:-1] + np.arange(len(off) - 1)


def _base_spans(joined: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) of the base rules' matches."""
    data = joined.tobytes()
    out = [(m.start(), m.end(), 0, m.start(2)) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), m.end(), 1, m.start()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= MIN_ACCESS]
    out += [(s, e, 2, s) for s, e in zip(*(x.tolist() for x in _runs(_IS_HEX[joined], MIN_HEX)))]
    return out


def _tokens(joined: np.ndarray, spans: list, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character codes, and the tokens that share no character with a span."""
    code = _CODE[joined]
    free = code > 0
    s, e = _runs(free, least)
    if spans:
        marked = np.zeros(len(joined) + 1, np.int32)
        for a, z, _, _ in spans:
            marked[a] += 1
            marked[z] -= 1
        inside = np.concatenate([[0], np.cumsum(np.cumsum(marked[:-1]) > 0)])
        clear = inside[e] == inside[s]
        s, e = s[clear], e[clear]
    return code, s, e


def _transitions(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of (previous, next) codes within the spans; 0 precedes the first."""
    n = ends - starts
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    before = code[np.maximum(at - 1, 0)].astype(np.int64)
    before[np.cumsum(n) - n] = 0
    return np.bincount(before * N_CODES + code[at], minlength=N_CODES * N_CODES)


_COUNTS = T.StructType([T.StructField("model", T.IntegerType()), T.StructField("cell", T.IntegerType()),
                        T.StructField("n", T.LongType())])


def train(df: DataFrame, text_col: str = "text", smoothing: float = 1.0) -> np.ndarray:
    """Log-likelihood ratios (random over ordinary) by previous and next code.
    The counts cover all rows; their number is fixed by the alphabet."""

    def run(b: pa.RecordBatch) -> Iterator[list]:
        total = np.zeros((2, N_CODES * N_CODES), np.int64)
        buf, off = text_buffer(b.column(0))
        for r, z in row_slices(off, BYTES_AT_ONCE):
            joined, _ = _joined(buf[off[r]:off[z]], off[r:z + 1] - off[r])
            spans = _base_spans(joined)
            code, s, e = _tokens(joined, spans, MIN_TRAIN)
            total[0] += _transitions(code, s, e)
            if spans:
                a, v = np.array([x[3] for x in spans]), np.array([x[1] for x in spans])
                total[1] += _transitions(code, a, v)
        model, cell = np.nonzero(total)
        yield [model.astype(np.int32), cell.astype(np.int32), total[model, cell]]

    rows = map_batches(df.select(F.col(text_col).cast("string")), _COUNTS, run).groupBy("model", "cell").agg(F.sum("n").alias("n"))
    counts = np.full((2, N_CODES * N_CODES), smoothing)
    for model, cell, n in rows.collect():  # 2 * N_CODES**2 rows at most
        counts[model, cell] += n
    counts = counts.reshape(2, N_CODES, N_CODES)[:, :, 1:]
    p = np.log(counts / counts.sum(axis=2, keepdims=True))
    ratio = np.zeros((N_CODES, N_CODES))
    ratio[:, 1:] = p[1] - p[0]
    return ratio


def _found(buf: np.ndarray, off: np.ndarray, ratio: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Spans (row, start, end, kind) in code points, by row, start and kind."""
    joined, begin = _joined(buf, off)
    spans = _base_spans(joined)
    code, s, e = _tokens(joined, spans, MIN_TOKEN)
    if len(s):
        n = e - s
        at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        before = code[np.maximum(at - 1, 0)]
        before[np.cumsum(n) - n] = 0
        score = np.add.reduceat(ratio[before, code[at]], np.cumsum(n) - n)
        spans += [(a, z, 3, a) for a, z in zip(s[score >= MIN_RATIO].tolist(), e[score >= MIN_RATIO].tolist())]
    if not spans:
        return []
    points = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
    a, z = np.array([x[0] for x in spans]), np.array([x[1] for x in spans])
    row = np.searchsorted(begin, a, "right") - 1
    shift = points[begin[row]]
    return sorted(zip(row.tolist(), (points[a] - shift).tolist(), (points[z] - shift).tolist(), [x[2] for x in spans]),
                  key=lambda x: (x[0], x[1], x[3]))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                      T.StructField("end", T.IntegerType())])
_SPAN_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _spans_by_row(col: pa.Array, ratio: np.ndarray) -> list[list[tuple[str, int, int]]]:
    buf, off = text_buffer(col)
    rows: list[list] = [[] for _ in range(len(col))]
    for r, z in row_slices(off, BYTES_AT_ONCE):
        for row, start, end, kind in _found(buf[off[r]:off[z]], off[r:z + 1] - off[r], ratio):
            rows[r + row].append((KINDS[kind], start, end))
    return rows


def scan(df: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """``df`` with ``secrets``: array of (kind, start, end), by start and then
    kind in the order of ``KINDS``."""

    def run(b: pa.RecordBatch) -> list:
        rows = _spans_by_row(b.column(text_col), ratio)
        return [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in rows], pa.list_(_SPAN_ARROW))]

    return append_columns(df, [T.StructField("secrets", T.ArrayType(_SPAN))], run)


def redact(df: DataFrame, ratio: np.ndarray, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret span of the text replaced by ``mark``
    (overlapping spans by one); null texts stay null."""

    def run(b: pa.RecordBatch) -> list:
        texts = b.column(text_col)
        out = texts.to_pylist()
        for i, spans in enumerate(_spans_by_row(texts, ratio)):
            if spans:
                text, parts, done = out[i], [], 0
                for _, start, end in spans:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                out[i] = "".join(parts) + text[done:]
        return [pa.array(out, pa.string())]

    return append_columns(df, [T.StructField(text_col, T.StringType())], run).select(*df.columns)


def span_text(spans: str, kinds: tuple[str, ...] = KINDS):
    """The spans of the given kinds as kind:start:end, comma-joined."""
    of = F.filter(F.col(spans), lambda x: x["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
