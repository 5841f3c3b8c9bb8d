"""Toxicity by positive-unlabelled learning (operator 6).

A linear model over hashed words and word beginnings is fitted with numpy from confirmed toxic
texts and unlabelled text, by the non-negative risk estimator: the share of
positives among the unlabelled text (the class prior) corrects the estimate of
the negative risk, and where that estimate turns negative the step goes back.
Only labels of rows outside the held-out fold are read; language, source, id
and labels are no features. Fitting takes bounded samples (parameters);
scoring covers every whole text.

Defined results: null and empty texts get the score of the intercept; a null
id is scored, is not held out, and does not train; several labels of an id
count as toxic if one is; without toxic or without unlabelled rows the score
is the prior everywhere (0 without labels). Rows are scored one by one, so
repeated keys and other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm import common as C

#: Hash bits, and the lengths in bytes of the word beginnings.
FEATURE_BITS, BEGINNINGS = 22, (4, 5, 6)
BYTES_AT_ONCE = 500_000
_SEP = np.ones(256, bool)
_SEP[0x30:0x3A] = _SEP[0x41:0x5B] = _SEP[0x61:0x7B] = _SEP[0x80:] = False


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def held_out(id_col: str, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def _features(col: pa.Array) -> Iterator[np.ndarray]:
    """Distinct hashed words and word beginnings of every row (lower-cased A-Z)."""
    buf, off = C.text_buffer(col)
    for a, z in C.row_slices(off, BYTES_AT_ONCE):
        part = C.lower_ascii(buf[off[a]:off[z]])
        starts, ends, firsts = C.split_words(part, off[a:z + 1] - off[a], _SEP)
        kinds = [ends] + [np.minimum(starts + n, ends) for n in BEGINNINGS]
        found = np.stack([C.word_hashes(part, starts, e, seed=3) for e in kinds], axis=1)
        # A beginning and a word of the same letters are different features.
        found[:, 1:] = C.mix64(found[:, 1:])
        found = (found >> C.U64(64 - FEATURE_BITS)).astype(np.int32)
        for i in range(z - a):
            yield np.unique(found[firsts[i]:firsts[i + 1]])


def _sampled(df: DataFrame, total: int, bound: int) -> DataFrame:
    """About ``bound`` rows, chosen by a hash of the id."""
    if total <= bound:
        return df
    cut = int(bound / total * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) < cut)


def _collect(df: DataFrame) -> list[np.ndarray]:
    schema = T.StructType([T.StructField("f", T.ArrayType(T.IntegerType()))])

    def run(b: pa.RecordBatch) -> Iterator[list]:
        yield [list(_features(b.column(0)))]

    rows = C.map_batches(df.select("text"), schema, run).toArrow()
    return [np.asarray(x.values, np.int32) for x in rows["f"]] if rows.num_rows else []


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 150, rate: float = 0.05,
        decay: float = 1e-3, least_z: float = 4.0, min_rows: int = 5) -> Model:
    """Weights by Adam on the non-negative risk with logistic loss. Only
    features of at least ``min_rows`` confirmed texts whose share there exceeds
    that in the unlabelled ones by ``least_z`` standard errors get a weight."""
    weights = np.zeros(1 << FEATURE_BITS, np.float32)
    if not positive or not unlabelled:
        return Model(weights, float(np.log(max(prior, 1e-12) / max(1 - prior, 1e-12))))
    flat = np.concatenate(positive + unlabelled)
    cut = sum(len(x) for x in positive)
    c_p, c_u = (np.bincount(x, minlength=len(weights)) for x in (flat[:cut], flat[cut:]))
    n_p, n_u = len(positive), len(unlabelled)
    share = (c_p + c_u) / (n_p + n_u)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
    used = np.flatnonzero((c_p >= min_rows) & ((c_p / n_p - c_u / n_u) >= least_z * error))
    place = np.full(len(weights), -1, np.int64)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(positive) + len(unlabelled)), [len(x) for x in positive + unlabelled])
    col = place[flat]
    row, col = row[col >= 0], col[col >= 0]
    n = n_p + n_u
    theta = np.zeros(len(used) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = np.bincount(row, theta[col], minlength=n) + theta[-1]
        up = 1 / (1 + np.exp(-g))  # slope of the loss of label -1; that of label 1 is up - 1
        loss = np.logaddexp(0, g)
        negative = loss[n_p:].mean() - prior * loss[:n_p].mean()
        d = np.empty(n)
        if negative >= 0:
            d[:n_p], d[n_p:] = prior * (up[:n_p] - 1 - up[:n_p]) / n_p, up[n_p:] / n_u
        else:
            d[:n_p], d[n_p:] = prior * up[:n_p] / n_p, -up[n_p:] / n_u
        grad = np.append(np.bincount(col, d[row], minlength=len(used)) + decay * theta[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights[used] = theta[:-1]
    return Model(weights, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_positive: int = 3000, max_unlabelled: int = 9000) -> Model:
    """A model from the rows outside the held-out fold. The samples hold about
    ``max_positive`` confirmed texts and ``max_unlabelled`` texts of any kind."""
    rows = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    if not n:
        return Model(np.zeros(1 << FEATURE_BITS, np.float32), -27.6)
    prior = min(max(toxic / n, 0.0), 0.99)
    chosen = _sampled(known.filter("y = 1").select("id"), toxic, max_positive)
    positive = _collect(rows.join(F.broadcast(chosen), "id", "left_semi")) if toxic else []
    unlabelled = _collect(_sampled(rows, rows.count(), max_unlabelled))
    return fit(positive, unlabelled, prior)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> list:
        w, bias = held.value.weights, held.value.bias
        g = np.array([w[f].sum(dtype=np.float64) + bias for f in _features(b.column(text_col))])
        p = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return C.append_columns(df, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], run)
