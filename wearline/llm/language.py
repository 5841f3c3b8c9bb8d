"""Language identification by fusing evidence (operator 10).

For every text and every language the posterior combines the likelihood of the
text's byte trigrams, the likelihood of the declared language (the markup's
attribute, or a column), and a prior of the host, smoothed towards that of the
address suffix, and that towards the whole table. Trigram models come from all
texts, grouped by declared language; declarations and priors from grouped
counts of the languages that the texts alone suggest. A further model, ``und``,
gives all trigrams the same chance; texts that it explains best, or without
any letter, are rejected, and so are those whose best posterior is below
``min_posterior``.

Defined results: null and empty texts, and texts without letters, have
language ``und`` and are not kept; a null declaration, host or suffix is no
evidence against any language (nulls form one host); declared values compare
without case and region (``en-GB`` is ``en``). Every declared value is a
language, however rare, if any of its texts has letters; without any, all rows are ``und``. A text that none of
them resembles and that declares none itself is ``und``. Rare models stay close
to ``und``, as every cell counts half an occurrence, so they win where no
frequent language fits. Rows are handled one by one; repeated
rows count in the statistics as often as they occur. Result columns replace
columns of the same name.
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
from wearline.llm.common import free_name, materialise

CELL_BITS, BYTES_AT_ONCE = 15, 1_000_000
CELLS = 1 << CELL_BITS
#: Share of the trigram evidence that counts (trigrams overlap), the weight of
#: the parent in smoothed priors, and the added count of declarations.
TEXT_WEIGHT, PARENT_ROWS, ADDED = 0.25, 20.0, 1.0

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash cells of the trigrams that hold a letter, and their rows' ends.
    Every row is framed by blanks; blanks and signs count as one blank."""
    rows = len(off) - 1
    frame = off[:-1] + 2 * np.arange(rows)
    framed = np.full(len(buf) + 2 * rows, 0x20, np.uint8)
    framed[np.arange(len(buf)) + 2 * np.repeat(np.arange(rows), np.diff(off)) + 1] = _FOLD[buf]
    blank = framed == 0x20
    keep = np.ones(len(framed), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[frame] = True
    s = framed[keep].astype(np.uint32)
    first = np.concatenate([[0], np.cumsum(keep)])[np.append(frame, len(framed))]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    three = (s[:-2] << np.uint32(16)) | (s[1:-1] << np.uint32(8)) | s[2:]
    ok = s[1:-1] != 0x20  # so no trigram reaches into another row
    cells = ((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - CELL_BITS)).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(ok), [ok.sum(), ok.sum()]])
    return cells[ok], upto[np.maximum(first - 1, 0)]


def declared_code(col: Column) -> Column:
    return F.nullif(F.lower(F.substring_index(F.substring_index(F.trim(col.cast("string")), "-", 1), "_", 1)), F.lit(""))


def markup_language(html: Column) -> Column:
    """The language that a page's markup declares, or null."""
    return F.nullif(F.regexp_extract(html, r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_suffix(host: Column) -> Column:
    """The part after the last dot; null for hosts without one."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


@dataclass
class TextModel:
    languages: list[str]
    start: np.ndarray  # where each language's cells begin, and the end
    cells: np.ndarray
    log_p: np.ndarray
    unseen: np.ndarray  # of each language's other cells

    def column(self, i: int) -> np.ndarray:
        out = np.full(CELLS, self.unseen[i], np.float32)
        of = slice(self.start[i], self.start[i + 1])
        out[self.cells[of]] = self.log_p[of]
        return out


_TEXT_COUNTS = T.StructType([T.StructField("language", T.IntegerType()), T.StructField("cell", T.IntegerType()),
                             T.StructField("n", T.LongType())])
#: Languages that a task counts before it gives their counts out.
HELD = 256


def train_text(rows: DataFrame) -> TextModel:
    """Trigram models from (text, declared) over all rows, one for every
    declared language."""
    known = sorted(r[0] for r in rows.filter(F.col("declared").isNotNull()).select("declared").distinct().collect())
    number = {x: i for i, x in enumerate(known)}

    def counted(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, n in total.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), i, np.int32)), pa.array(cell.astype(np.int32)),
                                              pa.array(n[cell])], names=_TEXT_COUNTS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            of = np.array([number.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
            buf, off = C.text_buffer(b.column(0))
            for a, z in C.row_slices(off, BYTES_AT_ONCE):
                cells, upto = _trigrams(buf[off[a]:off[z]], off[a:z + 1] - off[a])
                lang = np.repeat(of[a:z], np.diff(upto))
                for i in np.unique(lang[lang >= 0]).tolist():
                    if i not in total and len(total) == HELD:
                        yield from counted(total)
                        total = {}
                    total[i] = total.get(i, 0) + np.bincount(cells[lang == i], minlength=CELLS)
        yield from counted(total)

    C.ship_package(rows.sparkSession)
    lang = cell = n = np.zeros(0, np.int64)
    if known:
        got = (rows.select("text", "declared").mapInArrow(run, _TEXT_COUNTS).groupBy("language", "cell")
               .agg(F.sum("n").alias("n")).toArrow())  # the cells that a language's texts hold
        lang, cell, n = (got[x].to_numpy() for x in ("language", "cell", "n"))
        order = np.lexsort((cell, lang))
        lang, cell, n = lang[order], cell[order], n[order]
        some, lang = np.unique(lang, return_inverse=True)  # those with letters: the others' models would equal ``und``
        known = [known[i] for i in some]
    total = 0.5 * CELLS + np.bincount(lang, weights=n, minlength=len(known))
    return TextModel(known, np.searchsorted(lang, np.arange(len(known) + 1)), cell.astype(np.int32),
                     np.log((n + 0.5) / total[lang]).astype(np.float32), np.log(0.5 / total).astype(np.float32))


_SCORES = [T.StructField("__score", T.ArrayType(T.DoubleType())), T.StructField("__trigrams", T.LongType())]


def _score_text(rows: DataFrame, model: TextModel) -> DataFrame:
    """``__score``: tempered log-likelihood by language, ``und`` last."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> list:
        model = held.value
        out, size = np.zeros((b.num_rows, len(model.languages) + 1)), np.zeros(b.num_rows, np.int64)
        buf, off = C.text_buffer(b.column("__text"))
        for a, z in C.row_slices(off, BYTES_AT_ONCE):
            cells, upto = _trigrams(buf[off[a]:off[z]], off[a:z + 1] - off[a])
            for i in range(len(model.languages)):
                pre = np.concatenate([[0.0], np.cumsum(model.column(i)[cells], dtype=np.float64)])
                out[a:z, i] = pre[upto[1:]] - pre[upto[:-1]]
            size[a:z] = np.diff(upto)
        out[:, -1] = -np.log(CELLS) * size
        return [list(TEXT_WEIGHT * out), pa.array(size)]

    return C.append_columns(rows, _SCORES, run, drop=("__text",))


def _fixed_declarations(scored: DataFrame, model: TextModel) -> tuple[list[float], list[tuple[str, dict[int, float]]]]:
    """log P(declared | language) from grouped counts of what the texts
    suggest: that of a declaration never met, and what to add for those met."""
    n = len(model.languages)
    total = np.full(n + 1, ADDED * (n + 1))
    more: dict[str, dict[int, float]] = {}
    for declared, top, k in (scored.filter(F.col("__declared").isNotNull()).groupBy("__declared", "__top")
                             .agg(F.count(F.lit(1))).collect()):  # the pairs that occur
        total[top] += k
        more.setdefault(declared, {})[top] = float(np.log((ADDED + k) / ADDED))
    return np.log(ADDED / total).tolist(), [*more.items()]


def _priors(scored: DataFrame, n: int) -> DataFrame:
    """(h_host, h_suffix, __prior): log priors of the languages by host."""
    tops = materialise(scored.groupBy("__host", "__suffix", "__top").agg(F.count(F.lit(1)).cast("double").alias("c")), "host-counts")
    total = np.ones(n + 1)
    for top, k in tops.groupBy("__top").agg(F.sum("c")).collect():  # n + 1 rows at most
        total[top] += k
    overall = scored.sparkSession.createDataFrame([((total / total.sum()).tolist(),)], "overall array<double>")
    counts = lambda: (F.map_from_entries(F.collect_list(F.struct("__top", "c"))).alias("m"), F.sum("c").alias("s"))
    up = (tops.groupBy("__suffix", "__top").agg(F.sum("c").alias("c")).groupBy("__suffix").agg(*counts())
          .crossJoin(F.broadcast(overall)).select(F.col("__suffix").alias("u"), F.expr(
              f"transform(overall, (x, i) -> (coalesce(m[i], 0D) + {PARENT_ROWS}D * x) / (s + {PARENT_ROWS}D))").alias("p")))
    hosts = tops.groupBy("__host", "__suffix").agg(*counts())
    return (hosts.join(up, hosts["__suffix"].eqNullSafe(up.u))
            .select(F.col("__host").alias("h_host"), F.col("__suffix").alias("h_suffix"), F.expr(
                f"transform(p, (x, i) -> ln((coalesce(m[i], 0D) + {PARENT_ROWS}D * x) / (s + {PARENT_ROWS}D)))").alias("__prior")))


def identify(df: DataFrame, keys: list[str], text: Column, declared: Column, host: Column, suffix: Column,
             min_posterior: float = 0.5) -> DataFrame:
    """Per row of ``df``: the columns ``keys``, and ``language``, ``posterior``
    and ``kept``."""
    spark = df.sparkSession
    evidence = df.select(*keys, F.coalesce(text, F.lit("")).alias("__text"), declared_code(declared).alias("__declared"),
                         host.cast("string").alias("__host"), suffix.cast("string").alias("__suffix"))
    model = train_text(evidence.select(F.col("__text").alias("text"), F.col("__declared").alias("declared")))
    n = len(model.languages)
    scored = _score_text(evidence, model)
    scored = materialise(scored.withColumn("__top", F.array_position("__score", F.array_max("__score")).cast("int") - 1)
                         .withColumn("__top", F.when(F.col("__trigrams") == 0, n).otherwise(F.col("__top"))), "language-scores")
    base, more = _fixed_declarations(scored, model)
    fixed = spark.createDataFrame(more, "d string, __more map<int, double>")
    prior = _priors(scored, n)
    whole = spark.createDataFrame([(base, [*model.languages, "und"])], "__base array<double>, __names array<string>")
    said = F.when(F.col("__declared").isNull(), F.array_repeat(F.lit(0.0), n + 1)).otherwise(
        F.expr("transform(__base, (x, i) -> x + coalesce(__more[i], 0D))"))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = (scored.join(F.broadcast(fixed), F.col("__declared") == F.col("d"), "left").crossJoin(F.broadcast(whole))
             .join(prior, F.col("__host").eqNullSafe(F.col("h_host")) & F.col("__suffix").eqNullSafe(F.col("h_suffix")))
             .select(*keys, "__trigrams", "__names", plus(plus(F.col("__score"), said), F.col("__prior")).alias("__log")))
    top = F.array_max("__log")
    share = 1 / F.aggregate("__log", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    empty = F.col("__trigrams") == 0
    out = fused.select(*keys, F.when(empty, "und").otherwise(F.element_at(F.col("__names"), F.array_position("__log", top).cast("int")))
                       .alias("language"), F.when(empty, 1.0).otherwise(share).alias("posterior"))
    return out.withColumn("kept", (F.col("language") != "und") & (F.col("posterior") >= min_posterior))


#: Rejected rows are broadcast up to this number, as counted.
BROADCAST_ROWS = 1_000_000


def keep_identified(docs: DataFrame, text_col: str, declared: Column, host: Column, suffix: Column, id_col: str = "doc_id",
                    **options) -> DataFrame:
    """``docs`` without the rejected rows. Rows are told apart by id, text,
    declaration, host and suffix."""
    key = lambda: F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col), declared, host, suffix)
    name = free_name(docs, "__key")
    held = docs.withColumn(name, key())
    found = identify(held, [name], F.col(text_col), declared, host, suffix, **options)
    gone = materialise(found.filter(~F.col("kept")).select(name).distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return held.join(gone, name, "left_anti").drop(name)
