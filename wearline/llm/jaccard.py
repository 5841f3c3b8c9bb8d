"""N-gram Jaccard self-join (operator 8).

Texts become sets of word n-grams, ordered rarest first by counts over all
documents, kept in a table of hashed counts whose cells follow the measured
size of the texts (any one order gives right results; a rare first one gives
few candidates). Sets that can reach the
similarity share an n-gram of their prefixes. Prefix n-grams are joined; pairs
pass length and positional filters there, a suffix filter on counts of n-grams
by hash bin, and are verified once on the whole sets.

What is returned are the classes of linked texts, so pairs inside a class that
is known already need no check: equal sets are one node, a first round pairs
the texts of every prefix n-gram with its least id, a second one with an
arbitrary text of another class, and the last round takes all remaining pairs
of different classes. No link between classes is lost.

Defined results: null and empty texts have the empty set and link with
nothing; a text of fewer than n words is one n-gram. Rows of one id count as
one document that has all their links; rows with a null id link with nothing
and have a null component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm import common as C
from wearline.llm.components import components

BYTES_AT_ONCE = 500_000
#: Least and greatest bits of a cell of the hashed counts, cells in a row of them,
#: bins of the suffix filter, and the measured size up to which the ids of
#: candidates are broadcast.
MIN_BITS, MAX_BITS, BLOCK, BINS, BROADCAST_IDS = 17, 24, 1 << 10, 16, 4_000_000


def _sets(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its n-grams)."""
    buf, off = C.text_buffer(col)
    for a, z in C.row_slices(off, BYTES_AT_ONCE):
        part = C.lower_ascii(buf[off[a]:off[z]])
        starts, ends, firsts = C.split_words(part, off[a:z + 1] - off[a])
        words = C.word_hashes(part, starts, ends)
        grams, ok = C.ngram_hashes(words, firsts, n)
        short = (np.diff(firsts) > 0) & (np.diff(firsts) < n)
        grams[firsts[:-1][short]] = C.span_hashes(words, firsts[:-1][short], firsts[1:][short], C._BASE_WORD)
        ok[firsts[:-1][short]] = True
        kept = np.concatenate([[0], np.cumsum(ok)])[firsts]
        grams = grams[ok]
        for i in range(z - a):
            yield a + i, np.unique(grams[kept[i]:kept[i + 1]])


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever the order."""
    with np.errstate(over="ignore"):
        return tuple(int(C.mix64(s + C.U64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (1, 0x51ED270B))


_LONG, _LONGS = T.LongType(), T.ArrayType(T.LongType())
_STATS = T.StructType([T.StructField(c, _LONG) for c in ("cell", "id", "n", "h1", "h2")] + [T.StructField("counts", T.BinaryType())])


def _bits(docs: DataFrame) -> int:
    """Bits of a hash cell: a cell for every 256 bytes of text, so that the noise
    of a count stays the same at every size, up to ``MAX_BITS``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MAX_BITS, max(MIN_BITS, int(size // 256).bit_length()))


def _statistics(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Stored rows of two kinds, in one pass: (cell, counts) counts n-grams by
    hash cell, BLOCK cells from ``cell`` on in a row, (id, n, h1, h2) tells a
    document's set. The latter has cell null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        schema = pa.schema([(c, pa.int64()) for c in _STATS.names[:-1]] + [("counts", pa.binary())])
        for b in batches:
            size, h1, h2 = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, s in _sets(b.column(1), n):
                size[i] = len(s)
                h1[i], h2[i] = _set_hash(s)
                np.add.at(counts, (s >> C.U64(64 - bits)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(0), pa.array(size), pa.array(h1),
                                              pa.array(h2), pa.nulls(b.num_rows, pa.binary())], schema=schema)
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        for at in range(0, len(used), 1000):
            some = used[at:at + 1000]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(some * BLOCK), none, none, none, none,
                                              pa.array([blocks[k].tobytes() for k in some], pa.binary())], schema=schema)

    return C.materialise(docs.mapInArrow(run, _STATS), "shingle-statistics")


def _sketch(stats: DataFrame, bits: int) -> np.ndarray:
    """A byte per cell: its count over all documents in eighths of an octave.
    At most 2 ** MAX_BITS bytes reach the driver and every task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for cell, held in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(held.as_buffer(), np.int32)
                total[cell] = total[cell] + own if cell in total else own.astype(np.int64)
        codes = [np.minimum(255, np.round(8 * np.log2(1.0 + v))).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(codes, pa.binary())], names=["cell", "counts"])

    rows = stats.filter(F.col("cell").isNotNull()).select("cell", "counts").repartition("cell").mapInArrow(add, "cell long, counts binary")
    out = np.zeros(1 << bits, np.uint8)
    for cell, codes in zip(*(c.to_pylist() for c in rows.toArrow().columns)):
        out[cell:cell + BLOCK] = np.frombuffer(codes, np.uint8)
    return out


def _classes(docs: DataFrame, sketch: np.ndarray, bits: int, n: int, percent: int) -> DataFrame:
    """Stored (rep, n, bins, prefix): one row per distinct set."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)
    schema = T.StructType([T.StructField(c, _LONG) for c in ("id", "n", "h1", "h2")] +
                          [T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("prefix", _LONGS)])

    def run(b: pa.RecordBatch) -> Iterator[list]:
        ids, counts = b.column(0).to_pylist(), held.value
        out: list = []
        for i, s in _sets(b.column(1), n):
            m = len(s)
            if m and ids[i] is not None:
                first = m - -(-percent * m // 100) + 1
                rarest = np.argsort(counts[(s >> C.U64(64 - bits)).astype(np.int64)], kind="stable")[:first]
                out.append([ids[i], m, *_set_hash(s), np.bincount((s & C.U64(BINS - 1)).astype(np.int64), minlength=BINS),
                            C.signed(s[rarest])])
            if len(out) == 1000:
                yield list(zip(*out))
                out = []
        if out:
            yield list(zip(*out))

    rows = C.map_batches(docs, schema, run)
    return C.materialise(rows.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("bins").alias("bins"),
                                                           F.first("prefix").alias("prefix"))
                         .select("rep", "n", "bins", "prefix"), "shingle-classes")


def _need(n1: Column, n2: Column, percent: int) -> Column:
    """Least overlap of two linked sets: 100 * o >= percent * (n1 + n2 - o)."""
    return F.ceil(percent * (n1 + n2) / F.lit(100 + percent) - F.lit(1e-9))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length filter, the prefixes that two sets of these sizes need, and
    positional filter at a shared n-gram: of what stands before it only the
    ``s`` n-grams that any other set shares can be common."""
    of = lambda t, c: F.col(f"{t}.{c}")
    n1, n2, p1, p2 = of(x, "n"), of(y, "n"), of(x, "p"), of(y, "p")
    need = _need(n1, n2, percent)
    most = F.least(of(x, "s"), of(y, "s")) + F.least(n1 - p1, n2 - p2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (p1 <= n1 - need) & (p2 <= n2 - need) & (most >= need)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Stored links (a, b) among distinct candidate pairs."""
    of = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}"))
    most = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    pairs = C.materialise(pairs.join(of("a"), "a").join(of("b"), "b")
                          .filter(most >= _need(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b"), "pairs")
    found = C.materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids")
    ids = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    schema = T.StructType([T.StructField("id", _LONG), T.StructField("m", _LONG), T.StructField("grams", _LONGS)])

    def run(b: pa.RecordBatch) -> Iterator[list]:
        ids, out = b.column(0), []
        for i, s in _sets(b.column(1), n):
            out.append([ids[i].as_py(), len(s), C.signed(s)])
            if len(out) == 500:
                yield list(zip(*out))
                out = []
        if out:
            yield list(zip(*out))

    sets = C.map_batches(docs.join(ids, "id", "left_semi"), schema, run)
    sets = C.materialise(sets, "pair-sets")
    of = lambda x: sets.select(F.col("id").alias(x), F.col("m").alias(f"n_{x}"), F.col("grams").alias(f"grams_{x}"))
    # A set is told by id and size: rows of one id may hold several texts.
    both = pairs.join(of("a"), ["a", "n_a"]).join(of("b"), ["b", "n_b"])
    same = F.size(F.array_intersect("grams_a", "grams_b"))
    links = C.materialise(both.filter(100 * same >= percent * (F.col("n_a") + F.col("n_b") - same)).select("a", "b").distinct(),
                          "links")
    C.drop(pairs, found, sets)
    return links


def similar_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles`` and ``component_id``, the least
    id that links of at least ``percent`` percent Jaccard similarity reach."""
    C.ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bits = _bits(docs)
    stats = _statistics(docs, n, bits)
    classes = _classes(docs, _sketch(stats, bits), bits, n, percent)
    grams = classes.select("rep", "n", F.posexplode("prefix").alias("p", "g"))
    shared = grams.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("p")) - 1
    postings = C.materialise(grams.join(shared, "g").withColumn("s", place), "postings")

    def classed(links: DataFrame) -> DataFrame:
        """Stored postings of n-grams that several classes hold, with the class k."""
        found = components(links).withColumnRenamed("node", "rep")
        own = postings.join(found, "rep", "left").withColumn("k", F.coalesce("component", "rep")).drop("component")
        mixed = own.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("g")
        return C.materialise(own.join(mixed, "g"), "mixed")

    def partners(mixed: DataFrame, order: Column) -> DataFrame:
        """For every set one of another class: of the first sets of its n-grams
        by ``order`` the one that it shares most with."""
        first = mixed.groupBy("g").agg(F.min(F.struct(order.alias("o"), "rep", "n", "p", "s", "k")).alias("y")).select("g", "y.*")
        met = (mixed.alias("x").join(first.alias("y"), "g").filter((F.col("x.k") != F.col("y.k")) & _may_link("x", "y", percent))
               .groupBy(F.col("x.rep").alias("x"), F.col("y.rep").alias("y")).agg(F.count(F.lit(1)).alias("c")))
        best = met.groupBy("x").agg(F.max(F.struct(F.col("c"), -F.col("y"))).alias("m")).select("x", (-F.col("m.col2")).alias("y"))
        return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def remaining(mixed: DataFrame) -> DataFrame:
        """All pairs of different classes that can still be links: what they
        share up to the last shared n-gram of the prefixes, and what may follow."""
        x, y = mixed.alias("x"), mixed.alias("y")
        met = (x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.k") != F.col("y.k")) & (F.col("x.rep") < F.col("y.rep"))
                      & _may_link("x", "y", percent))
               .groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("n1"), F.col("y.n").alias("n2"))
               .agg(F.count(F.lit(1)).alias("c"), F.max("x.p").alias("p1"), F.max("y.p").alias("p2")))
        most = F.col("c") + F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) - 1
        return met.filter(most >= _need(F.col("n1"), F.col("n2"), percent)).select("a", "b")

    links, done = None, None
    mixed = every = postings.withColumn("k", F.col("rep"))
    for step in (F.lit(0), F.xxhash64("g", "rep"), F.xxhash64("rep"), None):
        pairs = (partners(mixed, step) if step is not None else remaining(mixed)).distinct()
        pairs = C.materialise(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "candidates")
        if links is not None and pairs.isEmpty():
            continue
        found = _verified(docs, classes, pairs, n, percent)
        links, done = (found, pairs) if links is None else (links.union(found), done.union(pairs))
        if step is not None:
            before, mixed = mixed, classed(links)
            if before is not every:
                C.drop(before)
    C.drop(*(t for t in (postings, mixed) if t is not every))

    # Nodes are least ids of equal sets; documents follow their set, and rows of one id their id.
    own = stats.filter(F.col("cell").isNull())
    by_set = own.filter("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    member = own.join(by_set, ["h1", "h2", "n"], "left")
    found = components(links.union(_several_sets(member)))
    return (member.join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id")))


def _several_sets(member: DataFrame) -> DataFrame:
    """Links between the sets of rows that share an id."""
    return (member.filter(F.col("rep").isNotNull()).groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
            .filter("a < b").select("a", "b"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row (or rows) of least id of every class; rows with a
    null id stay."""
    same, name = similar_classes(docs, n, percent, id_col, text_col), C.free_name(docs, "gone")
    gone = C.materialise(same.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(name)).distinct(),
                         "near-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
