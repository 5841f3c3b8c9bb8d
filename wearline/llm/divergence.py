"""Source divergence audit over a frequent-pattern tree of term rows.

A language keeps the terms that stand in at least ``min_docs`` of its
documents. A row of the tree is one kept term: the sources that use it, in
order of their names, each with its smoothed share ``p`` there. Equal rows
enter the tree once, with their multiplicity, so rows with a common beginning
share a path.

The divergence of two sources sums ``f(p, q) = floor((p - q)^2 / (p + q))`` over
all kept terms. With ``p0``, ``q0`` the shares of a term that does not occur,

    sum f(p, q) = sum f(p, q0) + sum f(p0, q) - V f(p0, q0) + corrections,

where a term corrects the sum only if both sources use it: by ``f(p, q) -
f(p, q0) - f(p0, q) + f(p0, q0)``. The first two sums need the histogram of a
source's shares alone; every (node, ancestor) of the tree adds its correction
once, times the node's multiplicity.

Work is spread by (language, term), then by ranges of tree rows: a tree is
closed at ``max_nodes`` nodes, and since corrections add up, rows may be dealt to trees
in any way. Shares and sums are exact (decimals where a long may not do).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm.common import _give_back, each, materialise, row_slices, small_side
from wearline.session import ship_package

#: Bytes outside terms become blanks, A-Z small letters; bytes of characters
#: beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 20
#: A share is at most 10**9 + 1.
SHARE_BITS = 31


def term_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, about ``PIECE`` bytes of it at a time."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        end = at + PIECE
        if end < len(folded):
            cut = folded.rfind(b" ", at, end)
            if cut < 0:
                cut = folded.find(b" ", end)
            end = len(folded) if cut < 0 else cut + 1
        yield folded[at:end].split()
        at = end


_COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                         T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])


def count_chunk(groups: np.ndarray, raws: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, n, docs) of some texts, a row for each group and term."""
    split = [raw.translate(_FOLD).split() for raw in raws]
    words = pa.array(list(chain.from_iterable(split)), pa.binary()).dictionary_encode()
    known = max(1, len(words.dictionary))
    row = np.repeat(np.arange(len(raws)), [len(x) for x in split])
    del split
    each_doc, n = np.unique(row * known + words.indices.to_numpy(), return_counts=True)
    keys, at, docs = np.unique(groups[each_doc // known] * known + each_doc % known, return_inverse=True, return_counts=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, n)
    return keys // known, words.dictionary.take(pa.array(keys % known)), total, docs


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, counted in the
    tasks that read ``docs`` (lang, source, text) for about 4 ``PIECE`` bytes of
    text at a time; a longer text is counted on its own, piece by piece. A key
    comes several times."""
    ship_package(docs.sparkSession)

    def rows(b: pa.RecordBatch, raws: list[bytes]) -> pa.RecordBatch:
        if len(raws) == 1:
            seen: Counter = Counter()
            for terms in term_pieces(raws[0]):
                seen.update(terms)
            first, terms = np.zeros(len(seen), np.int64), pa.array(list(seen), pa.binary())
            n, found = np.fromiter(seen.values(), np.int64, len(seen)), np.ones(len(seen), np.int64)
        else:
            keys = b.select(["lang", "source"]).to_struct_array().to_pylist()
            place: dict = {}
            group = np.array([place.setdefault((k["lang"], k["source"]), i) for i, k in enumerate(keys)], np.int64)
            first, terms, n, found = count_chunk(group, raws)
        at = pa.array(first)
        return pa.RecordBatch.from_arrays([b.column("lang").take(at), b.column("source").take(at), terms.cast(pa.string()),
                                           pa.array(n), pa.array(found.astype(np.int64))], names=_COUNTED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").cast(pa.large_binary())
            size = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1])
            for s, e in row_slices(np.append(0, np.cumsum(size)), 4 * PIECE):
                yield rows(b.slice(s, e - s), text.slice(s, e - s).to_pylist())
        _give_back()

    return docs.mapInArrow(run, _COUNTED)


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10**9 (n + 2) / (total + 2 terms))``, exactly."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class TermTree:
    """A frequent-pattern tree. An item is the code of a (language, source)
    and its share in one number; rows of different languages part at the root."""

    def __init__(self) -> None:
        self.child: dict[tuple[int, int], int] = {}
        self.parent: list[int] = []
        self.item: list[int] = []
        self.weight: list[int] = []
        self.sources: dict[tuple[str, str], int] = {}
        self.p0: list[int] = []

    def __len__(self) -> int:
        return len(self.parent)

    def code(self, lang: str, source: str, p0: int) -> int:
        have = self.sources.setdefault((lang, source), len(self.sources))
        if have == len(self.p0):
            self.p0.append(p0)
        return have

    def insert(self, path: list[int], times: int) -> None:
        at = -1
        for item in path:
            node = self.child.get((at, item))
            if node is None:
                node = self.child[at, item] = len(self.parent)
                self.parent.append(at)
                self.item.append(item)
                self.weight.append(0)
            self.weight[node] += times
            at = node

    def corrections(self, most: int = 1 << 20) -> Iterator[tuple[list, list, list, np.ndarray]]:
        """(languages, ancestors' sources, nodes' sources, sums), one row for a
        pair of sources, or several where there are over ``most`` pairs."""
        names, codes = list(self.sources), len(self.sources)
        item, node = np.array(self.item, np.int64), np.arange(len(self))
        parent, weight, p0_of = np.array(self.parent, np.int64), np.array(self.weight, np.int64), np.array(self.p0, np.int64)
        code, share_of = item >> SHARE_BITS, item & ((1 << SHARE_BITS) - 1)
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(keys, sums):
            a, b = (keys // codes).tolist(), (keys % codes).tolist()
            return [names[x][0] for x in a], [names[x][1] for x in a], [names[x][1] for x in b], sums

        above = parent
        while True:
            inner = above >= 0
            node, above = node[inner], above[inner]
            if not len(node):
                break
            for s in range(0, len(node), most):
                x, y = node[s:s + most], above[s:s + most]
                p, p0, q, q0 = share_of[x], p0_of[code[x]], share_of[y], p0_of[code[y]]
                add = weight[x] * (_gaps(p, q) - _gaps(p, q0) - _gaps(p0, q) + _gaps(p0, q0))
                pair, at = np.unique(code[y] * codes + code[x], return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, at, add)
                keys, at = np.unique(np.append(keys, pair), return_inverse=True)
                both = np.zeros(len(keys), np.int64)
                np.add.at(both, at, np.append(sums, total))
                sums = both
                if len(keys) >= most:
                    yield rows(keys, sums)
                    keys, sums = keys[:0], sums[:0]
            above = parent[above]
        if len(keys):
            yield rows(keys, sums)


_PAIRS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()),
                       T.StructField("value", T.LongType())])


def factor(*cols: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's kind, and the first row of each kind."""
    code = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        d = c.dictionary_encode()
        code = code * max(1, len(d.dictionary)) + d.indices.to_numpy()
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def tree_corrections(rows: DataFrame, max_nodes: int = 100_000) -> DataFrame:
    """(lang, a, b, value) with a < b, to be summed, of the tree rows (lang,
    path, times). Rows come to a tree in the order of their paths."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(tree: TermTree) -> Iterator[pa.RecordBatch]:
            for cols in tree.corrections():
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(),) * 3 + (pa.int64(),))],
                                                 names=_PAIRS.names)

        tree = TermTree()
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            path = b.column("path")
            ends = np.asarray(path.offsets) - path.offsets[0].as_py()
            source, p, p0 = (path.flatten().field(c) for c in ("source", "p", "p0"))
            lang = b.column("lang").take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(ends))))
            user = pa.StructArray.from_arrays([lang, source, p0], ["lang", "source", "p0"])
            at, kinds = factor(lang, source)
            code = np.array([tree.code(**user[i].as_py()) for i in kinds.tolist()], np.int64)[at]
            items = (code << SHARE_BITS | p.to_numpy()).tolist()
            for i, times in enumerate(b.column("times").to_pylist()):
                tree.insert(items[ends[i]:ends[i + 1]], times)
            if len(tree) >= max_nodes:
                yield from out(tree)
                tree = TermTree()
        yield from out(tree)
        del tree
        _give_back()

    return (rows.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").select("lang", "path", "times")
            .mapInArrow(run, _PAIRS))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10,
               top: int = 10, max_nodes: int = 100_000, block: int = 64, salts: int = 8) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring (language,
    source). Part ``pair``: the divergence from every other source of the
    language. Part ``term``: the ``top`` kept terms that the source uses more
    than its language, by their gap. Ranks go by falling value, then item.

    Null texts, languages and sources count as empty ones; a repeated row is
    one more document; a language without kept terms has pairs of value 0; an
    empty table gives no rows. Other columns of ``docs`` play no part."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term's row has an entry for each source of its language at most
    terms = materialise(counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("uses"))
        .filter(F.col("docs") >= min_docs).select("lang", "term", "total", "uses"), "terms")
    uses = terms.select("lang", "term", "total", F.explode("uses").alias("u")).select("lang", "term", "total", "u.source", "u.n")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    used = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("used"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    groups = (docs.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", zero("total").alias("total"), zero("used").alias("used"), zero("terms").alias("terms"),
                      zero("lang_total").alias("lang_total")))
    p0 = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))
    groups = materialise(groups.select("*", p0.alias("p0")), "groups")
    few = small_side(groups)

    shares = (uses.join(few.select("lang", "source", F.col("total").alias("of"), "terms", "lang_total", "p0"), ["lang", "source"])
              .select("lang", "term", "source", share(F.col("n"), F.col("of"), F.col("terms")).alias("p"), "p0",
                      share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q")))

    # both sums over one source's shares; the sources of a language meet by blocks
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // block))
    spread = (shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m")).withColumn("none", F.lit(False))
              .unionByName(groups.select("lang", "source", F.col("p0").alias("p"), "p0", (F.col("terms") - F.col("used")).alias("m"),
                                         F.lit(True).alias("none"))))
    salt = F.pmod(F.xxhash64("source", "p"), F.lit(salts))
    left = spread.select("*", salt.alias("salt"), each(blocks).alias("block"))
    right = few.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), "terms",
                       F.pmod(F.xxhash64("source"), F.lit(blocks)).alias("block"),
                       each(salts).alias("salt"))
    alone = (left.join(right, ["lang", "salt", "block"]).filter(F.col("source") != F.col("other"))
             .select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"),
                     F.coalesce(F.col("m") * gap(F.col("p"), F.col("q0"))
                                - F.when(F.col("none") & (F.col("source") < F.col("other")), F.col("terms") * gap(F.col("p0"), F.col("q0")))
                                .otherwise(0), F.lit(0)).alias("value"))
             .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    rows = (shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("path"))
            .filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times")))
    pairs = alone.unionByName(tree_corrections(rows, max_nodes)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = pairs.select("lang", "value", F.explode(ends).alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    found = (shares.filter(F.col("p") > F.col("q"))
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(found)
