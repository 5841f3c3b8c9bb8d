"""Filter interaction audit: what each filter removes, in every order.

A document fails some of the filters; the set of these is its mask. A
count-weighted decision diagram per part has one level per filter: a node
stands for the documents with one outcome of the filters above it (nodes with
equal continuations are one node), has a branch for those that pass its filter
and one for those that fail it, and weighs their counts. Neighbouring levels
swap in place, and all orders are reached by such swaps. In each order the path
of passing branches from the root gives the steps: what leaves it by a failing
branch is what that step removes.

Spark counts (part, mask) from all documents; a diagram then holds at most
2**filters counts, however many documents a part has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.llm.common import append_columns, materialise
from wearline.session import ship_package

PIECE = 1 << 20
_BLANK = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
_LATER = bytes(range(0x80, 0xC0))     # bytes of a character after its first


def count_words(raw: bytes) -> tuple[int, int]:
    """Words between blanks (0x20, 0x09-0x0D), and distinct ones; long texts in
    pieces that end at a blank."""
    if len(raw) <= PIECE:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and raw[end] not in _BLANK:
            end += 1
        words = raw[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failed(raw: bytes, min_words: int, distinct_percent: int, capital_percent: int, symbols: bytes) -> int:
    """Bits of the filters on the text alone: too short (1), too repetitive
    (2), too many capitals (4), symbols (8)."""
    words, distinct = count_words(raw)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    points = len(raw.translate(None, _LATER))
    return ((words < min_words) | (100 * distinct < distinct_percent * words) << 1 | (100 * capitals > capital_percent * points) << 2
            | (len(raw.translate(None, symbols)) < len(raw)) << 3)


def filter_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = 100,
                    distinct_percent: int = 80, capital_percent: int = 10, symbols: str = "#$%&*|") -> DataFrame:
    """(id, part, mask, digest) of every document: the bits of ``failed`` and
    the SHA-256 of the whole text. Null texts and parts count as empty."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = symbols.encode()

    def measure(b: pa.RecordBatch) -> list:
        raws = [x.as_buffer() for x in b.column("text").cast(pa.binary())]
        return [[failed(r.to_pybytes(), min_words, distinct_percent, capital_percent, marks) for r in raws],
                [hashlib.sha256(r).digest() for r in raws]]

    return append_columns(rows, [T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())], measure, drop=("text",))


def copy_failures(masks: DataFrame, bit: int) -> DataFrame:
    """(part, mask, n, good, toxic): counts of ``masks`` (id, part, mask,
    digest, good, toxic), where a document also fails by ``bit`` if one of
    smaller id has the same digest. Rows without an id have no smaller one and
    are none. No group of copies meets in one task: counts of every (digest,
    part) are added up beside those of its first id, and the part that holds
    the digest's first id passes that many."""
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    one = (masks.groupBy("id", "digest", "part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("bigint")).alias("good"), F.sum(F.col("toxic").cast("bigint")).alias("toxic")))
    known = one.filter(F.col("id").isNotNull())
    each = known.groupBy("digest", "part", "mask").agg(*sums, F.min(F.struct("id", "n", "good", "toxic")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    each = each.withColumn("leads", F.col("first.id") == least)
    passes = lambda c: F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask"), *[passes(c).alias(c) for c in ("n", "good", "toxic")]),
                             F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), *[(F.col(c) - passes(c)).alias(c) for c in ("n", "good", "toxic")])))
    cells = each.select("part", both.alias("x")).select("part", "x.*")
    return cells.unionByName(one.filter(F.col("id").isNull()).select("part", "mask", "n", "good", "toxic")).groupBy("part", "mask").agg(*sums)


class Diagram:
    """A count-weighted decision diagram. ``order`` names the filter of each
    level (its bit); a node is a list [pass, fail, weight], a leaf a tuple of
    counts, a weight the counts of a node's documents."""

    def __init__(self, counts: dict[int, tuple], filters: int):
        self.order = list(range(filters))
        self.levels: list[dict] = [{} for _ in range(filters)]
        self.zero = tuple(0 for _ in next(iter(counts.values()), (0,)))
        self.leaves: dict[tuple, tuple] = {}
        self.root = self._build(counts, 0)

    def _leaf(self, counts: tuple) -> tuple:
        return self.leaves.setdefault(counts, counts)

    def _node(self, level: int, ok, bad) -> list:
        """The one node of a level with these branches."""
        have = self.levels[level].get((id(ok), id(bad)))
        if have is None:
            weight = tuple(a + b for a, b in zip(self.weight(ok), self.weight(bad)))
            have = self.levels[level][id(ok), id(bad)] = [ok, bad, weight]
        return have

    def _build(self, counts: dict[int, tuple], level: int):
        if level == len(self.levels):
            return self._leaf(next(iter(counts.values()), self.zero))
        bit = 1 << level
        sides = ({m: c for m, c in counts.items() if not m & bit}, {m: c for m, c in counts.items() if m & bit})
        return self._node(level, *(self._build(s, level + 1) for s in sides))

    @staticmethod
    def weight(node) -> tuple:
        return node[2] if isinstance(node, list) else node

    def swap(self, level: int) -> None:
        """Exchange a level with the next one. Nodes of the level stay in place
        and so do the nodes that lead to them; the next level is made anew."""
        self.levels[level + 1] = {}
        table: dict = {}
        for node in list(self.levels[level].values()):
            ok, bad = node[0], node[1]
            node[0], node[1] = self._node(level + 1, ok[0], bad[0]), self._node(level + 1, ok[1], bad[1])
            table[id(node[0]), id(node[1])] = node
        self.levels[level] = table
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> list[tuple[int, tuple, tuple]]:
        """(filter, counts that pass up to it, counts it removes) by level."""
        out, node = [], self.root
        for bit in self.order:
            out.append((bit, self.weight(node[0]), self.weight(node[1])))
            node = node[0]
        return out


def swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, to see every order of ``n`` once:
    the last one sweeps through each order of the others, to and fro."""
    if n < 2:
        return
    sweep = list(range(n - 2, -1, -1))
    yield from sweep
    away = True
    for level in swaps(n - 1):
        yield level + 1 if away else level
        yield from reversed(sweep) if away else sweep
        away = not away


def orders(diagram: Diagram) -> Iterator[list]:
    """The path of every order of the diagram's filters."""
    yield diagram.path()
    for level in swaps(len(diagram.levels)):
        diagram.swap(level)
        yield diagram.path()


def part_steps(counts: dict[int, tuple], names: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of a part's (n, good, toxic) by mask."""
    paths = list(orders(Diagram(counts, len(names))))
    fails, alone, shapley = {}, {}, dict.fromkeys(range(len(names)), 0)
    for path in paths:
        fails[path[0][0]] = path[0][2][0]          # first in the order: nothing is removed before
        alone[path[-1][0]] = path[-1][2][0]        # last: all others pass
        for bit, _, lost in path:
            shapley[bit] += lost[0]
    return [("".join(names[b] for b, *_ in path), step, kept[0], lost[0], fails[bit] - lost[0], alone[bit], lost[1], lost[2], shapley[bit])
            for path in paths for step, (bit, kept, lost) in enumerate(path, 1)]


_STEPS = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_masks(counted: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, of the counts (part,
    mask, n, good, toxic); bit ``i`` of a mask is filter ``names[i]``. The rows
    of a part are at most 2**filters, and there are ``len(names)!`` orders."""
    if len(set(names)) != len(names) or len(names) > 8:
        raise ValueError("names must be up to eight different letters")
    ship_package(counted.sparkSession)
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()),
                           T.StructField("step", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in _STEPS[2:]])
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, have in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                rows = part_steps({x["mask"]: (x["n"], x["good"], x["toxic"]) for x in have}, names)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32())]
                    + [pa.array(c, pa.int64()) for c in cols[2:]], names=schema.names)

    return cells.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          names: str = "ABCDE", **limits) -> DataFrame:
    """The audit of five filters: short (A), repetitive (B), capitals (C),
    symbols (D; these take ``limits`` of ``filter_failures``) and copies of a
    document with a smaller id anywhere in the table (E).

    Null texts and parts count as empty; an empty table gives no rows; a
    repeated row counts again, and is no copy of rows with its own id; rows
    without an id are copies of none. A document is good (toxic) if any row of
    ``labels`` with its id has quality 1 (toxic 1)."""
    known = (labels.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("q"),
                           F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("t"))
             .filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("q").alias("good"), F.max("t").alias("toxic")))
    masks = materialise(filter_failures(docs, id_col, text_col, part_col, **limits), "masks").join(known, "id", "left").select(
        "id", "part", "mask", "digest", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return audit_masks(copy_failures(masks, 1 << 4), names)
