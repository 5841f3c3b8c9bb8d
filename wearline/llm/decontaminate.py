"""Benchmark decontamination (operator 5), in native functions throughout.

A prefix-filtered set join at containment 1: every item window is a sequence
of ``window`` words (a shorter item is one window). Words are ordered by their
count over all documents; a window can occur only where its first word in that
order, the rarest, occurs, so that one word is its necessary prefix. Document
words (each text split and stored once) join these prefixes by hash; the prefix word's place in the window fixes where
the window would start (position bound) and whether it fits (length bound),
and comparing the words there verifies exact containment.

Defined results: null and empty texts have no words and no hits, and items
without words have no windows. Rows are told apart by id and text, so
repeated rows have equal results and one id may hold several texts; null ids
are an id of their own. Repeated items count once per ``item_id``; a null
``item_id`` is left out of the items but its windows hit. Empty tables give no
rows or no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import materialise, small_side

#: Words, after lower-casing.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts of these characters only: lower() changes A-Z alone there.
_OTHER = r"[^\x00-\x7Fß-öø-ÿ‐-‧]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows are broadcast up to this size, as measured; beyond it they are shuffled.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(_OTHER), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def item_windows(bench: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, win): the windows of every item."""
    w = F.col("w")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1)))
    return (bench.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).filter(F.size(w) > 0)
            .select("item_id", F.explode(F.transform(starts, lambda i: F.slice(w, i, window))).alias("win")).distinct())


def stored_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored (id, key, n, w): the words of every text, split once."""
    split = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), words_of(F.col(text_col)).alias("w"))
    return materialise(split.select("id", "key", F.size("w").cast("long").alias("n"), "w"), "words")


def _prefixes(words: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """Stored (h, o, len, win): the rarest word of every window that can occur,
    as a hash, and its place there. Equal counts are ordered by the hash."""
    distinct = wins.select("win").distinct()
    at = distinct.select("win", F.posexplode("win").alias("o", "token")).select("win", "o", F.xxhash64("token").alias("h"))
    vocabulary = at.select("h").distinct()
    counts = (words.select(F.explode("w").alias("token")).select(F.xxhash64("token").alias("h"))
              .join(F.broadcast(vocabulary) if small else vocabulary, "h", "left_semi")
              .groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    best = at.join(counts, "h", "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "o")).alias("b"))
    return materialise(best.filter("b.n > 0").select("b.h", "b.o", F.size("win").alias("len"), "win"), "prefixes")


def find_windows(words: DataFrame, bench: DataFrame, window: int = 13, item_col: str = "item_id",
                 bench_text_col: str = "text") -> DataFrame:
    """Stored occurrences (id, key, start, len, item_id) of item windows in the
    texts of ``stored_words``; ``start`` counts words from 0."""
    wins = materialise(item_windows(bench, window, item_col, bench_text_col), "item-windows")
    size = wins.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "win")) + 16 * F.size("win")), F.lit(0))).first()[0]
    small = size <= BROADCAST_BYTES
    pre = _prefixes(words, wins, small)
    # w stands for the whole text in the broadcast plan, where only verified
    # rows are copied; a shuffle instead carries the words around the token.
    at = words.select("id", "key", "w", "n", F.posexplode("w").alias("p", "token")).withColumn("h", F.xxhash64("token"))
    base = F.lit(0)
    if not small:
        base = F.greatest(F.col("p") - (window - 1), F.lit(0))
        at = at.select("id", "key", F.slice("w", base + 1, 2 * window - 1).alias("w"), "n", base.alias("base"), "p", "h")
        base = F.col("base")
    start = at["p"] - F.col("pre.o")
    fits = (start >= 0) & (start + F.col("pre.len") <= at["n"])
    same = F.slice(at["w"], F.greatest(start - base + 1, F.lit(1)), F.col("pre.len")) == F.col("pre.win")
    pre = pre.alias("pre")
    found = (at.join(F.broadcast(pre) if small else pre, (at["h"] == F.col("pre.h")) & fits & same)
             .select("id", "key", start.alias("start"), F.col("pre.len").alias("len"), F.col("pre.win").alias("win")))
    found = found.join(F.broadcast(wins) if small else wins, "win").select("id", "key", "start", "len", "item_id")
    return materialise(found, "window-hits")


def hit_counts(found: DataFrame) -> DataFrame:
    """(id, key, n_hit, items): hit words and sorted items (as strings) of the
    texts that have any."""
    pos = (found.select("id", "key", "start", "len").distinct()
           .select("id", "key", F.explode(F.expr("sequence(start, start + len - 1)")).alias("p")).distinct()
           .groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_hit")))
    items = (found.select("id", "key", F.col("item_id").cast("string").alias("item_id")).distinct()
             .groupBy("id", "key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
             .select(F.col("id").alias("i_id"), F.col("key").alias("i_key"), "items"))
    return pos.join(items, pos.id.eqNullSafe(items.i_id) & (pos.key == items.i_key)).select("id", "key", "n_hit", "items")


def is_contaminated(n_hit, n_words, share: int = 20) -> Column:
    return (F.col(n_hit) > 0) & (share * F.col(n_hit) >= F.col(n_words))


def scan(docs: DataFrame, bench: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, items, contaminated."""
    words = stored_words(docs, id_col, text_col)
    hits = hit_counts(find_windows(words, bench, window, item_col, bench_text_col)).withColumnsRenamed({"id": "h_id", "key": "h_key"})
    out = words.select("id", "key", "n").join(hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumn(
                          "contaminated", is_contaminated("n_hit", "n_words"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = 13, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept."""
    words = stored_words(docs, id_col, text_col)
    hits = hit_counts(find_windows(words, bench, window)).withColumnsRenamed({"id": "h_id", "key": "h_key"})
    gone = (words.select("id", "key", "n").join(hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")))
            .filter(is_contaminated("n_hit", "n")).select("h_id", "h_key").distinct())
    gone = small_side(materialise(gone, "contaminated")).alias("g")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g.h_id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("g.h_key"))
    return docs.alias("d").join(gone, same, "left_anti")
