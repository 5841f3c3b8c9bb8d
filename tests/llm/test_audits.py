"""Operators 11, 12 and 13 against brute force."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import divergence as D
from wearline.llm import filter_audit as A
from wearline.llm import topk_search as K

LOWER = {c: c + 32 for c in range(65, 91)}


def mixed_documents(seed, n=160):
    rng = np.random.default_rng(seed)
    langs, sources = ["en", "de", "", None], ["s1", "s2", "s10", "é", "", None]
    rows = []
    for i in range(n):
        words = [["Alpha", "beta", "ÄRGER", "straße", "x1y", "don't", "東京"][j] for j in rng.integers(0, 7, int(rng.integers(0, 30)))]
        rows.append((i, " ".join(words), langs[int(rng.integers(0, 4))], sources[int(rng.integers(0, 6))]))
    rows += [(900, None, "en", "s1"), (901, "", "xx", "lonely"), (902, "alpha", "yy", "p"), (903, "beta", "yy", "q"), (900, None, "en", "s1")]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr(
        "*", "1 AS n", "2 AS term", "3 AS total", "4 AS part", "5 AS mask", "6 AS digest", "7 AS terms", "8 AS value", "9 AS RANK")


def brute11(rows, min_docs, top=10):
    docs = [(lang or "", src or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, lang, src in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= min_docs]
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        whole = Counter(t for d in mine for t in d[2])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, 10**9), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if rank <= most:
                        out.add((lang, s, part, item, v, rank))
    return out


@pytest.mark.parametrize("min_docs,max_nodes,block", [(10, 100_000, 64), (1, 3, 2), (3, 1, 1)])
def test_divergence(spark, min_docs, max_nodes, block):
    rows = mixed_documents(min_docs)
    got = D.divergence(table(spark, rows), min_docs=min_docs, max_nodes=max_nodes, block=block)
    assert {tuple(r) for r in got.collect()} == brute11(rows, min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_divergence_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(D, "small_side", lambda df: df)
    rows = mixed_documents(5)
    assert {tuple(r) for r in D.divergence(table(spark, rows), min_docs=2).collect()} == brute11(rows, 2)


def test_divergence_of_nothing(spark):
    assert D.divergence(table(spark, [])).collect() == []
    assert {tuple(r) for r in D.divergence(table(spark, [(1, None, None, None), (2, "", "", "b")])).collect()} == \
        {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 16)
    text = "aB cdé" * 50 + " " + "Z" * 100 + " end"
    want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
    assert [t.decode() for x in D.term_pieces(text.encode()) for t in x] == want


def test_shares_are_exact(spark):
    rows = [(n, total, v) for n in (0, 1, 10**10, 9 * 10**17) for total in (n, n + 7, 9 * 10**17) for v in (1, 3, 10**9)]
    df = spark.createDataFrame(rows, "n bigint, total bigint, v bigint")
    for r in df.select("*", D.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect():
        assert r.p == 1 + 10**9 * (r.n + 2) // (r.total + 2 * r.v)


def test_tree_shares_paths_and_pairs():
    tree = D.TermTree()
    codes = [tree.code("en", s, 1) for s in "abc"]
    a, b, c = ((x << D.SHARE_BITS) | 100 for x in codes)
    for path, times in (([a, b], 2), ([a, b, c], 3), ([b, c], 1)):
        tree.insert(path, times)
    assert len(tree) == 5 and tree.weight == [5, 5, 3, 1, 1]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    one = f(100, 100) - 2 * f(100, 1) + f(1, 1)
    got = {(x, y): v for _, xs, ys, vs in tree.corrections() for x, y, v in zip(xs, ys, vs.tolist())}
    assert got == {("a", "b"): 5 * one, ("a", "c"): 3 * one, ("b", "c"): 4 * one}


def audit_rows():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        n = int(rng.integers(60, 160))
        text = " ".join(words[j % (300 if i % 3 else 40)] for j in rng.integers(0, 300, n))
        text = text.upper() if i % 5 == 0 else text
        rows.append((i, text + (" 50%" if i % 7 == 0 else "") + ("\x0bé 東" if i % 4 == 0 else ""), ["en", "de", None][i % 3], "s"))
    copies = [(200 + i, rows[i % 4][1], ["en", "fr"][i % 2], "s") for i in range(40)]
    return rows + copies + [(300, None, "en", "s"), (301, "", "de", "s"), (302, " \t ", "de", "s"), (7, rows[7][1], "fr", "s"),
                            (7, rows[7][1], "de", "s"), (None, rows[1][1], "en", "s"), (None, rows[1][1], "en", "s"), (303, "x" * 4000, "zz", "s")]


def brute12(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = {}
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts.setdefault(lang or "", []).append(({k for k, v in bad.items() if v}, i in good, i in toxic))
    out = set()
    for part, docs in parts.items():
        steps = []
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [d for d in docs if x in d[0] and not d[0] & before]
                steps.append(("".join(order), step, x, sum(not d[0] & (before | {x}) for d in docs), len(gone),
                              sum(x in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {x} for d in docs),
                              sum(d[1] for d in gone), sum(d[2] for d in gone)))
        shapley = Counter()
        for s in steps:
            shapley[s[2]] += s[4]
        out |= {(part, *s[:2], *s[3:], shapley[s[2]]) for s in steps}
    return out


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 11 == 0)) for i in range(0, 300, 2)] + [(4, 0, 0), (4, 1, None), (None, 1, 1), (7, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "1 AS good", "2 AS id", "3 AS part")
    got = [tuple(r) for r in A.audit(table(spark, rows), known).collect()]
    assert len(got) == len(set(got)) and set(got) == brute12(rows, labels)
    assert A.audit(table(spark, []), known).collect() == []
    assert {tuple(r) for r in A.audit(table(spark, rows[:5]), known.limit(0)).collect()} == brute12(rows[:5], [])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_reach_every_order_once(n):
    rng = np.random.default_rng(n)
    counts = {m: tuple(int(x) for x in rng.integers(0, 3, 2)) for m in range(1 << n)}
    diagram, seen = A.Diagram(counts, n), set()
    for path in A.orders(diagram):
        order = tuple(b for b, *_ in path)
        seen.add(order)
        for i, (_, kept, lost) in enumerate(path):
            before = sum(1 << b for b in order[:i])
            now = 1 << order[i]
            assert kept == tuple(sum(c[j] for m, c in counts.items() if not m & (before | now)) for j in range(2))
            assert lost == tuple(sum(c[j] for m, c in counts.items() if not m & before and m & now) for j in range(2))
    assert len(seen) == math.factorial(n)


def test_diagram_shares_equal_nodes():
    """Counts that do not depend on the last filters need one node a level."""
    diagram = A.Diagram({m: (1,) for m in range(32)}, 5)
    assert [len(x) for x in diagram.levels] == [1, 1, 1, 1, 1]
    for _ in A.orders(diagram):
        assert [len(x) for x in diagram.levels] == [1, 1, 1, 1, 1]


def test_words_of_long_texts(monkeypatch):
    text = ("aa b\x0bcc   é\t" * 40 + "x" * 90).encode()
    want = A.count_words(text)
    monkeypatch.setattr(A, "PIECE", 7)
    assert A.count_words(text) == want == (201, 6)


def brute13(rows, k=5, every=50, scale=256):
    good = [(i, [math.floor(scale * float(np.float64(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for o, (j, w) in enumerate(good) if o != at and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def run13(spark, rows, kind="float", **kw):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").selectExpr("*", "1 AS id", "2 AS rank", "3 AS code", "4 AS Q")
    return sorted(tuple(r) for r in K.top_k(df, **kw).collect())


@pytest.mark.parametrize("dim,shard,block", [(32, 1 << 19, 1 << 17), (64, 100, 3), (3, 50, 2), (1, 40, 4)])
def test_top_k(spark, dim, shard, block, monkeypatch):
    monkeypatch.setattr(K, "ROWS_AT_ONCE", 64)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(6, dim))
    rows = [(i, [float(np.float32(x)) for x in (base[i % 6] + rng.normal(size=dim) * 0.2) * (1 + i % 3)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)] + [(1100, rows[7][1]), (1100, rows[7][1]), (50, rows[9][1])]
    assert run13(spark, rows, shard_rows=shard, block_queries=block) == brute13(rows)


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (100, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [1.0, None]), (300, []), (350, []),
            (400, [0.1]), (450, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (-50, [0.0, 0.0]), (7, [1e4, -3e7]), (8, [2.0, 1.0]), (-3, [-0.001, 0.0039])]
    assert run13(spark, rows, "double") == brute13(rows)
    assert run13(spark, []) == [] and run13(spark, [(0, [1.0])]) == []
    assert run13(spark, [(50, [1.0])] * 3) == [(50, 1, 50, 65536)] * 3 + [(50, 2, 50, 65536)] * 3
    wide = [(0, [1e17, 1.0]), (1, [1e17, -1.0]), (2, [1.0, 1.0])]
    assert [r[:3] for r in run13(spark, wide, "double")] == [(0, 1, 1), (0, 2, 2)]


def test_bounds_settle_most_pairs():
    """Groups of smooth vectors: few pairs need their exact product, and the
    levels leave fewer and fewer."""
    rng = np.random.default_rng(1)
    base = np.repeat(rng.normal(size=(200, 8)), 8, axis=1) * 100
    x = (base[rng.integers(0, 200, 8000)] + rng.normal(size=(8000, 64)) * 8).astype(np.int64)
    ids = np.arange(8000)
    tally = {}
    who, found, score = K.search_cell(x[:256], ids[:256], x, ids, 5, tally)
    assert tally["pairs"] == 256 * 8000 and tally[1] >= tally[4] >= tally[16] >= tally["exact"] > 0
    assert tally["exact"] < 0.05 * tally["pairs"]
    full = x[:256] @ x.T
    full[np.arange(256), np.arange(256)] = -10**12
    for i in range(256):
        want = sorted(zip(-full[i], ids))[:5]
        mine = who == i
        assert sorted(zip(-score[mine], found[mine])) == want
