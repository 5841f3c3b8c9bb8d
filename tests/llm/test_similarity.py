"""Operators 2 and 8 against brute force, and connected components."""

import re

import numpy as np
import pytest

from wearline.llm import jaccard, neardup
from wearline.llm.components import components
from tests.llm.conftest import documents


def classes_of(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(i, i + 7) for i in range(60)],
    [(5, 3), (3, 5), (9, None), (8, 7)],
])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == classes_of({x for e in real for x in e}, real)


def shingles(text, n):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_rows(seed=3):
    """Originals, copies, chains of growing edits, and texts near the limit."""
    rng = np.random.default_rng(seed)
    rows, number = [], 0
    for _ in range(6):
        words = [f"v{x}" for x in rng.integers(0, 3000, int(rng.integers(20, 120)))]
        for _ in range(9):
            rows.append((number, " ".join(words)))
            number += int(rng.integers(1, 5))
            words = list(words)
            for j in rng.integers(0, len(words), int(rng.integers(0, 3))):
                words[j] = f"x{rng.integers(0, 10**6)}"
    common = [f"license{i}" for i in range(40)]
    for i in range(30):
        rows.append((number + i, " ".join(common + [f"own{i}_{j}" for j in range(2 + i % 9)])))
    return rows


def run8(spark, rows, **kw):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_classes(documents(spark, rows), **kw).collect()}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_mixed(spark, n, percent):
    rows = near_rows()
    sets = {i: shingles(t, n) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = classes_of(sets, links)
    assert run8(spark, rows, n=n, percent=percent) == {(i, len(s), want[i]) for i, s in sets.items()}


def test_jaccard_odd_rows(spark, odd_rows):
    got = run8(spark, odd_rows, n=4, percent=85)
    by = {i: (n, c) for i, n, c in got if i is not None}
    assert by[1][1] == by[2][1] == by[10][1] == 1      # near and exact copies
    assert by[3] == (0, 3) and by[4] == (0, 4) and by[5] == (0, 5)
    assert by[6] == (1, 6) and by[11][0] == 1 and by[12] == (1, 12)
    assert {(n, c) for i, n, c in got if i is None} == {(1, None), (0, None)}
    assert run8(spark, [], n=4, percent=85) == set()


def test_keep_one(spark, odd_rows):
    docs = documents(spark, odd_rows).selectExpr("*", "1 AS gone", "2 AS GONE_")
    kept = [r.doc_id for r in jaccard.keep_one(docs, n=5, percent=80).collect()]
    sets = {i: shingles(t, 5) for i, t in odd_rows}
    stays = lambda i: not any(j is not None and j < i and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
                              for j in sets)
    assert sorted(x for x in kept if x is not None) == sorted(i for i, _ in odd_rows if i is not None and stays(i))
    assert kept.count(None) == 2


def thue_morse(n):
    word = "ab"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_of_one_polynomial_hash(spark, n):
    """A Thue-Morse word and its complement are different words."""
    a, b = thue_morse(n)
    rows = [(1, f"one two three {a}"), (2, f"one two three {b}"), (3, f"one two three {a}")]
    assert run8(spark, rows, n=4, percent=85) == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}


def brute2(vecs, least=0.9):
    good = {i: np.array(v, float) for i, v in vecs if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    c = classes_of([i for i, _ in vecs], links)
    return {(i, sum(i in e for e in links), c[i], c[i] == i) for i, _ in vecs}


def run2(spark, vecs, kind="float", **kw):
    df = spark.createDataFrame(vecs, f"vec_id bigint, embedding array<{kind}>").selectExpr(
        "*", "1 AS rep", "2 AS n", "3 AS label", "4 AS KEPT", "5 AS links")
    return {(r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.similar_vectors(df, **kw).collect()}


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, []),
            (7, [1.0, None, 0.0]), (8, [nan, 1.0, 1.0]), (9, [inf, 1.0, 1.0]), (10, [-1.0, 0.0, 0.0]), (11, [5.0, 0.0, 0.0]),
            (12, [1.0, 0.0]), (13, [2.0, 0.0]), (14, [1.0])]
    assert run2(spark, vecs, "double") == brute2(vecs)
    assert run2(spark, [(1, [1e300, 1e300]), (2, [1e-300, 1e-300])], "double") == {(1, 1, 1, True), (2, 1, 1, False)}
    assert run2(spark, []) == set()
    assert run2(spark, [(None, [1.0, 0.0]), (1, [1.0, 0.0])]) == {(None, 0, None, False), (1, 0, 1, True)}
    assert sorted(run2(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0])])) == [(1, 1, 1, True)]


@pytest.mark.parametrize("block", [16, 1024])
def test_vectors_recall_is_complete_here(spark, block, monkeypatch):
    """Close groups, one of them far larger than a block, and pairs near the
    limit; blocks of 16 send the groups through many block pairs."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 32))
    vecs = [base[i % 40 if i % 3 else 0] + rng.normal(size=32) * (0.02 if i % 2 else 0.15) for i in range(400)]
    vecs = [(i * 3, [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)]
    want, got = brute2(vecs), run2(spark, vecs)
    n = sum(x[1] for x in want)
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))  # no link below the limit
    assert sum(x[1] for x in got) >= 0.99 * n > 0
    assert [x[2:] for x in sorted(got)] == [x[2:] for x in sorted(want)]


@pytest.mark.parametrize("hashes", [3, 4, 5])
def test_vectors_recall_with_more_hashes(spark, hashes):
    """Pairs just above the limit, with the hashes of far larger tables."""
    rng = np.random.default_rng(8)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 300, 64)))
    y = y - (x * y).sum(axis=1, keepdims=True) * x
    y = 0.902 * x + np.sqrt(1 - 0.902 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    vecs = [(i, v.tolist()) for i, v in enumerate(np.stack([x, y], axis=1).reshape(600, 64))]
    got = run2(spark, vecs, "double", hashes=hashes)
    assert sum(g[1] for g in got) >= 0.985 * 600


def test_vectors_settings():
    """The expected recall at the limit holds for any number of rows."""
    for total in (400, 1_000_000, 200_000_000):
        hashes, tables = neardup.settings(total, [64], 0.9, 2, None, 11)
        assert neardup.meeting_share(64, 0.9, hashes, tables, 2, 5)[-1] >= 0.99
    assert neardup.settings(10**6, [2], 0.9, 2, None, 11)[0] == 1


def test_hashed_counts_add_up_over_partitions(spark):
    import numpy as np
    import pyarrow as pa

    from wearline.llm import jaccard as J
    texts = [f"common words here again {i} {i * 7 % 5} tail" for i in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    bits = J._bits(docs)
    assert bits == J.MIN_BITS
    want = np.zeros(1 << bits, np.int64)
    for _, s in J._sets(pa.array(texts), 3):
        np.add.at(want, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
    got = J._sketch(J._statistics(docs, 3, bits), bits)
    assert want.max() >= 60
    assert (got == np.round(8 * np.log2(1.0 + want))).all()
    assert not J._sketch(J._statistics(docs.limit(0), 3, bits), bits).any()
