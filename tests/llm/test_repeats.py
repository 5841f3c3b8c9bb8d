"""Operators 3 and 7 against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from wearline.llm import substrings, suffix
from tests.llm.conftest import PASSAGE, documents


def words_left(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[j:j + window]) for _, w in texts for j in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j:j + window])] > 1:
                keep[j:j + window] = [False] * window
        out.append((i, len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, k in zip(w, keep) if k)).hexdigest()))
    return sorted(out, key=repr)


def bytes_left(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - length + 1):
            w = b[j:j + length]
            if w in seen:
                gone[j] += 1
                gone[j + length] -= 1
            seen.add(w)
        g = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((i, len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def mixed(seed, n=60):
    """Texts that share passages, cut at random places."""
    rng = np.random.default_rng(seed)
    base = [[f"t{x}" for x in rng.integers(0, 50, 400)] for _ in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(1, 5)):
            b = base[rng.integers(0, 4)]
            s = rng.integers(0, 300)
            parts += b[s:s + rng.integers(5, 150)] + [f"u{rng.integers(0, 10**9)}"] * int(rng.integers(0, 3))
        rows.append((i, " ".join(parts)))
    return rows


def run3(spark, rows, **kw):
    got = substrings.drop_repeats(documents(spark, rows), **kw)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr)


def run7(spark, rows, **kw):
    got = suffix.drop_repeats(documents(spark, rows), **kw)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=repr)


def test_words_odd_rows(spark, odd_rows):
    assert run3(spark, odd_rows) == words_left(odd_rows, 35)


@pytest.mark.parametrize("window,k", [(35, 10), (12, 4)])
def test_words_mixed(spark, window, k):
    rows = mixed(window)
    assert run3(spark, rows, window=window, k=k) == words_left(rows, window)


def test_bytes_odd_rows(spark, odd_rows):
    """One id with several rows: their order among themselves is not fixed, but equal rows make it immaterial."""
    assert run7(spark, odd_rows) == bytes_left(odd_rows, 100)


@pytest.mark.parametrize("pieces", [2, 8_000])
def test_bytes_mixed(spark, pieces, monkeypatch):
    """Two pieces to a shard send nearly all anchors through the merge of shards."""
    monkeypatch.setattr(suffix, "SHARD_PIECES", pieces)
    rows = mixed(5) + [(1000, PASSAGE), (1001, PASSAGE), (1002, "ab" * 300)]
    assert run7(spark, rows) == bytes_left(rows, 100)


def test_empty_tables(spark):
    assert run3(spark, []) == [] and run7(spark, []) == []


@pytest.mark.parametrize("alphabet", [1, 2, 5])
@pytest.mark.parametrize("n", [1, 2, 9, 400, 5000])
def test_suffix_array_and_prefixes(n, alphabet):
    t = np.random.default_rng(n).integers(0, alphabet, n).astype(np.uint8)
    b = t.tobytes()
    sa = suffix.suffix_array(t)
    assert list(sa) == sorted(range(n), key=lambda i: b[i:])

    def common(x, y):
        m = 0
        while m < 30 and max(x, y) + m < n and b[x + m] == b[y + m]:
            m += 1
        return m

    assert list(suffix.common_prefixes(t, sa, 30)) == [0] + [common(sa[i - 1], sa[i]) for i in range(1, n)]


def test_different_long_words_do_not_repeat(spark):
    """Two 35-word texts that differ in one word, a Thue-Morse word and its
    complement: nothing repeats, and a real copy does."""
    from tests.llm.test_similarity import thue_morse
    a, b = thue_morse(2048)
    words = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{words} {a}"), (2, f"{words} {b}"), (3, f"{words} {b}")]
    got = {r.doc_id: r.n_removed for r in substrings.drop_repeats(documents(spark, rows), window=35).collect()}
    assert got == {1: 0, 2: 35, 3: 35}


def test_minimizers_do_not_depend_on_the_batch():
    """Hashes alike in their upper bits, in a short batch and in a long one."""
    from wearline.llm.common import window_minimizers
    rng = np.random.default_rng(0)
    h = rng.integers(1 << 60, 1 << 63, 26).astype(np.uint64)
    h[5], h[20] = (1 << 44) + (1 << 21) + 7, (1 << 44) + 3
    long = np.concatenate([h, rng.integers(1 << 60, 1 << 63, 3_000_000).astype(np.uint64)])
    assert window_minimizers(h, 26)[0] == window_minimizers(long, 26)[0]
