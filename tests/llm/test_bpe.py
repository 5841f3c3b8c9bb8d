import hashlib

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from wearline.llm import bpe
from tests.llm.conftest import documents

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})


def test_equal_to_tiktoken_and_round_trip(spark, odd_rows, reference):
    more = [(100, "I'll say it's 'tis they've don't  two   blanks\n\n x"), (101, "<|endoftext|> 123456 ½ ٣ é́"),
            (102, "x" * 3000 + "ab" * 2000), (103, "   "), (104, "　   a\u0085b")]
    got = bpe.encode_decode(documents(spark, odd_rows + more), VOCABULARY, P.PATTERN).select("doc_id", "text", "ids", "decoded", "score")
    rows = got.collect()
    assert len(rows) == len(odd_rows) + len(more)
    for r in rows:
        text = r.text or ""
        assert r.ids == reference.encode_ordinary(text), r.doc_id
        assert bytes(r.decoded) == text.encode()
        assert r.score == "x"


def test_encode_and_decode_apart(spark, reference):
    ids = bpe.encode(documents(spark, [(1, "one two"), (2, None)]), VOCABULARY, P.PATTERN)
    back = bpe.decode(ids.selectExpr("doc_id", "CASE WHEN doc_id = 1 THEN ids END AS ids"), VOCABULARY)
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in back.collect()} == {1: b"one two", 2: None}


def test_unknown_id_raises(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([1, 99_999_999],)], "ids array<int>"), VOCABULARY).collect()


def test_empty_table(spark):
    assert bpe.encode_decode(documents(spark, []), VOCABULARY, P.PATTERN).count() == 0


def test_every_token_encodes_to_itself(reference):
    """What lets a step contract all repeats of the least pair of a word."""
    ranks = bpe.load_ranks(VOCABULARY)
    voc = bpe._Vocabulary(VOCABULARY)
    import pyarrow as pa
    texts = [t.decode() for t in ranks if _is_text(t)]
    ids, start, end = voc.encode(pa.array(texts, pa.large_string()))
    assert all(list(ids[s:e]) == [ranks[t.encode()]] for t, s, e in zip(texts, start, end))


def _is_text(t):
    try:
        t.decode()
        return True
    except UnicodeDecodeError:
        return False


def test_long_words(reference):
    """Unbroken words: random letters, runs, and runs that overlap."""
    import random

    import pyarrow as pa
    draw, voc = random.Random(5), bpe._Vocabulary(VOCABULARY)
    texts = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), "a" * 9_999, "ab" * 5_000 + "a", "aab" * 4_001,
             "".join(draw.choices("ab", k=8_000)), "東京" * 3_000, "x", "=" * 777]
    ids, start, end = voc.encode(pa.array(texts, pa.large_string()))
    for t, s, e in zip(texts, start, end):
        assert list(ids[s:e]) == reference._encode_single_piece(t)


@pytest.mark.parametrize("rows", [1, 10**6])
def test_merge_that_makes_a_lower_pair(rows, monkeypatch):
    """A made-up vocabulary in which a merge makes a pair of lower rank: its
    repeats are then contracted one by one, as the rule has it."""
    import itertools

    import pyarrow as pa
    monkeypatch.setattr(bpe, "ROWS_OF_STEPS", rows)
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 300, b"abcb": 350, b"bc": 400, b"cb": 500, b"bcbc": 600}
    voc = bpe._Vocabulary(_file_of(ranks))
    texts = ["".join(t) for n in range(1, 8) for t in itertools.product("abc", repeat=n)]
    ids, start, end = voc.encode(pa.array(texts, pa.large_string()))
    for t, s, e in zip(texts, start, end):
        parts = [bytes([c]) for c in t.encode()]
        while True:
            least = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
            if least is None:
                break
            i = least[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert list(ids[s:e]) == [ranks[x] for x in parts], t


def _file_of(ranks):
    import base64
    import tempfile
    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken", delete=False) as f:
        f.writelines(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items())
    return f.name


def test_query_digests(spark, reference):
    from tests.conftest import SF001
    from wearline.llm.queries import op1_byte_level_bpe
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    for r in op1_byte_level_bpe(spark, SF001).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_text_need_not_go_to_the_workers(spark):
    docs = documents(spark, [(1, "one two"), (2, None)])
    got = bpe.encode_decode(docs, VOCABULARY, P.PATTERN, keep_text=False)
    assert "text" not in got.columns
    assert {r.doc_id: bytes(r.decoded) for r in got.collect()} == {1: b"one two", 2: b""}


def test_lean_workers_keep_fewer_words_and_encode_alike(spark, reference, monkeypatch):
    path = VOCABULARY
    monkeypatch.setattr(bpe, "LEAN_WORDS_KEPT", 3)
    voc = bpe._Vocabulary(path, lean=True)
    setting = "SELECT current_setting('allocator_flush_threshold')"
    assert voc.db.sql(setting).fetchall() != bpe._Vocabulary(path).db.sql(setting).fetchall()
    for words in (["one", " two", " three", " four"], [" five", "one"], ["one", " six"]):
        ids, start, end = voc.encode(pa.array(words, pa.large_string()))
        assert [ids[a:z].tolist() for a, z in zip(start, end)] == [reference.encode_ordinary(w) for w in words]
    assert voc.words.to_pylist() == [" five", "one", " six"]      # the first four were dropped, beyond three
    docs = documents(spark, [(1, "one two"), (2, None), (3, "".join(f" word{i}" for i in range(50)))])
    got, plain = (bpe.encode_decode(docs, path, P.PATTERN, lean=x).collect() for x in (True, False))
    assert got == plain
