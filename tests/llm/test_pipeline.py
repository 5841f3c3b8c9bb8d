"""Every stage of the pipeline against brute force on its own input."""

import public_tokenizers as P
import pyarrow as pa
import tiktoken

import corpus_pipeline
from wearline.llm import bpe
from wearline.llm.common import materialise
from tests.conftest import SF001
from tests.llm.test_scans import base_spans, contaminated
from tests.llm.test_similarity import classes_of, shingles


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    noise = [(9001, None), (9002, ""), (9003, "1234 5678 !!"), (9004, "the password=0123456789abcdef of the and in to that is"), (None, "and the of to in")]
    more = spark.createDataFrame(noise, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'src0' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    docs = materialise(docs.unionByName(more), "fixture")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "secret_scan", "byte_level_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF001), name)
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows)
        if name != "byte_level_bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert set(before) - set(after) == {9001, 9002, 9003}
        if name == "ngram_jaccard":
            sets = {i: shingles(t, 5) for i, t in before.items() if i is not None}
            links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert set(after) == {i for i, c in classes_of(sets, links).items() if i == c} | {None} and links
        if name == "decontamination":
            assert set(after) == {i for i, *_, bad in contaminated(list(before.items()), bench) if not bad}
        if name == "secret_scan":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in rows)
            assert not any(base_spans(t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not base_spans(t))
            assert "0123456789abcdef" not in after[9004]
        if name == "byte_level_bpe":
            assert after == before
            assert all(r.ids == encoding.encode_ordinary(r.text) and r.n_tokens == len(r.ids) for r in rows)
        before = after


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF001), "empty")
    assert docs.count() == 0


def test_last_stage_sends_small_batches(spark):
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], "64m")
        corpus_pipeline.small_batches(spark)
        texts = spark.range(300).selectExpr("repeat('x', 10000) AS text").coalesce(1)
        sizes = texts.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n bigint").collect()
        assert sum(r.n for r in sizes) >= 3_000_000 and max(r.n for r in sizes) < 2 * corpus_pipeline.BYTES_PER_BATCH
        spark.conf.set(keys[1], "1000")      # a smaller limit of the session's own stays
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(keys[1]).rstrip("bB") == "1000"
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
