"""A corpus pipeline over ``documents``: identify languages, keep one document
of each group of near copies, drop contaminated documents, blank out secrets,
and encode.

Every stage takes all rows that the one before it kept and, but for the last,
returns the columns of ``documents``. Rows keep their ids throughout; texts
change in the secret scan only, which also sets ``n_chars`` anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import bpe, decontaminate, jaccard, language, secret_scan
from wearline.llm.common import materialise, read_table

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: Rows and bytes of an Arrow batch. Both the JVM and the Python worker of a
#: task hold a whole batch, more than once while it is sent; texts with their
#: pretokens are about 5 kB a row.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 1 << 19


def small_batches(spark: SparkSession) -> None:
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    if not 0 < int(spark.conf.get(rows)) <= ROWS_PER_BATCH:
        spark.conf.set(rows, str(ROWS_PER_BATCH))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BYTES_PER_BATCH:
        spark.conf.set(size, str(BYTES_PER_BATCH))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose language cannot be told."""
    return language.keep_identified(docs, "text", F.col("lang"), F.col("source"), language.host_suffix(F.col("source")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group that links of 0.8 Jaccard
    similarity on five-word shingles make."""
    return jaccard.keep_one(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts with a twentieth or more of their words in benchmark windows."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; keeps every document."""
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text as it decodes from them."""
    small_batches(spark)
    both = bpe.encode_decode(docs, VOCABULARY, PATTERN, keep_text=False, lean=True)
    return both.select("doc_id", "lang", "source", F.col("decoded").cast("string").alias("text"),
                       F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", blank_secrets),
    ("byte_level_bpe", encode),
]

#: No SQL: language models, character models and byte-pair merges are not
#: stated in it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows stored before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
