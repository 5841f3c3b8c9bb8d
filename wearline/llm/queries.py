"""The registered queries of the corpus operators, and SQL where it can state
their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm.common import read_table


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wearline.llm.bpe import encode_decode
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm.neardup import similar_vectors
    return similar_vectors(read_table(spark, sf_dir, "embeddings"), min_cosine=0.9)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm.substrings import drop_repeats
    return drop_repeats(read_table(spark, sf_dir, "documents"), window=35).drop("kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm import secret_scan as S
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = S.scan(docs, S.train(docs))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(S.span_text("secrets", S.KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        S.span_text("secrets").alias("spans"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm.decontaminate import scan
    got = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


_OP5_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
     wins AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS win
              FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT n FROM wins),
     spots AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
     hits AS (SELECT doc_id, spots.n, s, item_id FROM spots JOIN wins USING (n, win)),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
     its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm import toxicity as X
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = X.train(docs, read_table(spark, sf_dir, "labels"))
    return X.score(docs, model).select("doc_id", X.held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm.suffix import drop_repeats
    return drop_repeats(read_table(spark, sf_dir, "documents"), length=100).drop("kept")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm.jaccard import similar_classes
    return similar_classes(read_table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm.warc import read_warc, write_warc
    index = write_warc(read_table(spark, sf_dir, "pages"), revisit_bytes=0)
    return read_warc(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the column ``lang`` is the declaration, ``source`` the host."""
    from wearline.llm import language as L
    docs = read_table(spark, sf_dir, "documents")
    return L.identify(docs, ["doc_id"], F.col("text"), F.col("lang"), F.col("source"), L.host_suffix(F.col("source")))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: declaration of the markup, host and suffix of the address."""
    from wearline.llm import language as L
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    host = L.url_host(F.col("url"))
    return L.identify(read_table(spark, sf_dir, "pages"), ["page_id"], body, L.markup_language(F.col("html")), host,
                      L.host_suffix(host))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm.divergence import divergence
    return divergence(read_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm.filter_audit import audit
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wearline.llm.topk_search import top_k
    return top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


_OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT + 1, 1)
         for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""

_OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
            WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
  reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
  n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(y) AS component_id, vec_id = min(y) AS kept
FROM reach JOIN v ON x = vec_id LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""

_OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  wins AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
  rep AS (SELECT doc_id, s FROM wins WHERE h IN (SELECT h FROM wins GROUP BY h HAVING count(*) > 1)),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM rep),
  words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP8_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y) AS component_id
FROM d JOIN reach ON x = d.doc_id LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

_OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
  wins AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)),
  late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM wins) WHERE r > 1),
  bytes AS (SELECT doc_id, p, substr(x, 2 * p + 1, 2) AS b FROM (SELECT doc_id, x, unnest(range(0, n)) AS p FROM d)),
  marked AS (SELECT b.doc_id, b.p, b.b, max(l.s) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
             FROM bytes b LEFT JOIN late l ON l.doc_id = b.doc_id AND l.s = b.p),
  runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM marked),
  sums AS (SELECT doc_id, sum(gone::INT) AS g, sum(begins::INT) AS k, string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone) AS hx FROM runs GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(g, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(hx, ''))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)
"""

_OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
  c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
  g AS (SELECT DISTINCT lang, source FROM d),
  v AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS total FROM g JOIN kept k USING (lang)
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  s AS (SELECT lang, source, term, n,
          1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS p,
          1 + (1000000000::HUGEINT * (total + 2)) // (sum(total) OVER w + 2 * count(*) OVER w) AS q
        FROM v WINDOW w AS (PARTITION BY lang, source)),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source
            LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
               FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 10
"""

_OP12_SQL = """
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
  d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
  w AS (SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM d),
  m AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
          (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
          + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x))::INT
          + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
        FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
  cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
  f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
  o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
        WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
  st AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step])::BIGINT - bits[step] AS before
         FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
  r AS (SELECT part, filter_order, step, bit,
          coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
          coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
          coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
          coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
        FROM cells, st GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

_OP13_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x) FOR x IN embedding::DOUBLE[]] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a, v b
        WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

QUERIES = {"op1_byte_level_bpe": op1_byte_level_bpe, "op2_embedding_near_dedup": op2_embedding_near_dedup,
           "op3_substring_dedup": op3_substring_dedup, "op4_secret_scan": op4_secret_scan,
           "op5_benchmark_decontamination": op5_benchmark_decontamination,
           "op6_toxicity": op6_toxicity, "op10_language_id": op10_language_id, "language_id_pages": language_id_pages,
           "op7_suffix_array_dedup": op7_suffix_array_dedup, "op8_ngram_jaccard_join": op8_ngram_jaccard_join, "op9_warc": op9_warc,
           "op11_source_divergence": op11_source_divergence, "op12_filter_audit": op12_filter_audit,
           "op13_topk_search": op13_topk_search}
ORACLES: dict[str, str] = {"op2_embedding_near_dedup": _OP2_SQL, "op3_substring_dedup": _OP3_SQL,
                           "op7_suffix_array_dedup": _OP7_SQL, "op8_ngram_jaccard_join": _OP8_SQL,
                           "op5_benchmark_decontamination": _OP5_SQL, "op9_warc": _OP9_SQL,
                           "op11_source_divergence": _OP11_SQL, "op12_filter_audit": _OP12_SQL, "op13_topk_search": _OP13_SQL}
