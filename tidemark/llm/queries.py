"""Registered queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bag_minhash import near_duplicates
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.license_scan import license_matches
from tidemark.llm.mixing import mix
from tidemark.llm.pieces import Vocabulary, encode
from tidemark.llm.phrases import mine_phrases
from tidemark.llm.pii_scan import pii_digest, pii_spans
from tidemark.llm.quality import score_documents
from tidemark.llm.secret_scan import secret_spans, span_digest
from tidemark.llm.topk_search import topk_search
from tidemark.llm.url_filter import judge_urls
from tidemark.llm.warc import archive_round_trip
from tidemark.session import shared_dir

PIECES = os.environ.get("TIDEMARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
# The rules of the url query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH hashed AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("""
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10, scale=1024)


@query(r"""
WITH whole AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hexadecimal FROM pages
), digits AS (
    SELECT page_id, html, list_transform(range(8), lambda i: CAST(('0x' || substr(hexadecimal, CAST(5 * i + 1 AS BIGINT), 5)) AS BIGINT)) AS fives
    FROM whole
), hashed AS (
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(((fives[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest
    FROM digits
), first AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM first
""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives it was written to."""
    captures = archive_round_trip(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"), with_payload=False)
    field = lambda name: F.col("metadata.fields")[name].cast("long")
    revisit = F.col("response.type") == "revisit"
    return captures.select(
        field("pageId").alias("page_id"),
        F.when(revisit, field("payloadLength")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        field("revisitOf").alias("refers_to"),
    )


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return span_digest(secret_spans(table(spark, sf_dir, "documents")))


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mix(table(spark, sf_dir, "documents")).drop("text_sha256")


@query()
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, Vocabulary(PIECES)).select("doc_id", F.size("ids").alias("n_ids"), "ids", "round_trip")


@query()
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices found in the documents."""
    found = license_matches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


@query(r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), word AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM piece
), total AS (
    SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM word GROUP BY lang
), place AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM word
), gram AS (
    SELECT lang, list_slice(words, i, i + m - 1) AS phrase, CAST(count(*) AS HUGEINT) AS f
    FROM place, range(1, 6) AS size(m) WHERE i + m - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100
), cut AS (
    SELECT lang, phrase, f, unnest(range(1, len(phrase))) AS k FROM gram WHERE len(phrase) > 1
), scored AS (
    SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n, (1000 * c.f * n) // (l.f * r.f) AS score
    FROM cut c JOIN gram l ON l.lang = c.lang AND l.phrase = list_slice(c.phrase, 1, k)
    JOIN gram r ON r.lang = c.lang AND r.phrase = list_slice(c.phrase, k + 1, len(c.phrase)) JOIN total t ON t.lang = c.lang
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000 * c.f * n) // (l.f * r.f), k) = 1
), part AS (
    SELECT DISTINCT lang, f, list_slice(phrase, i, i + m - 1) AS phrase
    FROM (SELECT lang, f, phrase, unnest(range(1, len(phrase))) AS i FROM gram), range(2, 5) AS size(m)
    WHERE m < len(phrase) AND i + m - 1 <= len(phrase)
    UNION ALL
    SELECT DISTINCT lang, f, list_slice(phrase, len(phrase) - m + 1, len(phrase)) AS phrase FROM gram, range(2, 5) AS size(m) WHERE m < len(phrase)
), kept AS (
    SELECT s.*, array_to_string(s.phrase, ' ') AS text FROM scored s
    WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.lang = s.lang AND p.phrase = s.phrase AND 100 * p.f >= 100 * s.a)
)
SELECT lang, row_number() OVER best AS rank, text AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, text)
QUALIFY row_number() OVER best <= 2000
""")
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return mine_phrases(table(spark, sf_dir, "documents"))


@query("""
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole a JOIN whole c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
    WHERE a.vec_id % 50 = 0
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER one AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW one AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER one <= 3
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for the positives of every fiftieth vector, a seventh of the labels being wrong."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


@query()
def op13_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii_digest(pii_spans(table(spark, sf_dir, "documents")))
