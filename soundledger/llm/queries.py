"""The operators of this package over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundledger.llm.centroids import cluster_sql, cluster_vectors
from soundledger.llm.chat import CHAT_SQL, format_chats
from soundledger.llm.common import read
from soundledger.llm.language_model import score_texts
from soundledger.llm.lattice import near_vectors
from soundledger.llm.licenses import license_sql, scan_licenses
from soundledger.llm.mixing import mix_plan
from soundledger.llm.ngram_rules import quality_rules
from soundledger.llm.packing import pack_documents
from soundledger.llm.quality import score_documents, train
from soundledger.llm.simhash import simhash_groups
from soundledger.llm.topk import top_products
from soundledger.llm.trie import TRIE_SQL, prefix_trie
from soundledger.llm.warc import warc_round_trip
from soundledger.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read(spark, sf_dir, "labels")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents")).drop("first_time")


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op13_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality, op2_licenses, op3_language_model, op4_mixing, op5_lattice, op6_top_products, op7_simhash, op8_packing, op9_chat, op10_warc, op11_centroids, op12_trie, op13_ngram_rules)}
SQL: dict[str, str] = {
    "op2_licenses": license_sql(),
    "op6_top_products": """
        WITH v AS (
            SELECT *, row_number() OVER () AS rn FROM (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        ), scored AS (
            SELECT a.rn AS asked, a.vec_id AS query_id, b.vec_id, b.rn, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.rn <> b.rn WHERE a.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id, rn) AS INT) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 20
    """,
    "op9_chat": CHAT_SQL,
    "op11_centroids": cluster_sql(),
    "op12_trie": TRIE_SQL,
    "op4_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents
        ), sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        ranked AS (
            SELECT source, source_size, 3.0::DOUBLE * source_size AS most,
                   [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w
            FROM sources
        ), levels AS (
            SELECT *, most / w AS ratio,
                   (sum(most) OVER () / 3 - (sum(most) OVER (ORDER BY most / w, source NULLS LAST) - most))
                   / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM ranked
        ), level AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio),
        targets AS (SELECT source, source_size, least(most, w * level.level) AS target FROM levels, level),
        placed AS (
            SELECT s.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS need,
                   coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE
                   size * (need // source_size) + greatest(0, least(size, need - (need // source_size) * source_size - before))
               END::BIGINT AS taken
        FROM placed
    """,
}
