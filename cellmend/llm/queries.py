"""One query for each numbered operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.llm import clustering, divergence, fingerprints, licenses, lm_scoring, minhash_dedup, mixing, pii, quality, sentencepiece_codec, substring_dedup, token_counts, topk_search
from cellmend.llm.common import crc_fold

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Score from which a document counts as good.
QUALITY_THRESHOLD = 0.3


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode_documents(documents(spark, sf_dir), PIECE_MODEL, with_spans=True)
    widest = F.array_max(F.zip_with("ends", "begins", lambda end, begin: end - begin)).alias("widest_span")
    digest = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), widest, "ids")
    decoded = sentencepiece_codec.decode_documents(digest, PIECE_MODEL, keep=("n_tokens", "ids_sha256", "widest_span"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"), "widest_span")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "n_tokens", F.round("probability", 9).alias("probability"), "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), PIECE_MODEL)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_documents(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "within_next")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lm_scoring.score_lm(docs, lm_scoring.train_lm(docs))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect_pii(documents(spark, sf_dir))
    counts = [pii.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = F.sha2(pii.span_text(F.col("spans"), pii.BASE_KINDS), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.span_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.k_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_mixing, op3_token_counts, op4_quality, op5_substring_dedup, op6_topk_search, op7_fingerprints, op8_minhash_dedup, op9_lm_scoring, op10_pii, op11_source_divergence, op12_centroid_clustering, op13_license_scan)}
SQL: dict[str, str] = {
    "op2_mixing": mixing.mixing_sql(),
    "op11_source_divergence": divergence.divergence_sql(),
    "op12_centroid_clustering": clustering.k_means_sql(),
    "op13_license_scan": licenses.licenses_sql(),
    "op6_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
              FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
