"""The queries of this subpackage for the driver, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.llm import bpe, clusters, divergence, lines, mix, ngrams, quality, records, secrets, substrings, suffixes, toxicity, vectors
from busline.llm.common import spread
from busline.sources.store import new_folder

VOCABULARY = "byte_bpe_50k.json"
#: From this score on a document counts as toxic.
TOXIC_FROM = 0.7


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def held_out() -> Column:
    """The fold that no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity of every document, learned outside the held-out fold, with its offending sentences."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "offending")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal vectors of equal label, as links and components."""
    return vectors.vector_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as binary records in doc_id order and read back."""
    out = new_folder(spark, "records")
    records.write_records(documents(spark, sf_dir), out, public_tokenizers.path(VOCABULARY))
    return records.read_index(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document by the Jaccard similarity of its sets of five words."""
    return ngrams.jaccard_classes(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by pattern and by confirmed structure."""
    return secrets.scan_secrets(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules of every document and the verdict on its host, for which its source stands."""
    kept = quality.apply_quality(documents(spark, sf_dir).select("doc_id", "source", "text"), F.col("source"))
    return kept.select("doc_id", *quality.COUNTS.fieldNames(), "base_failed", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in windows of 50 words that an earlier document has."""
    return substrings.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the text decoded from them."""
    return bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(VOCABULARY)).drop("text")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources to target weights takes of each document."""
    return mix.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that stand in an earlier three-line window, removed."""
    kept = lines.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components by integer k-means, and what its cluster amounts to."""
    found = clusters.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document in strings of 100 bytes that also start earlier, removed."""
    return suffixes.remove_earlier(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language stand apart in their terms, and the terms that mark each."""
    return divergence.audit_sources(documents(spark, sf_dir))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_records": op3_token_records,
    "op4_ngram_join": op4_ngram_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_mix_sources": op9_mix_sources,
    "op10_line_dedup": op10_line_dedup,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {"op6_quality_rules": quality.oracle(), "op9_mix_sources": mix.ORACLE, "op10_line_dedup": lines.ORACLE}
ORACLES |= {"op2_embedding_dedup": vectors.ORACLE, "op4_ngram_join": ngrams.ORACLE, "op7_substring_dedup": substrings.ORACLE}
ORACLES |= {"op11_centroid_clusters": clusters.oracle(), "op12_suffix_dedup": suffixes.ORACLE, "op13_source_divergence": divergence.ORACLE}
