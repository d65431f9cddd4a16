"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, license_scan, line_templates, mtree, prefix_trie, qgram, quality_rules, recompression, wavelet
from .common import read
from .kneser_ney import lm_scores
from .pieces import segment
from .pu_quality import pu_quality
from .simhash import simhash_components


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fit_rows=20_000, folds=5, held_out=0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_dedup(spark, read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram.leaks(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment(read(spark, sf_dir, "documents"), n=4)
    return out.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shards = wavelet.write_token_shards(spark, read(spark, sf_dir, "documents"))
    out = wavelet.read_token_shards(spark, folder, shards)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(spark, read(spark, sf_dir, "documents"), order=3, folds=5, held_out=1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.substring_dedup(spark, read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark, read(spark, sf_dir, "documents"), size=4, radius=4)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark, read(spark, sf_dir, "conversations"), every=20, most=4)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(spark, read(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op13_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_scores(spark, read(spark, sf_dir, "embeddings"), k=10, every=100)


QUERIES = {
    f.__name__: f
    for f in (op1_pu_quality, op2_line_dedup, op3_license_scan, op4_benchmark_leaks, op5_pieces, op6_quality_rules, op7_token_shards, op8_lm_scores, op9_substring_dedup, op10_simhash, op11_prefix_trie, op12_centroids, op13_mtree)
}

ORACLE: dict[str, str] = {
    "op2_line_dedup": line_templates.oracle_sql(),
    "op3_license_scan": license_scan.oracle_sql(),
    "op6_quality_rules": quality_rules.oracle_sql(),
    "op9_substring_dedup": recompression.oracle_sql(),
    "op11_prefix_trie": prefix_trie.oracle_sql(),
    "op12_centroids": centroids.oracle_sql(),
    "op13_mtree": mtree.oracle_sql(),
}
