"""The registered queries of this subpackage and their oracle SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.llm import (
    codes,
    langid,
    metricjoin,
    mixing,
    neardup,
    pieces,
    pii,
    quality,
    resample,
    sharding,
    substrings,
    topk,
    urlfilter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), "doc_id")


def op2_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), "doc_id"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op9_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"), pieces.Vocabulary.of(), "doc_id")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", "ids", "more", "round_trip")


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.jaccard_join(table(spark, sf_dir, "documents"), k=5)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_maxscore_topk": op2_maxscore_topk,
    "op3_language_id": op3_language_id,
    "op4_url_filters": op4_url_filters,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_minimax_sharding": op6_minimax_sharding,
    "op7_pii_deobfuscation": op7_pii_deobfuscation,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_nbest_pieces": op9_nbest_pieces,
    "op10_poisson_mixing": op10_poisson_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op2_maxscore_topk": topk.ORACLE,
    "op4_url_filters": urlfilter.ORACLE,
    "op5_substring_dedup": substrings.ORACLE,
    "op8_minhash_near_dedup": neardup.ORACLE,
    "op10_poisson_mixing": mixing.ORACLE,
    "op11_vector_codes": codes.ORACLE,
    "op12_ngram_jaccard_join": metricjoin.ORACLE,
    "op13_importance_resampling": resample.ORACLE,
}
