"""Registered queries: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclumen.llm.divergence import divergence
from doclumen.llm.embedding_dedup import embedding_dedup
from doclumen.llm.line_dedup import line_dedup
from doclumen.llm.mixing import mix
from doclumen.llm.packing import pack_documents
from doclumen.llm.personal_data import personal_data
from doclumen.llm.prefix_trie import prefix_trie
from doclumen.llm.quality_classifier import quality
from doclumen.llm.quality_rules import quality_rules
from doclumen.llm.sharding import kd_shards
from doclumen.llm.simhash import simhash
from doclumen.llm.substring_dedup import substring_digests
from doclumen.llm.toxicity import toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(_read(spark, sf_dir, "documents"), shards=8)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash(_read(spark, sf_dir, "documents")).select("doc_id", hexed.alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(_read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "text", "n_removed_lines", "n_removed_chunks")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_read(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_read(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_kd_sharding, op2_simhash, op3_substring_dedup, op4_line_dedup, op5_quality_classifier,
        op6_embedding_dedup, op7_toxicity, op8_mixing, op9_packing, op10_quality_rules,
        op11_prefix_trie, op12_personal_data, op13_source_divergence,
    )
}
