"""Registered queries: one thin ``opN_<name>`` for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, infill, minhash, packing, pii, quality, rules, secrets, sharding, simhash, substrings, trie, warc
from tessera.llm.oracles import ORACLES


__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).drop("removed")


def op2_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that the rules of op3 judge by, which SQL can state."""
    return rules.counted(rules.statistics(table(spark, sf_dir, "documents")))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_kd_tree_sharding": op2_kd_tree_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc_index": op4_warc_index,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pii": op7_pii,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_trie": op13_conversation_trie,
    "quality_statistics": quality_statistics,
}
