"""The operators of this subpackage bound to the tables of a data folder, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_repair, exact_dedup, lexical_search, near_dedup, packing, quality_gam, quality_rules, simhash_dedup, substring_dedup, token_counts, toxicity, warc, word_bpe


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_documents, _pages, _labels, _benchmark, _conversations = map(_table, ("documents", "pages", "labels", "benchmark", "conversations"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(token_counts.token_lengths(_documents(spark, sf_dir)))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_pages(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_decode(_documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(_documents(spark, sf_dir)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir)).drop("k2", "removed_lines")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.trial(_conversations(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_warc, op3_substring_dedup, op4_quality_classifier, op5_bpe, op6_minhash_near_dedup, op7_toxicity, op8_token_counts, op9_quality_rules, op10_exact_dedup, op11_lexical_search, op12_simhash_near_dedup, op13_conversation_repair)}
ORACLES = {"op6_minhash_near_dedup": near_dedup.ORACLE, "op9_quality_rules": quality_rules.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_lexical_search": lexical_search.ORACLE, "op13_conversation_repair": chat_repair.ORACLE}
