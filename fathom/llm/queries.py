"""Registered queries of the operators, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import (
    chunk_dedup,
    collocations,
    decontaminate,
    language_crf,
    license_scan,
    merge_replay,
    mixing,
    prefix_trie,
    simhash,
    sketches,
    token_counts,
    token_files,
    toxicity,
)
from fathom.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    """Only the queries that ask for a vocabulary need the package that has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(documents(spark, sf_dir))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_crf.identify(docs, language_crf.train(docs))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json")
    )


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(documents(spark, sf_dir))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_rows(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(documents(spark, sf_dir))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _tokenizer("byte_bpe_multi_50k.tiktoken")
    return merge_replay.round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_fingerprints": _op1,
    "op2_source_mixing": _op2,
    "op3_language_id": _op3,
    "op4_token_counts": _op4,
    "op5_toxicity": _op5,
    "op6_license_scan": _op6,
    "op7_token_files": _op7,
    "op8_benchmark_decontamination": _op8,
    "op9_simhash_near_dedup": _op9,
    "op10_substring_dedup": _op10,
    "op11_conversation_trie": _op11,
    "op12_merge_replay": _op12,
    "op13_collocations": _op13,
}

ORACLES: dict[str, str] = {
    "op2_source_mixing": mixing.ORACLE,
    "op6_license_scan": license_scan.oracle_sql(),
    "op11_conversation_trie": prefix_trie.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
