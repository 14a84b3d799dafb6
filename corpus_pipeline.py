"""From raw documents to token files in five stages, each over all that the one before kept.

1. language ID: documents without a language (``und``) or without a main one go,
2. SimHash near-duplicates, texts that share 0.8 of their five-word shingles: one document of every group
   stays,
3. benchmark decontamination: documents that hold a test item go,
4. mixing: documents are repeated, cut or left out until sources have their target weights,
5. token ids: what is left is written as shards with an index and read back.

``run`` writes every stage as Parquet to the shared folder and rereads it. The stages accept nulls
in any column, empty texts, repeated rows, empty tables and further columns: a null or empty text
has no language and goes in the first stage; the others are described at the operators. Stages
one to four return the columns they are given, the last one a row for each written row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import decontaminate, language_crf, mixing, token_files, wide_simhash
from fathom.llm.common import documents, plain_names
from fathom.sources.scratch import durable

# A document whose largest language has less than this expected share of its words has no main one.
LEAST_SHARE = 0.35
TOKENIZER = "byte_bpe_50k.json"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language, by a model learned from the stage's own input."""
    own = plain_names(docs, "doc_id", "text", "lang")
    named = language_crf.with_language(own, language_crf.train(docs))
    known = named.filter(
        (named["lang_pred"] != language_crf.UNDETERMINED) & (named["score"] >= LEAST_SHARE)
    )
    return known.select(*own.columns).toDF(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wide_simhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_rows(docs, public_tokenizers.path(TOKENIZER))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("token_files", write_tokens),
]

# A learned model and connected components are beyond SQL; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table: doc_id, start, n_tokens, ids_crc32 of every written row."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
