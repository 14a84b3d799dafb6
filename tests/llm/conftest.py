from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k.json"

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text[, lang[, source]]) rows."""

    def make(rows, extra=()):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *([None] * (4 - len(row))))
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCUMENT)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(f"own {name}"))
        return df

    return make


@pytest.fixture(scope="session")
def small_documents():
    """(doc_id, text, lang, source) of the smallest table, by id."""
    return duckdb.sql(
        "SELECT doc_id, text, lang, source FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id"
    ).fetchall()


@pytest.fixture(scope="session")
def odd_rows(small_documents):
    """Nulls, empty and very long texts, ties, repeated rows."""
    long_text = " ".join(t for _, t, *_ in small_documents)
    return [
        (None, "a row without an id, with words enough for shingles of all kinds"),
        (1, None),
        (2, ""),
        (3, "   \n\t  "),
        (4, small_documents[0][1], "en", "src0"),
        (4, small_documents[0][1], "en", "src0"),
        (5, small_documents[0][1], "en", None),
        (6, long_text, "en", "src1"),
        (7, "x" * 20_000, None, "src1"),
        (8, "naïve café 日本語 \U0001f600 <|endoftext|> tail\r\n\x00", "fr", ""),
    ]
