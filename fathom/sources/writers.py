"""Sinks: CSV, predictions, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows, such as accepted applications, to a stored table."""
    df.write.mode("append").parquet(path)


def prediction_output(
    scored: DataFrame, key: str = "id", name: str = "loan_status_prediction"
) -> DataFrame:
    """``(key, prediction as int)``, the shape of a submission file.

    With the ``error`` that says why there is no prediction, where the scoring gave one.
    """
    why = ["error"] if "error" in scored.columns else []
    return scored.select(key, F.col("prediction").cast("int").alias(name), *why)


def write_predictions(scored: DataFrame, path: str, key: str = "id", fmt: str = "parquet") -> None:
    writer = prediction_output(scored, key).write
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def as_json(df: DataFrame, column: str = "json", keep: list[str] | None = None) -> DataFrame:
    """Each row as one JSON text, built by the executors."""
    return df.select(*(keep or []), F.to_json(F.struct(*df.columns)).alias(column))


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "id", buckets: int = 64) -> DataFrame:
    """Write ``df`` as a catalog table whose files hold the rows of one bucket of the key each.

    Joins and aggregates on the key over tables with the same number of buckets need no exchange.
    Rows are dealt to the buckets before they are written, so that a bucket is one file.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)
