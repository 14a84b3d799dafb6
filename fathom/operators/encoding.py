"""Category indexing and one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom import domain
from fathom.functions.codes import onehot_fixed
from fathom.operators.ordering import running_totals


def category_index(df: DataFrame, column: str, order: str = "frequency") -> DataFrame:
    """``(column, n, index)``: one row per category, numbered from 0.

    ``frequency`` puts the most frequent first, ties in text order; ``alphabet`` is text order.
    Nulls are not counted. The dictionary stays a table, so it may be of any size.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if order == "frequency":
        by = [F.col("n").desc(), F.col(column)]
    elif order == "alphabet":
        by = [F.col(column)]
    else:
        raise ValueError(f"order must be 'frequency' or 'alphabet', got {order!r}")
    ranked = running_totals(counts, by, {"index": F.lit(1)})
    return ranked.withColumn("index", (F.col("index") - 1).cast("double"))


def with_index(df: DataFrame, index: DataFrame, column: str, unseen: str = "error") -> DataFrame:
    """Add ``<column>_index`` from a table made by ``category_index``, fitted once and reused.

    The index may be of any size: it is joined, never collected. A value that it lacks is an
    error, or null with ``unseen="keep"``; null stays null.
    """
    number = index.select(F.col(column).alias("_category"), F.col("index").alias("_number"))
    joined = df.join(number, F.col(column) == F.col("_category"), "left").drop("_category")
    value = F.col("_number")
    if unseen == "error":
        text = F.concat(F.lit(f"Unseen label in {column}: "), F.col(column).cast("string"))
        lacking = F.col(column).isNotNull() & value.isNull()
        value = F.when(lacking, F.raise_error(text).cast("double")).otherwise(value)
    elif unseen != "keep":
        raise ValueError(f"unseen must be 'error' or 'keep', got {unseen!r}")
    return joined.withColumn(f"{column}_index", value).drop("_number")


def onehot_by_index(df: DataFrame, column: str, width: int) -> DataFrame:
    """Add ``<column>_onehot_<i>`` int columns for the first ``width`` numbers of ``<column>_index``.

    The caller states the width; further categories and null are all zero.
    """
    index = F.col(f"{column}_index")
    slots = {f"{column}_onehot_{i}": F.coalesce(index == i, F.lit(False)).cast("int") for i in range(width)}
    return df.withColumns(slots)


def onehot_lists(placeholder: bool = False) -> dict[str, Column]:
    """Ownership and intent columns over the fixed category lists."""
    columns = {
        **onehot_fixed("person_home_ownership", domain.OWNERSHIP_ONEHOT, "person_home_ownership_onehot"),
        **onehot_fixed("loan_intent", domain.INTENT_ONEHOT, "loan_intent_onehot"),
    }
    return columns | ({"loan_intent_onehot": F.lit(0)} if placeholder else {})


def onehot_loans(df: DataFrame, placeholder: bool = False) -> DataFrame:
    return df.withColumns(onehot_lists(placeholder)).drop("person_home_ownership", "loan_intent")
