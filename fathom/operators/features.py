"""Model features: one projection, used alike for training and for scoring."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import derived
from fathom.functions.buckets import age_bucket, income_bucket
from fathom.functions.numeric import ratio


def _add(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in expressions.items()})


def status_features(df: DataFrame, zero_history: str = "zero") -> DataFrame:
    """Derived columns of the status model; replaces the default flag and the income.

    ``zero_history`` says what a ratio over an empty credit history is: 0 or null.
    """
    derived_columns = derived.status_expressions(zero_history)
    return _add(df, derived_columns).drop("cb_person_default_on_file", "person_income")


def grade_features(df: DataFrame) -> DataFrame:
    """Derived columns of the grade model."""
    return _add(df, derived.grade_expressions())


def grade_features_ordinal(df: DataFrame) -> DataFrame:
    """Grade features with ownership, intent and default flag as codes."""
    return _add(df, {**derived.ordinal_expressions(), **derived.grade_expressions()})


def add_buckets(df: DataFrame) -> DataFrame:
    return df.withColumns({"age_bucket": age_bucket(), "income_bucket": income_bucket()})


def percent_income(df: DataFrame, amount: str = "loan_amnt", income: str = "person_income") -> DataFrame:
    share = ratio(F.col(amount).cast("double"), F.col(income).cast("double"))
    return df.withColumn("loan_percent_income", share)


def layout_columns(df: DataFrame, layout: str, zero_history: str = "zero", keep: tuple = ()) -> DataFrame:
    """The feature columns of a layout, in its order."""
    columns, expressions = derived.layout_expressions(layout, zero_history)
    return _add(df, expressions).select(*keep, *columns)


def assemble(
    df: DataFrame, layout: str, handle_invalid: str = "skip", zero_history: str = "zero"
) -> DataFrame:
    """Add the feature vector. A row with a null feature is dropped, kept as NaN, or an error."""
    columns, expressions = derived.layout_expressions(layout, zero_history)
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid=handle_invalid)
    return assembler.transform(_add(df, expressions))


def assembled_counts(df: DataFrame, layout: str, zero_history: str = "zero") -> DataFrame:
    """Rows a ``skip`` assembly keeps and drops, in one pass."""
    columns, _ = derived.layout_expressions(layout, zero_history)
    kept = F.lit(True)
    for c in columns:
        kept = kept & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = layout_columns(df, layout, zero_history)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(kept, 1)).alias("n_kept"),
        F.count(F.when(~kept, 1)).alias("n_dropped"),
    )
