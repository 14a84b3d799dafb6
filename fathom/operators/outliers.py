"""Quartiles, interquartile fences, outlier flags and repair by group median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.quantiles import approx_quantiles, exact_quantiles, few_groups

QUARTILES = (0.25, 0.5, 0.75)


def quartiles(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """``(column_name, q1, q2, q3)``, one row per column."""
    found = (exact_quantiles if exact else approx_quantiles)(df, list(columns), QUARTILES)
    return found.groupBy("column_name").agg(
        *(
            F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
            for name, p in zip(("q1", "q2", "q3"), QUARTILES)
        )
    )


def iqr_bounds(df: DataFrame, columns: Sequence[str], exact: bool = True, reach: float = 1.5) -> DataFrame:
    """``(column_name, lower_bound, upper_bound)`` at ``reach`` interquartile ranges."""
    spread = F.lit(reach) * (F.col("q3") - F.col("q1"))
    return quartiles(df, columns, exact).select(
        "column_name",
        (F.col("q1") - spread).alias("lower_bound"),
        (F.col("q3") + spread).alias("upper_bound"),
    )


def _fences(df: DataFrame, columns: Sequence[str], exact: bool) -> dict[str, tuple]:
    """Two numbers per column, brought to the driver so that scans can compare with literals."""
    rows = iqr_bounds(df, columns, exact).collect()
    return {r["column_name"]: (r["lower_bound"], r["upper_bound"]) for r in rows}


def _outside(column: str, fences: dict[str, tuple]) -> Column:
    lower, upper = fences[column]
    value = F.col(column)
    return F.coalesce((value < F.lit(lower)) | (value > F.lit(upper)), F.lit(False))


def flag_outliers(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Add ``<column>_outlier``; a null value is not an outlier."""
    fences = _fences(df, columns, exact)
    return df.withColumns({f"{c}_outlier": _outside(c, fences) for c in columns})


def outlier_counts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Outliers per column, all columns in one pass."""
    fences = _fences(df, columns, exact)
    counts = df.agg(*(F.count(F.when(_outside(c, fences), 1)).alias(c) for c in columns))
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_outliers")) for c in columns]
    return counts.select(F.inline(F.array(*cells)))


def impute_group_median(
    df: DataFrame,
    columns: Sequence[str],
    group: Column,
    group_name: str = "bucket",
    repair_outliers: bool = True,
    exact: bool = True,
) -> DataFrame:
    """Replace nulls (and outliers) by the median of the row's group.

    The group column is kept. A group without any value leaves its rows unrepaired.
    """
    columns = list(columns)
    grouped = df.withColumn(group_name, group)
    small = few_groups(grouped, group_name)
    medians = (
        exact_quantiles(grouped, columns, [0.5], group_by=group_name, few=small)
        .groupBy(group_name)
        .agg(*(F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(f"_median_{c}") for c in columns))
    )
    fences = _fences(df, columns, exact) if repair_outliers else {}
    same = F.col(f"d.{group_name}").eqNullSafe(F.col(f"m.{group_name}"))
    joined = grouped.alias("d").join((F.broadcast(medians) if small else medians).alias("m"), same, "left")
    repaired = {}
    for c in columns:
        broken = F.col(f"d.{c}").isNull()
        if fences:
            broken = broken | _outside(f"d.{c}", {f"d.{c}": fences[c]})
        median = F.col(f"m._median_{c}").cast(df.schema[c].dataType)
        repaired[c] = F.when(broken, F.coalesce(median, F.col(f"d.{c}"))).otherwise(F.col(f"d.{c}"))
    kept = [repaired[c].alias(c) if c in repaired else F.col(f"d.{c}") for c in grouped.columns]
    return joined.select(*kept)
