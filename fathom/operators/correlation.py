"""Pairwise correlations from one aggregate, after a pass for the means."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.profiling import numeric_columns


# A correlation this close to one is perfect but for rounding in its sums.
PERFECT = 1 - 1e-12
# Values whose squares about their own mean are this small beside those about the column's mean are equal.
SAME = 1e-12


def finite(df: DataFrame, column: str) -> Column:
    """The column as double; null, NaN and infinite values are missing."""
    value = F.col(column).cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def _pairs(df: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """One row per pair, from one aggregate of plain sums.

    A first pass finds means and whether columns have gaps. Values are then taken from their mean,
    so that sums of products lose no digits. Pairs of columns without gaps share the sums of each
    column; a pair with gaps has its own, over the rows that have both.
    """
    pairs = list(pairs)
    columns = sorted({c for pair in pairs for c in pair})
    if not pairs:
        return df.sparkSession.createDataFrame([], "column1 string, column2 string, correlation double")
    known = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(m for i, c in enumerate(columns) for m in (F.avg(finite(df, c)).alias(f"m{i}"), F.count(finite(df, c)).alias(f"n{i}"))),
    ).first()
    place = {c: i for i, c in enumerate(columns)}
    whole = {c for c in columns if known[f"n{place[c]}"] == known["rows"]}
    centred = df.select(
        *((finite(df, c) - F.lit(float(known[f"m{i}"] or 0.0))).alias(f"x{i}") for i, c in enumerate(columns))
    )
    x = [F.col(f"x{i}") for i in range(len(columns))]
    sums = {"n": F.count(F.lit(1))}
    for c in sorted(whole):
        i = place[c]
        sums |= {f"s{i}": F.sum(x[i]), f"q{i}": F.sum(x[i] * x[i])}
    cells = []
    for number, (a, b) in enumerate(pairs):
        i, j = place[a], place[b]
        sums[f"p{number}"] = F.sum(x[i] * x[j])
        if a in whole and b in whole:
            names = ("n", f"s{i}", f"s{j}", f"q{i}", f"q{j}")
        else:
            both = x[i].isNotNull() & x[j].isNotNull()
            one, two = F.when(both, x[i]), F.when(both, x[j])
            names = tuple(f"{k}{number}" for k in ("cn", "cs", "ct", "cq", "cr"))
            sums |= dict(zip(names, (F.count(F.when(both, 1)), F.sum(one), F.sum(two), F.sum(one * one), F.sum(two * two))))
        n, s, t, q, r = map(F.col, names)
        cells.append(
            F.struct(
                F.lit(a).alias("column1"),
                F.lit(b).alias("column2"),
                ((F.col(f"p{number}") - s * t / n) / F.sqrt(_spread(n, s, q) * _spread(n, t, r))).alias("correlation"),
            )
        )
    # Divisions by no rows give null.
    measured = centred.agg(*(v.alias(k) for k, v in sums.items()))
    counts = [k for k in sums if k == "n" or k.startswith("cn")]
    measured = measured.withColumns({k: F.nullif(F.col(k), F.lit(0)) for k in counts})
    return measured.select(F.inline(F.array(*cells)))


def _spread(n: Column, total: Column, squares: Column) -> Column:
    """Sum of squares about the mean; null for values that are equal but for rounding."""
    about = squares - total * total / n
    return F.when(about > SAME * squares, about)


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = None
) -> DataFrame:
    """Every pair ``column1 < column2`` below a perfect correlation, strongest first.

    A row with a null, NaN or infinite value on either side is left out of that pair; a constant
    column gives null and is dropped with the perfect pairs. ``digits`` rounds what is shown, not
    what decides.
    """
    names = sorted(columns or numeric_columns(df))
    pairs = _pairs(df, [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]])
    pairs = pairs.filter(F.abs("correlation") < PERFECT)
    if digits is not None:
        pairs = pairs.withColumn("correlation", F.round("correlation", digits))
    return pairs.orderBy(F.abs("correlation").desc(), "column1", "column2")


def correlation_top(
    df: DataFrame, k: int = 40, columns: Sequence[str] | None = None, digits: int | None = None
) -> DataFrame:
    """The ``k`` strongest pairs."""
    return correlation_matrix(df, columns, digits).limit(k)


def correlation_with(
    df: DataFrame, target: str, columns: Sequence[str] | None = None, digits: int | None = None
) -> DataFrame:
    """Signed correlation of every numeric column with the target, highest first."""
    names = [c for c in sorted(columns or numeric_columns(df)) if c != target]
    result = _pairs(df, [(c, target) for c in names]).select(
        F.col("column1").alias("column_name"), "correlation"
    )
    if digits is not None:
        result = result.withColumn("correlation", F.round("correlation", digits))
    return result.orderBy(F.col("correlation").desc_nulls_last(), "column_name")
