"""Table profiles: balance, missing values, descriptions, distributions, histograms, shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions.numeric import is_numeric, share_percent
from fathom.operators.quantiles import known


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def _long(cells: list[Column]) -> Column:
    """One output row per struct."""
    return F.inline(F.array(*cells))


def class_balance(df: DataFrame, label: str = "loan_status") -> DataFrame:
    """Negatives, positives and the positive share, in one pass."""
    negatives = F.count(F.when(F.col(label) == 0, 1))
    positives = F.count(F.when(F.col(label) == 1, 1))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        negatives.alias("n_rejected"),
        positives.alias("n_approved"),
    ).withColumn("approved_share", F.try_divide("n_approved", F.col("n_approved") + F.col("n_rejected")))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, all columns in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns]
    return counts.select(_long(cells))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per column, as numbers."""
    columns = list(columns or numeric_columns(df))
    measures = {"n": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*(fn(c).alias(f"{m}_{i}") for i, c in enumerate(columns) for m, fn in measures.items()))
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"n_{i}").alias("n"),
            *(F.col(f"{m}_{i}").cast("double").alias(m) for m in list(measures)[1:]),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(_long(cells))


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same summary as text, one row per measure; text columns have no mean or deviation."""
    return df.describe(*(columns or []))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Rows per value and their share of all rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percentage", share_percent(F.col("n"), total))


def mean_by(df: DataFrame, bucket: Column, name: str, target: str, mean_name: str) -> DataFrame:
    """Mean of the target per bucket, in bucket order."""
    return df.groupBy(bucket.alias(name)).agg(F.avg(target).alias(mean_name)).orderBy(name)


def share_within(
    df: DataFrame,
    keys: Sequence[str],
    target: str,
    counted: str | None = None,
    drop_null_groups: bool = False,
    method: str = "window",
    ordered: bool = True,
) -> DataFrame:
    """Rows per (keys, target) with their percentage of the rows of the same keys.

    ``counted`` names the column whose non-null values are counted (default: the target).
    ``method="window"`` suits a target with few values per group; ``"join"`` sums the groups
    separately and joins them back, so a group with very many target values is not gathered.
    ``ordered=False`` saves the sort of a result with very many groups.
    """
    keys = list(keys)
    if drop_null_groups:
        for k in keys:
            df = df.filter(F.col(k).isNotNull())
    pairs = df.groupBy(*keys, target).agg(F.count(counted or target).alias("count"))
    if method == "window":
        shares = pairs.withColumn("total_count", F.sum("count").over(Window.partitionBy(*keys)))
    elif method == "join":
        totals = pairs.groupBy(*keys).agg(F.sum("count").alias("total_count"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}"))
        shares = pairs.alias("p").join(totals.alias("t"), same).select("p.*", "t.total_count")
    else:
        raise ValueError(f"method must be 'window' or 'join', got {method!r}")
    percentage = share_percent(F.col("count"), F.col("total_count"))
    shares = shares.withColumn("percentage", percentage)
    return shares.orderBy(*keys, target) if ordered else shares


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width histogram per column, empty bins included.

    One pass finds the ranges (two numbers per column), one counts. The last bin is closed.
    Nulls, NaN and infinite values are left out; ``n_infinite`` says how many of the last there were.
    """
    columns = list(columns)
    infinite = {c: F.abs(F.col(c).cast("double")) == float("inf") for c in columns}
    values = {c: F.when(~infinite[c], known(df, c)) for c in columns}
    ends = {"lo": F.min, "hi": F.max}
    spans = df.agg(
        *(end(values[c]).alias(f"{name}{i}") for i, c in enumerate(columns) for name, end in ends.items()),
        *(F.count(F.when(infinite[c], 1)).alias(f"infinite{i}") for i, c in enumerate(columns)),
    ).first()
    cells, grid = [], []
    for i, c in enumerate(columns):
        lo, hi, value = spans[f"lo{i}"], spans[f"hi{i}"], values[c]
        if lo is None:
            continue
        width = (hi - lo) / bins
        place = F.lit(0) if width == 0 else F.least(F.floor((value - lo) / width), F.lit(bins - 1))
        place = F.when(value.isNotNull(), place).cast("int")
        cells.append(F.struct(F.lit(c).alias("column_name"), place.alias("bin")))
        out = spans[f"infinite{i}"]
        grid += [(c, b, lo + b * width, lo + (b + 1) * width, out) for b in range(bins if width else 1)]
    frame = df.sparkSession.createDataFrame(
        grid, "column_name string, bin int, bin_start double, bin_end double, n_infinite bigint"
    )
    if not cells:
        return frame.withColumn("n", F.lit(0).cast("long"))
    counts = (
        df.select(_long(cells))
        .filter(F.col("bin").isNotNull())
        .groupBy("column_name", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return frame.join(counts, ["column_name", "bin"], "left").na.fill({"n": 0})
