"""How far the rows to be scored have moved from the rows a model learned.

Numbers are compared by the two-sample Kolmogorov-Smirnov distance: the largest gap between the two
cumulative shares. Both samples of all columns are counted by value, sorted once by column and
value, and summed up from sort partition to sort partition, so that neither a column nor a hot
value is one task's work. Texts are compared by total variation: half the sum of the gaps between
the shares of their values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.correlation import finite
from fathom.operators.ordering import running_totals

# Distances above this multiple of sqrt((n + m) / (n m)) are less likely than 1 in 1,000 by chance.
CRITICAL = 1.95


def _melted(df: DataFrame, columns: Sequence[str], side: str, numeric: bool) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("feature"), (finite(df, c) + 0.0 if numeric else F.col(c).cast("string")).alias("value"))
        for c in columns
    ]
    sides = [F.lit(int(side == s)).cast("bigint").alias(s) for s in ("reference", "current")]
    return df.select(F.inline(F.array(*cells)), *sides)


def _counted(reference: DataFrame, current: DataFrame, columns: Sequence[str], numeric: bool) -> DataFrame:
    both = _melted(reference, columns, "reference", numeric).unionByName(_melted(current, columns, "current", numeric))
    counted = both.groupBy("feature", "value").agg(
        F.sum("reference").alias("reference"), F.sum("current").alias("current")
    )
    return counted.filter("value IS NOT NULL") if numeric else counted


def numeric_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n_reference, n_current, distance, at_value, drifted for each numeric column.

    ``at_value`` is the smallest value at which the gap is largest. Null, NaN and infinite values
    are left out and counted by the profile instead. A column without values on one side has no
    distance. ``drifted`` says that the distance is beyond chance (``CRITICAL``).
    """
    counted = _counted(reference, current, columns, True)
    sums = running_totals(
        counted, ["feature", "value"], {"so_far_reference": F.col("reference"), "so_far_current": F.col("current")}
    )
    # Totals run on from one column to the next: each column starts at its least total.
    ends = sums.groupBy("feature").agg(
        *(F.sum(s).alias(f"n_{s}") for s in ("reference", "current")),
        *(F.max(f"so_far_{s}").alias(f"end_{s}") for s in ("reference", "current")),
    )
    share = {
        s: (F.col(f"so_far_{s}") - F.col(f"end_{s}") + F.col(f"n_{s}")) / F.nullif(F.col(f"n_{s}"), F.lit(0))
        for s in ("reference", "current")
    }
    gaps = sums.join(F.broadcast(ends), "feature").withColumn("gap", F.abs(share["reference"] - share["current"]))
    widest = gaps.groupBy("feature", "n_reference", "n_current").agg(
        F.max("gap").alias("distance"),
        # Widest gap first, then the smaller value.
        F.min(F.struct((-F.col("gap")).alias("by"), F.col("value"))).alias("at"),
    )
    bound = CRITICAL * F.sqrt(
        (F.col("n_reference") + F.col("n_current")) / (F.col("n_reference").cast("double") * F.col("n_current"))
    )
    return widest.select(
        "feature",
        "n_reference",
        "n_current",
        "distance",
        F.when(F.col("distance").isNotNull(), F.col("at")["value"]).alias("at_value"),
        F.when(F.col("distance").isNotNull(), F.col("distance") > bound).alias("drifted"),
    )


def text_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n_reference, n_current, distance, n_unseen for each text column.

    Null is a value of its own. ``n_unseen`` counts current rows with a value the reference lacks,
    which a fitted index does not know.
    """
    counted = _counted(reference, current, columns, False)
    totals = counted.groupBy("feature").agg(
        F.sum("reference").alias("n_reference"), F.sum("current").alias("n_current")
    )
    share = {s: F.col(s) / F.nullif(F.col(f"n_{s}"), F.lit(0)) for s in ("reference", "current")}
    return (
        counted.join(F.broadcast(totals), "feature")
        .groupBy("feature", "n_reference", "n_current")
        .agg(
            (F.sum(F.abs(share["reference"] - share["current"])) / 2).alias("distance"),
            F.sum(F.when(F.col("reference") == 0, F.col("current")).otherwise(0)).alias("n_unseen"),
        )
    )
