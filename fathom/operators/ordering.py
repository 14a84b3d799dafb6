"""Exact positions and running totals over a whole ordered table.

A window without a partition key would put the whole table into one task. Here the table is
range sorted, each sort partition is summed, and the partition sums (one row per partition)
give every partition its starting offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.sources.scratch import durable


def running_totals(
    df: DataFrame, order_by: Sequence[Column | str], amounts: Mapping[str, Column]
) -> DataFrame:
    """Add one column per entry of ``amounts``: its sum over all rows up to and including this one.

    ``order_by`` must order the rows totally. The sorted rows are written once, so that the
    partition sums and the rows they are added to see the same partition borders.
    """
    place, chunk = "_place", "_chunk"
    parts = {f"_amount_{i}": expr for i, expr in enumerate(amounts.values())}
    placed = durable(
        df.withColumns(parts).orderBy(*order_by).withColumn(place, F.monotonically_increasing_id()),
        "ordered",
    ).withColumn(chunk, F.shiftright(place, 33))

    before = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(chunk)
        .agg(*(F.sum(p).alias(p) for p in parts))
        .select(chunk, *(F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"{p}_before") for p in parts))
    )
    within = Window.partitionBy(chunk).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    totals = {
        name: F.sum(p).over(within) + F.col(f"{p}_before") for name, p in zip(amounts, parts)
    }
    return (
        placed.join(F.broadcast(offsets), chunk)
        .withColumns(totals)
        .drop(place, chunk, *parts, *(f"{p}_before" for p in parts))
    )
