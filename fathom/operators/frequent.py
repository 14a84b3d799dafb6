"""The most frequent values of columns with any number of values.

Every task keeps a bounded number of counters: where they run over, all are lowered by the largest
count that leaves enough of them, and what was taken away is remembered as the task's error. Such
counters of tasks add up: a value's true count is its sum, plus at most the sum of the errors. Few
candidates can be among the first k by these bounds; one more pass counts them exactly. Where the
bounds do not prove the answer (values that are all about as frequent), all values are counted
instead, so the answer is exact in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.sources.scratch import durable
from fathom.sources.shipping import ship

# Counters of a task for each value asked for.
COUNTERS_PER_VALUE = 64
MOST_CANDIDATES = 100_000


class Counters:
    """Counts of at most ``most`` values; any value's count is short by ``error`` at most."""

    def __init__(self, most: int):
        self.most, self.counts, self.error = most, {}, 0

    def add(self, values: list, counts: list[int]) -> None:
        held = self.counts
        for value, n in zip(values, counts):
            held[value] = held.get(value, 0) + n
        if len(held) > self.most:
            ranked = sorted(held.values(), reverse=True)
            cut = ranked[self.most]
            self.error += cut
            self.counts = {v: n - cut for v, n in held.items() if n > cut}


def _summaries(most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(most)
        for batch in batches:
            # A batch's values are added part by part: the dictionary never holds many more than ``most``.
            counted = pc.value_counts(batch.column(0))
            for at in range(0, len(counted), most):
                part = counted[at : at + most]
                counters.add(part.field("values").to_pylist(), part.field("counts").to_pylist())
        rows = [*counters.counts.items()]
        values = pa.array([v for v, _ in rows] + [None], pa.string())
        counts = pa.array([n for _, n in rows] + [0], pa.int64())
        errors = pa.array([0] * len(rows) + [counters.error], pa.int64())
        yield pa.RecordBatch.from_arrays([values, counts, errors], names=["value", "n", "error"])

    return work


def frequent_bounds(df: DataFrame, column: str, counters: int) -> tuple[DataFrame, int]:
    """(value, at_least) of the values that any task kept, and the most that any count is short by.

    Nulls are left out; values are compared as text.
    """
    ship(df.sparkSession)
    values = df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL")
    kept = durable(values.mapInArrow(_summaries(counters), "value string, n bigint, error bigint"), "counters")
    error = kept.agg(F.sum("error")).first()[0] or 0
    return kept.filter("value IS NOT NULL").groupBy("value").agg(F.sum("n").alias("at_least")), error


def frequent_values(df: DataFrame, column: str, k: int, counters: int | None = None) -> DataFrame:
    """place, value, n of the ``k`` most frequent values of a column, ties by value.

    Fewer distinct values give fewer rows; nulls are no value. Values are compared and given as
    text. ``counters`` bounds the memory of a task, ``COUNTERS_PER_VALUE`` for each value by default.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    counters = max(k + 1, counters or k * COUNTERS_PER_VALUE)
    values = df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL")
    bounds, error = frequent_bounds(df, column, counters)
    order = (F.desc("n"), F.asc("value"))
    lows = [r["at_least"] for r in bounds.orderBy(F.desc("at_least")).limit(k).collect()]
    # A value below this cannot be among the first k.
    least = lows[-1] - error if len(lows) == k else 0
    candidates = durable(bounds.filter(F.col("at_least") >= least).select("value"), "candidates")
    found = None
    if (error == 0 or len(lows) == k) and candidates.count() <= MOST_CANDIDATES:
        counted = values.join(F.broadcast(candidates), "value").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        rows = counted.orderBy(*order).limit(k).collect()
        # A value that no task kept has at most ``error`` occurrences.
        if error == 0 or rows[-1]["n"] > error:
            found = [(i, r["value"], r["n"]) for i, r in enumerate(rows, 1)]
    if found is None:
        counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        found = [(i, r["value"], r["n"]) for i, r in enumerate(counted.orderBy(*order).limit(k).collect(), 1)]
    return df.sparkSession.createDataFrame(found, "place int, value string, n bigint")


def with_frequent_or_other(df: DataFrame, column: str, frequent: DataFrame, other: str = "OTHER VALUE") -> DataFrame:
    """``df`` with the column's rare values as one value, ready for an index of bounded length."""
    listed = [r["value"] for r in frequent.select("value").collect()]
    text = F.col(column).cast("string")
    return df.withColumn(column, F.when(text.isin(listed), text).otherwise(F.when(text.isNotNull(), F.lit(other))))
