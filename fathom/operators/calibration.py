"""Confidence that means something: scores turned into observed rates by isotonic regression.

The fit is the non-decreasing step function of the score closest to the labels. It is found by
pooling adjacent violators: neighbouring score blocks are joined as long as the lower one has the
higher rate. Blocks merge like sums, and pooling what was pooled before gives the same as pooling
all at once. So each task pools the blocks of a range of scores, and passes over ranges with other
borders pool across the old borders, until no neighbours violate the order. Counts stay whole
numbers, and rates are compared by cross-multiplication: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.sources.scratch import durable
from fathom.sources.shipping import ship

BLOCKS = "score_from double, score_to double, n bigint, positives bigint"
# Score blocks that one task pools.
CHUNK_BLOCKS = 200_000


def pooled(blocks: Iterator[tuple]) -> list[tuple]:
    """(from, to, n, positives) blocks in ascending order, with rates that rise from each to the next."""
    stack: list[tuple] = []
    for block in blocks:
        start, end, n, positives = block
        while stack and stack[-1][3] * n >= positives * stack[-1][2]:
            start, _, before, hits = stack.pop()
            n, positives = n + before, positives + hits
        stack.append((start, end, n, positives))
    return stack


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack = pooled(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for at in range(0, len(stack), 10_000):
        columns = list(zip(*stack[at : at + 10_000]))
        kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
        names = ["score_from", "score_to", "n", "positives"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _is_rising(blocks: DataFrame) -> bool:
    """Do rates rise over the borders of the parts that were pooled each on its own?"""
    part = F.input_file_name().alias("part")
    edges = (
        blocks.select("*", part)
        .groupBy("part")
        .agg(
            F.min_by(F.struct("score_from", "n", "positives"), "score_from").alias("first"),
            F.max_by(F.struct("score_from", "n", "positives"), "score_from").alias("last"),
        )
        .collect()
    )
    edges = sorted(edges, key=lambda e: e["first"]["score_from"])
    return all(
        a["last"]["positives"] * b["first"]["n"] < b["first"]["positives"] * a["last"]["n"]
        for a, b in zip(edges, edges[1:])
    )


def isotonic_blocks(
    df: DataFrame, score: str = "score", label: str = "label", chunk_blocks: int = CHUNK_BLOCKS
) -> DataFrame:
    """score_from, score_to, n, positives, confidence of the fit, in ascending order of score.

    Labels are 0 and 1; rows without a score (null or NaN) or a label are left out. Equal scores
    are one block. No rows give no blocks.
    """
    ship(df.sparkSession)
    # Adding zero makes one score of 0.0 and -0.0.
    value, hit = F.col(score).cast("double") + 0.0, F.col(label).cast("bigint")
    points = df.select(value.alias("score_from"), hit.alias("hit")).filter(
        F.col("score_from").isNotNull() & ~F.isnan("score_from") & F.col("hit").isNotNull()
    )
    counted = points.groupBy("score_from").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("positives"))
    blocks = durable(
        counted.select("score_from", F.col("score_from").alias("score_to"), "n", "positives"), "score-points"
    )
    size = blocks.count()
    rounds = 0
    while True:
        # One part more or less from pass to pass, so that all borders move.
        parts = -(-size // chunk_blocks) + rounds % 2 if size > chunk_blocks else 1
        ordered = blocks.repartitionByRange(parts, "score_from").sortWithinPartitions("score_from")
        blocks = durable(ordered.mapInArrow(_pool, BLOCKS), "score-blocks")
        if parts == 1 or _is_rising(blocks):
            break
        left = blocks.count()
        # A pass that joins little has its violators far apart: give each task more.
        chunk_blocks = chunk_blocks if left < 0.9 * size else 2 * chunk_blocks
        size, rounds = left, rounds + 1
    rate = F.col("positives") / F.col("n")
    return blocks.withColumn("confidence", rate).orderBy("score_from")


def calibrate(df: DataFrame, blocks: DataFrame, score: str = "score", name: str = "confidence") -> DataFrame:
    """``df`` with the rate of the block its score belongs to.

    A score between two blocks takes the lower one, a score below all blocks the first. Rows
    without a score, and all rows where there are no blocks, get null. Every row is kept. Distinct
    scores find their block in one sorted pass, so neither side needs to fit into one task.
    """
    value = (F.col(score).cast("double") + 0.0).alias("_score")
    scores = df.select(value).filter("_score IS NOT NULL AND NOT isnan(_score)").distinct()
    marks = blocks.select(F.col("score_from").alias("_score"), F.lit(0).alias("_kind"), F.col("confidence").alias("_rate"))
    asked = scores.select("_score", F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_rate"))
    placed = durable(
        marks.unionByName(asked).orderBy("_score", "_kind").withColumn("_place", F.monotonically_increasing_id()),
        "score-places",
    ).withColumn("_chunk", F.shiftright("_place", 33))
    # The last rate of every chunk goes on into the next ones; one row for each chunk.
    lasts = placed.filter("_kind = 0").groupBy("_chunk").agg(F.max_by("_rate", "_place").alias("_last"))
    chunks = placed.select("_chunk").distinct().join(lasts, "_chunk", "left")
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("_chunk", F.last("_last", True).over(before).alias("_carried"))
    lowest = F.lit((blocks.agg(F.min_by("confidence", "score_from")).first() or [None])[0]).cast("double")
    upto = Window.partitionBy("_chunk").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    known = (
        placed.join(F.broadcast(carried), "_chunk")
        .withColumn("_found", F.coalesce(F.last("_rate", True).over(upto), "_carried", lowest))
        .filter("_kind = 1")
        .select("_score", "_found")
    )
    rows = df.withColumn("_asked", F.col(score).cast("double") + 0.0)
    joined = rows.join(known, F.col("_asked") == F.col("_score"), "left")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.col("_found").alias(name))


def calibration_error(df: DataFrame, confidence: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_confidence, observed_rate, gap: how far confidence is from what was observed."""
    place = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return (
        df.filter(F.col(confidence).isNotNull() & F.col(label).isNotNull())
        .groupBy(place.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(confidence).alias("mean_confidence"),
            F.avg(F.col(label).cast("double")).alias("observed_rate"),
        )
        .withColumn("gap", F.abs(F.col("mean_confidence") - F.col("observed_rate")))
    )
