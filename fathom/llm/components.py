"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a grouped minimum (combined on the map side) and a join on one end of the edges.
The edges stay in Spark; the driver only compares two numbers per round. Each round is written to
shared scratch, so a lost executor costs its tasks and not the rounds before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.sources.scratch import durable


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge; ``edges`` are longs ``a``, ``b`` in any direction.

    ``root`` is the smallest node of the component. Repeated edges and loops do no harm; an empty
    table gives an empty one.
    """
    current = durable(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "edges",
    )
    state = _state(current)
    while state[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.distinct(), "large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .filter("b <> m")
            .select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
            .union(lowest.select("a", F.col("m").alias("b")))
        )
        current = durable(small.distinct(), "edges")
        state, before = _state(current), state
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
