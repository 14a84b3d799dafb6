"""Mixing sources to target weights by capped water-filling.

Sources share a budget in proportion to their weights, but no source gives more than its size
times the most epochs. What a capped source cannot give is shared among the others by weight, and
again, until no share is above its cap. Each source then takes its documents whole as often as the
target allows, and a fraction once more: documents follow one another in the order of a seeded
hash until the target's words are reached, the last one in part.

No source is brought into one task. The place in hash order where a source stops is found on sums
per hash range, and only the documents of that one range, about the square root of the table, are
ordered. Sources, one row each, stay in Spark; a round of water-filling is one small aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fathom.llm.common import plain_names
from fathom.operators.ordering import running_totals
from fathom.sources.scratch import durable

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"
# A source's documents are joined to its row in this many parts, so that a hot source is no one key.
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _hash(seed: int) -> Column:
    """Hex digits that order documents by chance, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


def water_fill(sources: DataFrame, total: float, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (weight, size, …) with ``target``: shares of ``total`` by weight, none above its cap.

    If all caps together are below ``total``, every source is at its cap. Each round sends two
    sums to the driver. A cap once exceeded stays exceeded, so rounds end after one per source at
    most; a few in practice.
    """
    cap = F.col("size") * max_epochs
    weight = F.col("weight").cast("double")
    level, capped = 0.0, -1
    while True:
        above = cap < weight * level
        row = sources.agg(
            F.sum(F.when(above, cap).otherwise(0)).alias("caps"),
            F.sum(F.when(above, 0.0).otherwise(weight)).alias("weights"),
            F.count(F.when(above, 1)).alias("capped"),
        ).first()
        if row["capped"] == capped:
            break
        capped = row["capped"]
        if not row["weights"]:
            level = math.inf
            break
        level = (total - row["caps"]) / row["weights"]
    share = weight * level if math.isfinite(level) else cap.cast("double")
    return sources.withColumn("target", F.least(cap.cast("double"), share))


def source_table(sized: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """One row per source: place by code point (null last), weight, size, docs, target."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    placed = running_totals(sums, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("bigint")})
    chosen = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")
    )
    placed = durable(placed.withColumn("weight", chosen), "sources")
    total = placed.agg(F.sum("size")).first()[0] or 0
    return durable(water_fill(placed, float(total), max_epochs), "targets")


def _plan(docs: DataFrame, weights: Sequence[float], max_epochs: int, seed: int, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (and the columns ``also``) for every row."""
    order = "_order"
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), _hash(seed).alias(order), *also
    )
    sized = durable(sized, "sizes")
    sources = source_table(sized, weights, max_epochs)

    ranges = max(1, math.isqrt(sized.count()))
    # The first 12 hex digits as a fraction of one, times the number of ranges.
    place = F.floor(F.conv(F.substring(order, 1, 12), 16, 10).cast("double") / float(1 << 48) * ranges)
    sized = sized.withColumn("_range", place.cast("bigint"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = F.floor(F.col("target") + 0.5).cast("bigint") - F.col("whole") * F.col("source_size")
    known = (
        sources.select("source", F.col("size").alias("source_size"), "target")
        .withColumn("whole", whole.cast("bigint"))
        .withColumn("wanted", wanted)
    )

    by_range = sized.groupBy("source", "_range").agg(F.sum("size").alias("words"))
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("_range"))
    short = F.col("so_far") <= F.col("wanted")
    cut = (
        by_range.withColumn("so_far", so_far)
        .join(known.select(F.col("source").alias("_s"), "wanted"), F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("source")
        .agg(
            F.min(F.when(~short, F.col("_range"))).alias("cut"),
            F.coalesce(F.max(F.when(short, F.col("so_far"))), F.lit(0)).alias("before"),
        )
    )
    known = known.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    known = durable(known, "plan").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = known.withColumnRenamed("source", "_s")
    salt = F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int")
    planned = (
        sized.withColumn("_doc_salt", salt)
        .join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_doc_salt") == F.col("_salt")))
        .drop("_s", "_salt", "_doc_salt")
    )
    planned = durable(planned, "planned")

    full = F.col("cut").isNull() | (F.col("_range") < F.col("cut"))
    clear = planned.filter(F.col("cut").isNull() | (F.col("_range") != F.col("cut"))).withColumn(
        "extra", F.when(full, F.col("size")).otherwise(0).cast("bigint")
    )
    in_order = Window.partitionBy("source").orderBy(order, "doc_id", "size", *also).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("wanted") - F.col("before") - F.coalesce(F.sum("size").over(in_order), F.lit(0))
    border = planned.filter(F.col("_range") == F.col("cut")).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("bigint")
    )
    taken = F.col("whole") * F.col("size") + F.col("extra")
    return clear.unionByName(border).select(
        "doc_id", "source", "size", "source_size", "target", "whole", "extra", taken.alias("taken"), *also
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    Size is the number of words; a null text has none. A null source is a source of its own, the
    last one. A source without words has target 0 and takes nothing. Rows that repeat a doc_id are
    rows of their own with neighbouring places in the hash order. Every source takes its target
    rounded to whole words, and no document more than ``max_epochs`` times its size. An empty
    table gives no rows.
    """
    return _plan(docs, weights, max_epochs, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: rows repeated as often as the mix takes them.

    A repetition that is taken in part has the first words of the text, up to its last taken word;
    ``n_chars``, where present, is the length of what is taken. Documents without words are left
    out where their source is taken less than once, else repeated as often as it is taken whole.
    """
    own = plain_names(docs, "doc_id", "source", "text", "n_chars")
    numbered = durable(own.withColumn("_row", F.monotonically_increasing_id()), "to-mix")
    plan = _plan(numbered, weights, max_epochs, seed, also=["_row"]).select("_row", "size", "whole", "extra")
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    times = (F.col("whole") + (F.col("extra") > 0).cast("bigint")).cast("int")
    rows = (
        numbered.join(plan.filter(times > 0), "_row")
        .withColumn("_time", F.explode(F.sequence(F.lit(1), times)))
        .withColumn("_part", part & (F.col("_time") > F.col("whole")))
    )
    # Each word with the white space before it; the first ones joined are the text up to there.
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.col("extra").cast("int")), "")
    text = F.when(F.col("_part"), head).otherwise(F.col("text"))
    out = {"text": text}
    if "n_chars" in own.columns:
        kind = own.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("_part"), F.char_length(head)).otherwise(F.col("n_chars")).cast(kind)
    return rows.withColumns(out).select(*own.columns).toDF(*docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('11:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM sums),
filled AS (
  SELECT *, 3 * source_size / w AS full_at,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps,
    sum(w) OVER (ORDER BY 3 * source_size / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighed),
level AS (
  SELECT arg_min(((SELECT sum(source_size)::DOUBLE FROM sums) - caps) / weights, full_at) AS level
  FROM filled WHERE full_at >= ((SELECT sum(source_size)::DOUBLE FROM sums) - caps) / weights),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, w * (SELECT level FROM level)) AS target FROM weighed),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, w.source_size, w.target, w.whole,
    floor(w.target + 0.5)::BIGINT - w.whole * w.source_size AS extra,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken
FROM placed
"""
