"""Exact nearest-rank quantiles by selection.

``percentile_disc`` keeps every distinct value of a group in one task. Selection needs only
scans with small aggregates: a sketch brackets each wanted rank, rows outside the brackets are
merely counted, and only the values inside a bracket are ranked. A bracket that is still too
wide is sketched again from its own rows, until it is narrow enough.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators.ordering import running_totals

MAX_GROUPS = 10_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    group_by: str | None = None,
    accuracy: int = 10_000,
    max_candidates: int = 1_000_000,
    few: bool | None = None,
) -> DataFrame:
    """Smallest value whose cumulative share reaches each probability; nulls and NaN are left out.

    Returns ``([group_by,] column_name, p, value)``. The value is a double. A column without any
    value gives null. Runs aggregate jobs while it is built and so scans its input two to four
    times: write a costly input to a table first. ``few`` is the answer of ``few_groups`` where the
    caller knows it.
    """
    clean = {c: known(df, c) for c in columns}
    base = df.select(*([group_by] if group_by else []), *(v.alias(c) for c, v in clean.items()))
    if few is None:
        few = group_by is None or few_groups(base, group_by)
    if not few:
        return _by_full_sort(base, columns, probabilities, group_by)
    sketch = _sketch(base, columns, probabilities, group_by, accuracy)
    targets = [t for t in sketch if t["n"]]
    while True:
        wide = [t for t in targets if t["lo"] < t["hi"] and t["inside"] > max_candidates]
        if not wide or not _narrow(base, probabilities, wide, group_by, accuracy):
            break
    return _rank_candidates(base, columns, probabilities, group_by, sketch, targets)


def few_groups(df: DataFrame, group_by: str) -> bool:
    """Whether the groups are few enough for a table that is broadcast."""
    return df.select(group_by).distinct().limit(MAX_GROUPS + 1).count() <= MAX_GROUPS


def approx_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Sketch quantiles in one pass, with a rank error of at most ``1 / accuracy``."""
    wanted = F.array(*(F.lit(float(p)) for p in probabilities))
    aggs = [F.percentile_approx(known(df, c), wanted, F.lit(accuracy)).alias(c) for c in columns]
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(float(p)).alias("p"),
            F.col(f"`{c}`")[i].alias("value"),
        )
        for c in columns
        for i, p in enumerate(probabilities)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def known(df: DataFrame, column: str) -> Column:
    """The column as a double, NaN as null."""
    value = F.col(column).cast("double")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value), value)
    return value


def _rank(p: float, n: int) -> int:
    return max(1, math.ceil(Fraction(str(p)) * n))


def _sketch(base, columns, probabilities, group_by, accuracy):
    """One bracket per (group, column, probability)."""
    margin = 2.0 / accuracy
    ends = [min(1.0, max(0.0, p + side * margin)) for p in probabilities for side in (-1, 1)]
    wanted = F.array(*(F.lit(e) for e in ends))
    aggs = []
    for i, c in enumerate(columns):
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.percentile_approx(c, wanted, F.lit(accuracy)).alias(f"ends{i}"),
            F.min(c).alias(f"min{i}"),
            F.max(c).alias(f"max{i}"),
        ]
    grouped = base.groupBy(group_by) if group_by else base.groupBy()
    sketch = []
    for row in grouped.agg(*aggs).collect():
        for i, c in enumerate(columns):
            for j, p in enumerate(probabilities):
                n = row[f"n{i}"]
                target = {"group": row[group_by] if group_by else None, "column": c, "p": p, "n": n}
                if n:
                    lo, hi = row[f"ends{i}"][2 * j], row[f"ends{i}"][2 * j + 1]
                    if p - margin <= 0:
                        lo = row[f"min{i}"]
                    if p + margin >= 1:
                        hi = row[f"max{i}"]
                    share = min(1.0, 2 * margin + 2.0 / accuracy)
                    target.update(rank=_rank(p, n), lo=lo, hi=hi, inside=math.ceil(share * n))
                sketch.append(target)
    return sketch


def _long(base, columns, group_by) -> DataFrame:
    """``(grp, i, v)``: one row per known value, columns by position."""
    group = F.col(group_by) if group_by else F.lit(None).cast("int")
    cells = [F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)]
    return base.select(group.alias("grp"), F.inline(F.array(*cells))).filter(F.col("v").isNotNull())


def _narrow(base, probabilities, wide, group_by, accuracy) -> bool:
    """One pass that cuts every wide bracket into steps and keeps those around the wanted rank.

    Only brackets with very many rows come here, so there are few of them however many groups
    the table has. False once no bracket got narrower.
    """
    columns = sorted({t["column"] for t in wide})
    steps = max(2, min(1000, accuracy // 2, 1_000_000 // len(wide)))
    grid = F.array(*(F.lit(k / steps) for k in range(1, steps)))
    bounded = _with_targets(
        _long(base, columns, group_by), columns, probabilities, bool(group_by), wide, ("lo", "hi")
    )
    value, aggs = F.col("v"), []
    for j in range(len(probabilities)):
        lo, hi = F.col(f"lo{j}")[F.col("i")], F.col(f"hi{j}")[F.col("i")]
        inside = F.when(value.between(lo, hi), value)
        aggs += [
            F.count(F.when(value < lo, 1)).alias(f"below{j}"),
            F.count(inside).alias(f"n{j}"),
            F.percentile_approx(inside, grid, F.lit(accuracy)).alias(f"cuts{j}"),
        ]
    found = {(r["grp"], columns[r["i"]]): r for r in bounded.groupBy("grp", "i").agg(*aggs).collect()}
    narrower = False
    for t in wide:
        row, j = found[(t["group"], t["column"])], list(probabilities).index(t["p"])
        n = row[f"n{j}"]
        cuts = [t["lo"], *row[f"cuts{j}"], t["hi"]]
        place = (t["rank"] - row[f"below{j}"]) / n * steps
        lo, hi = cuts[max(0, math.floor(place) - 1)], cuts[min(steps, math.ceil(place) + 1)]
        narrower = narrower or (lo, hi) != (t["lo"], t["hi"])
        t.update(lo=lo, hi=hi, inside=math.ceil(min(1.0, 5 / steps) * n))
    return narrower


def _with_targets(df, columns, probabilities, grouped, targets, fields) -> DataFrame:
    """Attach ``<field><j>`` of probability ``j``: an array with one entry per column.

    Literals without a group; with one, a broadcast table of at most ``MAX_GROUPS`` rows.
    """
    by_target = {(t["group"], t["column"], t["p"]): t for t in targets}
    slots = [(f, j, p) for f in fields for j, p in enumerate(probabilities)]

    def entries(group, name, p):
        return [by_target.get((group, c, p), {}).get(name) for c in columns]

    if not grouped:
        arrays = {
            f"{f}{j}": F.array(*(F.lit(e).cast("double") for e in entries(None, f, p))) for f, j, p in slots
        }
        return df.withColumns(arrays)
    rows = [
        (g, *([None if e is None else float(e) for e in entries(g, f, p)] for f, j, p in slots))
        for g in {t["group"] for t in targets}
    ]
    kind = df.schema["grp"].dataType.simpleString()
    table = df.sparkSession.createDataFrame(
        rows, ", ".join([f"grp {kind}", *(f"{f}{j} array<double>" for f, j, _ in slots)])
    )
    return (
        df.alias("d")
        .join(F.broadcast(table).alias("t"), F.col("d.grp").eqNullSafe(F.col("t.grp")))
        .select("d.*", *(f"t.{f}{j}" for f, j, _ in slots))
    )


def _rank_candidates(base, columns, probabilities, group_by, sketch, targets):
    """Count rows per candidate value and per gap between brackets, then pick the ranks."""
    bounded = _with_targets(
        _long(base, columns, group_by), columns, probabilities, bool(group_by), targets, ("lo", "hi")
    )

    places, value = range(len(probabilities)), F.col("v")
    inside = F.lit(False)
    for j in places:
        inside = inside | F.coalesce(
            value.between(F.col(f"lo{j}")[F.col("i")], F.col(f"hi{j}")[F.col("i")]), F.lit(False)
        )
    # A value between brackets only counts toward the ranks of the next bracket up.
    ups = [F.when(F.col(f"lo{j}")[F.col("i")] > value, F.col(f"lo{j}")[F.col("i")]) for j in places]
    next_up = F.least(*ups, F.lit(None).cast("double"))
    counts = (
        bounded.select("grp", "i", "v", next_up.alias("up"), inside.alias("inside"))
        .select("grp", "i", F.when(F.col("inside"), value).otherwise(F.col("up")).alias("value"), "inside")
        .filter(F.col("value").isNotNull())
        .groupBy("grp", "i", "value", "inside")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upward = (
        Window.partitionBy("grp", "i")
        .orderBy("value", "inside")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    reached = counts.withColumn("reached", F.sum("n").over(upward))
    ranked = _with_targets(reached, columns, probabilities, bool(group_by), targets, ("rank",))
    hits = [
        F.min(F.when(F.col("reached") >= F.col(f"rank{j}")[F.col("i")], F.struct("value", "inside")))
        for j in places
    ]
    found = ranked.groupBy("grp", "i").agg(*(h.alias(f"hit{j}") for j, h in zip(places, hits)))
    quantiles = F.array(
        *(F.struct(F.lit(float(p)).alias("p"), F.col(f"hit{j}").alias("hit")) for j, p in enumerate(probabilities))
    )
    names = F.array(*(F.lit(c) for c in columns))
    checked = F.when(F.col("hit.inside"), F.col("hit.value")).otherwise(
        F.raise_error(F.lit("a quantile fell outside its bracket"))
    )
    result = found.select("grp", names[F.col("i")].alias("column_name"), F.inline(quantiles)).select(
        "grp", "column_name", "p", checked.alias("value")
    )
    empty = [(t["group"], t["column"], float(t["p"]), None) for t in sketch if not t["n"]]
    if empty:
        result = result.unionByName(base.sparkSession.createDataFrame(empty, result.schema))
    return result.withColumnRenamed("grp", group_by) if group_by else result.drop("grp")


def _by_full_sort(base, columns, probabilities, group_by):
    """Ranks from one distributed sort of the distinct values, for very many groups."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns]
    counts = (
        base.select(F.col(group_by).alias("grp"), F.inline(F.array(*cells)))
        .groupBy("grp", "column_name", "value")
        .agg(F.count("value").alias("n"))
    )
    ordered = running_totals(counts, ["column_name", "grp", "value"], {"reached": F.col("n")})
    sizes = ordered.groupBy("grp", "column_name").agg(
        F.sum("n").alias("total"), F.min(F.col("reached") - F.col("n")).alias("start")
    )
    ranks = F.array(
        *(F.struct(F.lit(float(p)).alias("p"), _rank_column(p).alias("rank")) for p in probabilities)
    )
    sizes = sizes.select("grp", "column_name", "start", F.inline(ranks))
    here = F.col("o.grp").eqNullSafe(F.col("s.grp")) & (F.col("o.column_name") == F.col("s.column_name"))
    return (
        ordered.alias("o")
        .join(sizes.alias("s"), here)
        .groupBy(F.col("s.grp").alias(group_by), "s.column_name", "s.p")
        .agg(F.min(F.when(F.col("reached") - F.col("start") >= F.col("rank"), F.col("value"))).alias("value"))
    )


def _rank_column(p: float) -> Column:
    share = Fraction(str(p))
    exact = f"({share.numerator} * total + {share.denominator - 1}) div {share.denominator}"
    return F.expr(f"greatest(1, {exact})")
