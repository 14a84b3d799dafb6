"""A profile that is refreshed when files come and go, instead of being computed anew.

The state has a few rows for each file: for each column and pair of columns the counts, means,
centred second moments, extremes and a quantile sketch. All of these merge: a profile over any set
of files is an aggregate of their states. So a refresh reads the files that are new, a file that
went only takes its rows of the state along, and a file that was rewritten is both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.correlation import PERFECT, finite
from fathom.operators.profiling import numeric_columns
from fathom.sources.scratch import durable

_FILE = ["path", "modified", "length"]


def listed_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """path, modified, length of the Parquet files in the folders; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    return reader.load(list(folders)).select("path", F.col("modificationTime").alias("modified"), "length")


def file_states(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each file and pair of columns (a column pairs with itself), from rows with their
    file in ``path``. Every row fans out to the pairs and is combined on the map side."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = [
        F.struct(
            F.lit(a).alias("column1"), F.lit(b).alias("column2"), finite(rows, a).alias("x"), finite(rows, b).alias("y")
        )
        for a, b in pairs
    ]
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = (F.when(both, F.col(c)) for c in "xy")
    n = F.count(F.when(both, 1))
    return (
        rows.select("path", F.inline(F.array(*cells)))
        .groupBy("path", "column1", "column2")
        .agg(
            n.alias("n"),
            F.count(F.when(~both, 1)).alias("n_missing"),
            F.avg(x).alias("mean1"),
            F.avg(y).alias("mean2"),
            (F.var_pop(x) * n).alias("m11"),
            (F.var_pop(y) * n).alias("m22"),
            (F.covar_pop(x, y) * n).alias("m12"),
            F.min(x).alias("low"),
            F.max(x).alias("high"),
            F.kll_sketch_agg_double(F.when(F.col("column1") == F.col("column2"), x)).alias("sketch"),
        )
    )


def refresh(
    spark: SparkSession, folders: Sequence[str], known: DataFrame | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """The state over the files that are in the folders now, written once.

    ``known`` is the state of an earlier refresh; files it has with the same time and length are
    not read again. Columns are the numeric ones of the first files unless they are named.
    """
    files = durable(listed_files(spark, folders), "files")
    old = known.join(files, _FILE, "left_semi") if known is not None else None
    fresh = files.join(known.select(*_FILE).distinct(), _FILE, "left_anti") if known is not None else files
    paths = [r["path"] for r in fresh.select("path").orderBy("path").collect()]
    if not paths:
        return durable(old, "profile-state") if old is not None else None
    rows = spark.read.parquet(*paths)
    if columns is None:
        columns = (
            [r["column1"] for r in known.select("column1").distinct().orderBy("column1").collect()]
            if known is not None
            else sorted(numeric_columns(rows))
        )
    # A file's name as rows and as listings give it may differ in its scheme.
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    states = file_states(rows.withColumn("path", F.url_decode(name)), columns)
    plain = fresh.withColumn("plain", F.regexp_replace("path", "^file:/+", "/"))
    named = states.withColumnRenamed("path", "plain").join(F.broadcast(plain), "plain").drop("plain")
    named = named.select(*_FILE, *(c for c in states.columns if c != "path"))
    return durable(named if old is None else old.select(*named.columns).unionByName(named), "profile-state")


def _merged(state: DataFrame) -> DataFrame:
    """Counts, means and centred moments over all files of the state, for each pair."""
    pair = ["column1", "column2"]
    means = state.groupBy(*pair).agg(
        (F.sum(F.col("n") * F.col("mean1")) / F.nullif(F.sum("n"), F.lit(0))).alias("all1"),
        (F.sum(F.col("n") * F.col("mean2")) / F.nullif(F.sum("n"), F.lit(0))).alias("all2"),
    )
    off1, off2 = F.col("mean1") - F.col("all1"), F.col("mean2") - F.col("all2")
    return (
        state.join(means, pair)
        .groupBy(*pair)
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_missing").alias("n_missing"),
            F.first("all1", True).alias("mean"),
            F.sum(F.col("m11") + F.col("n") * off1 * off1).alias("m11"),
            F.sum(F.col("m22") + F.col("n") * off2 * off2).alias("m22"),
            F.sum(F.col("m12") + F.col("n") * off1 * off2).alias("m12"),
            F.min("low").alias("min_value"),
            F.max("high").alias("max_value"),
        )
    )


def described(state: DataFrame) -> DataFrame:
    """column_name, n, n_missing, mean, stddev, min_value, max_value of each column."""
    return _merged(state).filter("column1 = column2").select(
        F.col("column1").alias("column_name"),
        "n",
        "n_missing",
        "mean",
        F.sqrt(F.col("m11") / F.nullif(F.col("n") - 1, F.lit(0))).alias("stddev"),
        "min_value",
        "max_value",
    )


def correlations(state: DataFrame) -> DataFrame:
    """column1, column2, correlation of pairs below a perfect one; constant columns have none."""
    spread = F.sqrt(F.col("m11")) * F.sqrt(F.col("m22"))
    pairs = _merged(state).filter("column1 < column2").select(
        "column1", "column2", (F.col("m12") / F.nullif(spread, F.lit(0.0))).alias("correlation")
    )
    return pairs.filter(F.abs("correlation") < PERFECT)


def quantiles(state: DataFrame, shares: Sequence[float]) -> DataFrame:
    """column_name, share, value from the merged sketches; within about one percent in rank."""
    merged = (
        state.filter("column1 = column2 AND n > 0")
        .groupBy(F.col("column1").alias("column_name"))
        .agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    )
    # The function takes literal shares only.
    cells = [
        F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("value"))
        for s in shares
    ]
    return merged.select("column_name", F.inline(F.array(*cells)))
