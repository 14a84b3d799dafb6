"""Classifier metrics as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom import domain
from fathom.functions.codes import decode_grade


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and test error over the rows that have both columns."""
    hit = F.col(label).cast("double") == F.col(prediction).cast("double")
    return df.agg(F.count(hit).alias("n"), F.avg(hit.cast("double")).alias("accuracy")).withColumn(
        "test_error", F.lit(1.0) - F.col("accuracy")
    )


def precision_recall(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The four cells of a binary outcome with precision, recall and F1; null where undefined."""
    actual, called = F.col(label) == 1, F.col(prediction) == 1
    denied, passed = F.col(label) == 0, F.col(prediction) == 0
    cells = df.agg(
        F.count(F.when(actual & called, 1)).alias("tp"),
        F.count(F.when(denied & called, 1)).alias("fp"),
        F.count(F.when(actual & passed, 1)).alias("fn"),
        F.count(F.when(denied & passed, 1)).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.withColumns(
        {
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
    )


def confusion_long(
    df: DataFrame, label: str = "grade_label", prediction: str = "grade_prediction"
) -> DataFrame:
    """Rows per (actual, predicted) grade letter, only the pairs that occur."""
    # Counting by code first keeps the decoding off the rows.
    codes = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    return (
        codes.groupBy(decode_grade(label).alias("actual"), decode_grade(prediction).alias("predicted"))
        .agg(F.sum("n").alias("n"))
        .orderBy("actual", "predicted")
    )


def confusion_dense(
    df: DataFrame,
    label: str = "grade_label",
    prediction: str = "grade_prediction",
    labels: Sequence[str] = tuple(domain.GRADES),
) -> DataFrame:
    """One row per actual label, one column per predicted label, zero where nothing fell.

    ``labels`` are the names of the class codes 0, 1, 2 and so on. Any other code, and null, counts
    in the row and column ``other``, so that all cells together are all rows.
    """
    names = [*labels, "other"]

    def place(code: str) -> Column:
        listed = F.col(code).isin([float(i) for i in range(len(labels))])
        return F.when(listed, F.col(code).cast("int")).otherwise(len(labels))

    codes = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    placed = codes.select(place(label).alias("i"), place(prediction).alias("j"), "n")
    cells = {
        (i, j): F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("n")))
        for i in range(len(names))
        for j in range(len(names))
    }
    wide = placed.agg(*(F.coalesce(total, F.lit(0)).alias(f"n{i}_{j}") for (i, j), total in cells.items()))
    rows = [
        F.struct(
            F.lit(name).alias("actual"),
            *(F.col(f"n{i}_{j}").alias(f"predicted_{other}") for j, other in enumerate(names)),
        )
        for i, name in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


def roc_points(
    df: DataFrame, label: str = "label", score: str = "score", slices: int | None = None
) -> DataFrame:
    """Rows per distinct score with the positives and negatives at or above it.

    The distinct scores are cut into slices of similar size; each slice is accumulated on its
    own and shifted by the totals of the slices above, so no task holds all scores. There are at
    least as many slices as shuffle partitions, unless told otherwise.
    """
    slices = slices or max(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = F.col(score).cast("double")
    known = df.filter(value.isNotNull() & ~F.isnan(value) & F.col(label).isNotNull())
    per_score = known.groupBy(value.alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("positives"),
        F.count(F.when(F.col(label) != 1, 1)).alias("negatives"),
    )
    wanted = [i / slices for i in range(1, slices)]
    cuts = known.select(value.alias("score")).approxQuantile("score", wanted, 0.2 / slices)
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(edges) == 2:
        edges.insert(1, 0.0)
    sliced = Bucketizer(splits=edges, inputCol="score", outputCol="slice").transform(per_score)
    above = Window.orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = sliced.groupBy("slice").agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    offsets = offsets.select(
        "slice",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"),
        F.sum("p").over(everything).alias("p_total"),
        F.sum("n").over(everything).alias("n_total"),
    )
    down = Window.partitionBy("slice").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return sliced.join(F.broadcast(offsets), "slice").select(
        "score",
        "positives",
        "negatives",
        (F.sum("positives").over(down) + F.col("p_above")).alias("tp"),
        (F.sum("negatives").over(down) + F.col("n_above")).alias("fp"),
        "p_total",
        "n_total",
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``(threshold, fpr, tpr)`` per distinct score, with the origin as the point without threshold."""
    points = roc_points(df, label, score).select(
        F.col("score").alias("threshold"),
        F.try_divide("fp", "n_total").alias("fpr"),
        F.try_divide("tp", "p_total").alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(points)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the curve by trapezoids; tied scores count half."""
    points = roc_points(df, label, score)
    area = F.sum(F.col("negatives") * (F.col("tp") - F.col("positives") / F.lit(2.0)))
    space = F.max(F.col("p_total") * F.col("n_total")).cast("double")
    return points.agg(F.try_divide(area, space).alias("auc"))
