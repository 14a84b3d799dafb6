"""Metrics against Spark ML's evaluators and by hand."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

from fathom.operators import evaluation


def test_area_agrees_with_spark(scored):
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(scored)
    assert evaluation.roc_auc(scored).first()["auc"] == pytest.approx(theirs)


@pytest.mark.parametrize("slices", [2, 7, 200])
def test_curve_does_not_depend_on_slices(scored, slices):
    points = {r["score"]: (r["tp"], r["fp"]) for r in evaluation.roc_points(scored, slices=slices).collect()}
    rows = [(r["score"], r["label"]) for r in scored.select("score", "label").collect()]
    for cut in list(points)[::9]:
        above = [label for score, label in rows if score >= cut]
        assert points[cut] == (sum(above), len(above) - sum(above))


def test_curve_with_one_hot_score(spark):
    rows = [(0.5, i % 2) for i in range(300)] + [(0.9, 1), (0.1, 0), (None, 1), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    curve = [(r["threshold"], r["fpr"], r["tpr"]) for r in evaluation.roc_curve(df).orderBy("tpr", "fpr").collect()]
    assert curve[0] == (None, 0.0, 0.0) and curve[-1] == (0.1, 1.0, 1.0)
    assert curve[1] == (0.9, 0.0, pytest.approx(1 / 151))
    assert len(curve) == 4


def test_curve_of_one_class_has_no_rate(spark):
    df = spark.createDataFrame([(0.2, 1), (0.4, 1)], "score double, label int")
    assert {r["fpr"] for r in evaluation.roc_curve(df).filter("threshold IS NOT NULL").collect()} == {None}
    assert evaluation.roc_auc(df).first()["auc"] is None


def test_accuracy_agrees_with_spark(scored):
    theirs = MulticlassClassificationEvaluator(
        labelCol="grade_label", predictionCol="grade_prediction", metricName="accuracy"
    ).evaluate(scored)
    row = evaluation.accuracy(scored, "grade_label", "grade_prediction").first()
    assert row["accuracy"] == pytest.approx(theirs)
    assert row["test_error"] == pytest.approx(1 - theirs)


def test_precision_without_positives_is_null(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0)], "label int, prediction double")
    row = evaluation.precision_recall(df).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (0, 0, 0, 2)
    assert (row["precision"], row["recall"], row["f1"]) == (None, None, None)


def test_confusion_keeps_all_seven_grades_apart(spark):
    df = spark.createDataFrame([(5.0, 6.0), (6.0, 6.0), (6.0, 6.0)], "grade_label double, grade_prediction double")
    assert [tuple(r) for r in evaluation.confusion_long(df).collect()] == [("F", "G", 1), ("G", "G", 2)]
    dense = {r["actual"]: r for r in evaluation.confusion_dense(df).collect()}
    assert list(dense) == [*"ABCDEFG", "other"]
    assert dense["F"]["predicted_G"] == 1 and dense["G"]["predicted_G"] == 2
    assert sum(dense[a][f"predicted_{p}"] for a in "ABCDEFG" for p in "ABCDEFG") == 3


def test_confusion_counts_every_row(spark):
    rows = [(1.0, 1.0), (9.0, 1.0), (None, 2.0), (2.0, None), (None, None)]
    df = spark.createDataFrame(rows, "grade_label double, grade_prediction double")
    dense = {r["actual"]: r for r in evaluation.confusion_dense(df).collect()}
    assert sum(v for r in dense.values() for k, v in r.asDict().items() if k != "actual") == len(rows)
    assert dense["other"]["predicted_B"] == 1 and dense["C"]["predicted_other"] == 1
