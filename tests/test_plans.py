"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from fathom import domain
from fathom.operators import applications as apps
from fathom.operators import evaluation, modeling, profiling, scoring
from fathom.plans.oracles import ORACLES
from fathom.plans.queries import QUERIES
from fathom.sources.scratch import durable

FITTED_OR_STREAMED = ("score", "cv", "stream")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df):
    return set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)))


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith(FITTED_OR_STREAMED)))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "PythonUDF"):
        assert bad not in text


@pytest.fixture(scope="module")
def stored_loans(loans):
    return durable(loans)


def test_only_needed_columns_are_read(stored_loans):
    assert read_columns(profiling.class_balance(stored_loans)) == {"loan_status:int"}
    shares = profiling.share_within(stored_loans, ["loan_intent"], "loan_status")
    assert read_columns(shares) == {"loan_intent:string,loan_status:int"}


def test_filters_reach_the_scan(spark, sf_dir, loans):
    forms = QUERIES["accepted_applications"](spark, sf_dir)
    stored = durable(forms)
    assert "EqualTo(status,-)" in plan(apps.pending(stored))
    assert "PushedFilters: [IsNotNull(username), EqualTo(username,u7)]" in plan(apps.loans_of(stored, "u7"))


def test_scoring_does_not_shuffle(spark, sf_dir, loans):
    status = modeling.train(loans, modeling.status_forest(1, trees=2, depth=2))
    grade = modeling.train(loans, modeling.grade_tree(1, depth=2))
    columns = [f.name for f in domain.APPLICATION_SCHEMA.fields]
    stored = durable(QUERIES["accepted_applications"](spark, sf_dir).withColumn("feature_importances", F.lit(None).cast("array<struct<feature:string,importance:double>>")).withColumn("submitted_at", F.current_timestamp()).select(columns))
    text = plan(scoring.score_pending(stored, status, grade))
    assert "Exchange" not in text and "Join" not in text and text.count("FileScan") == 1


def test_hot_groups_are_combined_before_the_shuffle(stored_loans):
    text = plan(profiling.share_within(stored_loans, ["loan_intent"], "loan_status"))
    assert text.index("partial_count") > text.index("Exchange")  # below it in the tree


def test_curve_has_no_window_over_all_scores(scored):
    text = plan(evaluation.roc_points(durable(scored)))
    windows = re.findall(r"Window \[.*?\], \[(.*?)\](?:, \[|\n)", text)
    # Windows over rows run within a slice; one without a partition may stand above totals only.
    assert windows and sum("slice" not in w for w in windows) <= 1
    for part in text.split("\n"):
        if "Window" in part and "slice" not in part.split("], [")[1 if "], [" in part else 0]:
            below = text[text.index(part) :]
            assert "HashAggregate" in below.split("FileScan")[0]
