"""Queries that return what fitted models give, against plain scoring."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fathom import domain
from fathom.operators import modeling
from fathom.plans import queries
from fathom.plans.queries import QUERIES


@pytest.mark.parametrize("name, plan", [("score_status", "forest"), ("score_grade_tree", "tree_by_frequency")])
def test_scores_are_those_of_the_model(spark, sf_dir, loans, name, plan):
    found = {r.id: r for r in QUERIES[name](spark, sf_dir).collect()}
    assert len(found) == loans.count()
    plain = modeling.keep_invalid(queries._fitted(spark, sf_dir, plan)).transform(loans.select("id", *domain.RAW_FEATURES))
    shown = plain.select("id", "prediction", F.array_max(vector_to_array("probability")).alias("most"), vector_to_array("features").alias("x"))
    for r in shown.collect():
        own = found[r.id]
        if any(v != v for v in r.x):
            assert own.prediction is None and own.max_probability is None and own.error
        else:
            assert (own.prediction, own.max_probability, own.error) == (int(r.prediction), r.most, None)


def test_importances_rules_and_responses(spark, sf_dir):
    ranked = QUERIES["status_feature_importance"](spark, sf_dir).orderBy("place").collect()
    values = [r.importance for r in ranked]
    assert len(ranked) == 20 and values == sorted(values, reverse=True) and sum(values) == pytest.approx(1)
    rules = [r.rule for r in QUERIES["grade_tree_rules"](spark, sf_dir).orderBy("line").collect()]
    leaves = sum("Predict" in r for r in rules)
    assert 2 <= leaves <= 32 and sum("If (" in r for r in rules) == leaves - 1
    means = {r.grid_value: r for r in QUERIES["partial_dependence"](spark, sf_dir).collect()}
    assert len(means) == len(domain.INCOME_EDGES) and all(r.n == r.n_scored > 0 for r in means.values())
    assert means[min(means)].mean_probability > means[max(means)].mean_probability
    answers = {r.grid_value: r.probability for r in QUERIES["feature_response"](spark, sf_dir).collect()}
    assert len(answers) == 20 and answers[21.0] > answers[9.0]


def test_search_names_settings_and_rungs(spark, sf_dir):
    rows = QUERIES["search_grade"](spark, sf_dir).collect()
    left = [len({r.setting for r in rows if r.rung == i}) for i in range(4)]
    assert left == [6, 3, 2, 1] and len(rows) == 3 * sum(left)
    assert all(0 < r.metric <= 1 for r in rows)


def test_shapley_values_of_every_row(spark, sf_dir, loans):
    values = QUERIES["tree_shapley"](spark, sf_dir)
    assert values.count() == 20 * loans.count() and values.filter("value IS NULL").count() == 0


def test_split_counts_shows_both_sides_and_what_holds_of_the_split_by_hash(spark, sf_dir, loans):
    rows = {r.side: r for r in QUERIES["split_counts"](spark, sf_dir).collect()}
    n = loans.count()
    assert rows["train"].n == loans.filter("id % 5 < 4").count() and rows["validation"].n == n - rows["train"].n
    assert all((r.n_all, r.n_neither, r.n_twice, r.is_four_fifths) == (n, 0, 0, True) for r in rows.values())
