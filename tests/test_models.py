"""Pipelines, training, cross-validation, explanation and the batch jobs."""

import json

import pytest
from loan_rows import NULL_ROWS, TEST_ROWS, TRAIN_ROWS
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fathom import domain
from fathom.operators import evaluation, explain, features, modeling
from fathom.plans import jobs
from fathom.sources import models, writers
from fathom.sources.readers import loans_from_rows


@pytest.fixture(scope="module")
def forest(loans):
    return modeling.train(loans, modeling.status_forest(1, trees=10, depth=5))


@pytest.fixture(scope="module")
def tree(loans):
    return modeling.train(loans, modeling.grade_tree(1))


def same_predictions(a, b, loans):
    left = a.transform(loans).select("id", vector_to_array("probability").alias("p"))
    return left.exceptAll(b.transform(loans).select("id", vector_to_array("probability").alias("p"))).count() == 0


def test_same_seed_same_model(loans, forest):
    assert same_predictions(forest, modeling.train(loans, modeling.status_forest(1, trees=10, depth=5)), loans)
    assert not same_predictions(forest, modeling.train(loans, modeling.status_forest(2, trees=10, depth=5)), loans)


def test_status_models_learn(loans, forest):
    for model in (
        forest,
        modeling.train(loans, modeling.status_logistic(max_iter=30)),
        modeling.train(loans, modeling.status_boosted(1, rounds=5, step=0.3, depth=3)),
    ):
        predicted = modeling.predict(loans, model)
        assert predicted.count() == loans.count()
        scores = predicted.select("loan_status", F.col("probabilities")[1].alias("score"))
        assert evaluation.roc_auc(scores, "loan_status").first()["auc"] > 0.85
        best = predicted.select(F.abs(F.array_max("probabilities") - F.col("max_probability")).alias("d"))
        assert best.agg(F.max("d")).first()[0] == 0.0


def test_grade_models_learn(loans, tree):
    perceptron = modeling.train(loans, modeling.grade_perceptron(max_iter=30))
    assert perceptron.stages[-1].getLayers() == [19, 15, 15, 7]
    # The grade follows from the rate; how closely a tree can cut it depends on its depth and bins.
    fine = modeling.train(loans, modeling.ModelPlan("grade", modeling.decision_tree(1, depth=10, maxBins=512)))
    for model, floor in ((tree, 0.8), (fine, 0.97), (perceptron, 0.6)):
        graded = modeling.score(loans.withColumn("y", modeling.encode_grade("loan_grade")), model).filter("error IS NULL")
        assert evaluation.accuracy(graded, "y").first()["accuracy"] > floor


def test_ordinal_layout_trains(loans):
    model = modeling.train(loans, modeling.grade_perceptron(layout="grade_ordinal", max_iter=5))
    assert model.stages[-1].getLayers()[0] == 13


def test_perceptron_takes_the_width_of_the_data(loans):
    few = loans.filter("loan_intent IN ('MEDICAL', 'VENTURE')")
    model = modeling.train(few, modeling.grade_perceptron(max_iter=3, encoding="frequency"))
    # Four ownerships, two intents, two flags, seven numbers, three derived: unseen values have no slot set.
    assert model.stages[-1].getLayers() == [4 + 2 + 2 + 7 + 3, 15, 15, 7]
    plan = modeling.grade_perceptron(max_iter=3, encoding="frequency")
    assert modeling.cross_validate(few, plan, 1, 2)[0].count() == 2


def test_empty_history_rule_reaches_the_training(loans):
    rows = {
        rule: modeling.Pipeline(stages=modeling.feature_stages("status", zero_history=rule)).fit(loans).transform(loans).count()
        for rule in ("zero", "null")
    }
    assert rows["zero"] == loans.count()
    assert rows["null"] == loans.filter("cb_person_cred_hist_length != 0").count()


def test_defaults_are_the_full_settings():
    forest, boosted = modeling.random_forest(1), modeling.boosted_trees(1)
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (100, 10, 5)
    logistic = modeling.logistic_regression()
    assert (logistic.getMaxIter(), logistic.getRegParam()) == (100, 0.01)
    net = modeling.perceptron(13)
    assert (net.getLayers(), net.getBlockSize(), net.getSeed(), net.getMaxIter()) == ([13, 15, 15, 7], 128, 1234, 100)
    assert (net.getStepSize(), net.getTol(), net.getSolver()) == (0.03, 1e-6, "l-bfgs")
    assert (boosted.getMaxIter(), boosted.getStepSize()) == (300, 0.01)


def test_scoring_features_equal_training_features(loans, forest):
    """The vector inside the saved pipeline is the projection used everywhere else."""
    vectors = forest.transform(loans).select("id", vector_to_array("features").alias("v"))
    columns = features.layout_columns(loans, "status", keep=("id",))
    direct = columns.select("id", F.array(*(F.col(c).cast("double") for c in domain.STATUS_LAYOUT)).alias("v"))
    assert vectors.exceptAll(direct).count() == 0


def test_frequency_encoding_has_named_slots(loans):
    model = modeling.train(loans, modeling.status_forest(1, trees=3, depth=3, encoding="frequency"))
    names = explain.feature_names(model, loans)
    assert len(names) == 22 and names[0] == "person_age" and any("MEDICAL" in n for n in names)
    grade = modeling.train(loans, modeling.grade_tree(1, encoding="frequency", unseen="keep"))
    assert len(explain.feature_names(grade, loans)) > 19


def test_importances_are_named_and_sorted(loans, forest):
    rows = explain.feature_importance(forest, loans).orderBy("place").collect()
    assert len(rows) == 20 and sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert rows[0]["feature"] == "loan_percent_income"
    assert {"person_home_ownership_RENT", "loan_intent_MEDICAL"} <= {r["feature"] for r in rows}
    assert explain.feature_importance(forest, loans, 10).count() == 10


def test_tree_rules(spark, tree):
    assert "Predict" in " ".join(r["rule"] for r in explain.tree_rules(tree, spark).collect())


def test_partial_dependence_moves_with_income(loans, forest):
    rows = {r["grid_value"]: r for r in explain.partial_dependence(loans, forest, "person_income", [15000, 150000]).collect()}
    assert rows[15000.0]["mean_probability"] > rows[150000.0]["mean_probability"]
    assert {r["n"] for r in rows.values()} == {1500}


def chance(model, rows):
    return {r["id"]: r["p"][1] for r in model.transform(rows).select("id", vector_to_array("probability").alias("p")).collect()}


def test_partial_dependence_by_hand(loans, forest):
    some = loans.filter("id % 50 = 3")
    rows = explain.partial_dependence(some, forest, "loan_amnt", [500, 30000])
    for row in rows.collect():
        changed = some.withColumn("loan_amnt", F.lit(row["grid_value"]).cast("int"))
        changed = features.percent_income(changed)
        scores = chance(forest, changed)
        assert row["mean_probability"] == pytest.approx(sum(scores.values()) / len(scores))


def test_occlusion_by_hand(loans, forest):
    some, typical = loans.filter("id % 100 = 7"), explain.typical_values(loans)
    found = {(r["id"], r["feature"]): r["delta"] for r in explain.occlusion_attribution(some, forest, typical).collect()}
    base = chance(forest, some)
    for feature in ("person_income", "loan_percent_income", "loan_intent"):
        kind = some.schema[feature].dataType
        scores = chance(forest, some.withColumn(feature, F.lit(typical[feature]).cast(kind)))
        for key in base:
            assert found[(key, feature)] == pytest.approx(base[key] - scores[key])


def test_occlusion(loans, forest):
    typical = explain.typical_values(loans)
    assert typical["person_home_ownership"] == "RENT" and typical["cb_person_default_on_file"] == "N"
    some = loans.filter("id < 40")
    rows = explain.occlusion_attribution(some, forest, typical)
    assert rows.count() == some.count() * len(domain.RAW_FEATURES)
    unchanged = rows.join(some.filter(F.col("person_age") == int(typical["person_age"])), "id").filter("feature = 'person_age'")
    assert unchanged.filter("delta != 0").count() == 0


def test_cross_validation_by_key(loans):
    plan = modeling.status_forest(1, trees=3, depth=3)
    folds, best = modeling.cross_validate(loans, plan, 5, 3, modeling.grid(maxDepth=[1, 4]), parallelism=2)
    rows = folds.collect()
    assert len(rows) == 6 and {r["fold"] for r in rows} == {0, 1, 2}
    assert best == {"maxDepth": 4} and all(0.5 < r["metric"] <= 1 for r in rows)
    again, _ = modeling.cross_validate(loans.repartition(3), plan, 5, 3, modeling.grid(maxDepth=[4]))
    assert len(again.collect()) == 3


def test_tuned_model_is_stored(spark, loans, tmp_path):
    tuned = modeling.tune(loans, modeling.grade_tree(1), 3, 2, maxDepth=[1, 4])
    metrics = {json.loads(r["setting"])["maxDepth"]: r["mean_metric"] for r in modeling.tuning_metrics(tuned.metrics).collect()}
    assert metrics[4] > metrics[1] and tuned.setting == {"maxDepth": 4}
    folds, best = modeling.cross_validate(loans, modeling.grade_tree(1), 3, 2, modeling.grid(maxDepth=[1, 4]))
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, tuned.metrics.collect())) and best == tuned.setting
    models.save_model(tuned.model, str(tmp_path / "tuned"))
    assert isinstance(jobs.load_pipeline(spark, str(tmp_path / "tuned")), PipelineModel)


def test_training_does_not_depend_on_the_layout_or_settings(spark, loans):
    def importances():
        model = modeling.train(loans.repartition(7), modeling.status_forest(1, trees=10, depth=5))
        return model.stages[-1].featureImportances.toArray().tolist()

    before = importances()
    setting = "spark.sql.shuffle.partitions"
    kept = {k: spark.conf.get(k) for k in (setting, "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set(setting, "13")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # as with more cores: more splits
        assert importances() == before
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_scoring_keeps_rows_that_lack_a_feature(loans, forest):
    broken = loans.withColumn("person_age", F.when(F.col("id") % 3 != 0, F.col("person_age")))
    rows = modeling.score(broken, forest).select("id", "prediction", "error").collect()
    assert len(rows) == loans.count()
    assert all((r["prediction"] is None) == (r["error"] is not None) == (r["id"] % 3 == 0) for r in rows)


def repeated(rows, times):
    return [(n * len(rows) + i, *row[1:]) for n in range(times) for i, row in enumerate(rows)]


def test_status_job(spark, test_rows, tmp_path):
    train, test, model = (str(tmp_path / n) for n in ("train.csv", "test.csv", "model"))
    writers.write_csv(loans_from_rows(spark, TRAIN_ROWS).drop("loan_grade"), train)
    writers.write_csv(test_rows, test)
    predictions = jobs.train_status(spark, train, test, model, seed=1)
    assert predictions.count() == len(TEST_ROWS)
    loaded = models.load_model(spark, model)
    scored = loaded.transform(test_rows)
    assert scored.count() == 2 and scored.first()["features"].size == 20


def test_status_job_with_missing_values(spark, tmp_path):
    train, model = str(tmp_path / "train.csv"), str(tmp_path / "model")
    writers.write_csv(loans_from_rows(spark, [*NULL_ROWS, *TRAIN_ROWS]).drop("loan_grade"), train)
    assert jobs.train_status(spark, train, train, model, seed=1).count() == 5


def test_grade_job(spark, test_rows, tmp_path):
    train, test, model = (str(tmp_path / n) for n in ("train.csv", "test.csv", "model"))
    writers.write_csv(loans_from_rows(spark, repeated(TRAIN_ROWS, 20)).drop("loan_status"), train)
    writers.write_csv(test_rows, test)
    predictions, accuracy = jobs.train_grade(spark, train, test, model, seed=1, folds=2, maxIter=[20])
    assert predictions.count() == 2 and accuracy == 1.0
    assert isinstance(models.load_model(spark, model), PipelineModel)


@pytest.mark.parametrize("job", [jobs.train_status, jobs.train_grade])
def test_bad_paths_are_errors(spark, job):
    with pytest.raises(ValueError, match="Error"):
        job(spark, "nonexistent/path/train.csv", "nonexistent/path/test.csv", "nonexistent/path/model", seed=1)


def test_command_line(spark, test_rows, tmp_path, capsys):
    paths = {n: str(tmp_path / n) for n in ("train", "test", "status", "grade", "p1", "p2")}
    writers.write_csv(loans_from_rows(spark, repeated(TRAIN_ROWS, 10)), paths["train"])
    writers.write_csv(test_rows, paths["test"])
    jobs.main(["train-status", paths["train"], paths["test"], paths["status"], paths["p1"], "--seed", "1"])
    jobs.main(["train-grade", paths["train"], paths["test"], paths["grade"], paths["p2"], "--seed", "1"])
    assert "accuracy" in capsys.readouterr().out
    assert spark.read.parquet(paths["p1"]).columns == ["id", "loan_status_prediction", "error"]
    assert spark.read.parquet(paths["p2"]).count() == 2
    assert isinstance(jobs.load_pipeline(spark, paths["grade"]), PipelineModel)


def test_kept_node_ids_change_no_forest(loans, monkeypatch):
    plan = modeling.status_forest(7, trees=4, depth=4)
    kept = modeling.train(loans, plan).stages[-1]
    monkeypatch.setattr(modeling, "NODE_IDS_ROWS", 0)
    walked = modeling.train(loans, plan).stages[-1]
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    rules = [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in (kept, walked)]  # without the uid
    assert rules[0] == rules[1]


def test_rows_are_dealt_over_the_cores(spark, loans):
    dealt = modeling.spread(loans.coalesce(1))
    assert dealt.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert dealt.count() == loans.count()


def test_boosting_has_few_partitions(spark, loans):
    """A task's start weighs most in the many short jobs of boosting; small tables are dealt as before."""
    assert [modeling.boosting_partitions(n) for n in (0, 5000, 49_152, 900_000, 9_000_000)] == [1, 2, 12, 12, 35]
    n = loans.count()
    copies = -(-60_000 // n)
    many = spark.range(copies).crossJoin(loans.drop("id"))
    dealt = [modeling._counted_rows(many, plan, None)[0] for plan in (modeling.status_boosted(1), modeling.status_forest(1))]
    assert [rows.rdd.getNumPartitions() for rows in dealt] == [12, modeling.training_partitions(copies * n)]
    assert modeling.training_partitions(copies * n) > 12
