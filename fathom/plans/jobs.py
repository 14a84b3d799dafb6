"""Batch jobs: train a model from files, score files, keep a snapshot.

Every path is an argument. A path that cannot be read raises ``ValueError`` with a message that
starts with "Error".
"""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession

from fathom import domain
from fathom.operators import modeling
from fathom.operators.applications import decided
from fathom.operators.explain import importances
from fathom.operators.modeling import ModelPlan
from fathom.operators.scoring import score_pending
from fathom.operators.splitting import split
from fathom.sources.models import load_model, save_model
from fathom.sources.readers import read_loans
from fathom.sources.writers import prediction_output


def train_status(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    model_path: str,
    seed: int,
    plan: ModelPlan | None = None,
    fmt: str = "csv",
    overwrite: bool = False,
) -> DataFrame:
    """Fit the status model on one file, save it, and return ``(id, prediction)`` for the other."""
    loans = read_loans(spark, train_path, fmt)
    applicants = read_loans(spark, test_path, fmt)
    model = modeling.train(loans, plan or modeling.status_forest(seed))
    save_model(model, model_path, overwrite)
    return prediction_output(modeling.score(applicants, model))


def train_grade(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    model_path: str,
    seed: int,
    plan: ModelPlan | None = None,
    folds: int = 3,
    fmt: str = "csv",
    overwrite: bool = False,
    parallelism: int = 1,
    **settings,
) -> tuple[DataFrame, float]:
    """Cross-validate the grade model on 80% of one file and save it.

    Returns ``(id, predicted class)`` for the other file and the accuracy on the held-out 20%.
    """
    loans = read_loans(spark, train_path, fmt)
    applicants = read_loans(spark, test_path, fmt)
    plan = plan or modeling.grade_perceptron()
    seen, held_out = split(loans, seed)
    if not settings and plan.classifier.hasParam("stepSize"):
        settings = {"maxIter": [100], "stepSize": [0.03]}
    model = modeling.tune(seen, plan, seed, folds, parallelism=parallelism, **settings).model
    save_model(model, model_path, overwrite)
    held_out = modeling.training_rows(held_out, plan)
    accuracy = modeling.grade_evaluator().evaluate(model.transform(held_out))
    return prediction_output(modeling.score(applicants, model), name="loan_grade_prediction"), accuracy


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    """The pipeline of a saved model, also when it was saved by a search."""
    model = load_model(spark, path)
    return model.bestModel if isinstance(model, CrossValidatorModel) else model


def score_snapshot(
    spark: SparkSession, applications_path: str, status_path: str, grade_path: str, target_path: str
) -> None:
    """Score the pending applications of a snapshot and write the next snapshot.

    Models are loaded once, and no row is shuffled: the scored rows are put beside the decided
    ones. The target must be a new folder; rows that could not be scored stay pending.
    """
    applications = read_loans(spark, applications_path, "parquet", domain.APPLICATION_SCHEMA)
    status_model, grade_model = load_pipeline(spark, status_path), load_pipeline(spark, grade_path)
    ranked = None
    if hasattr(status_model.stages[-1], "featureImportances"):
        ranked = importances(status_model, empty_loans(spark))
    scored = score_pending(applications, status_model, grade_model, ranked).drop("error")
    decided(applications).unionByName(scored).write.parquet(target_path)


def empty_loans(spark: SparkSession) -> DataFrame:
    """A loan table without rows, enough to resolve the feature names of a model."""
    return spark.createDataFrame([], domain.LOAN_SCHEMA)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Loan model jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("train-status", "train-grade"):
        job = jobs.add_parser(name)
        for place in ("train", "test", "model", "predictions"):
            job.add_argument(place)
        job.add_argument("--seed", type=int, required=True)
        job.add_argument("--format", default="csv")
        job.add_argument("--overwrite", action="store_true")
        if name == "train-status":
            job.add_argument("--model-kind", choices=("forest", "logistic", "boosted"), default="forest")
        else:
            job.add_argument("--folds", type=int, default=3)
            job.add_argument("--parallelism", type=int, default=1)
            job.add_argument("--max-iter", type=int, nargs="+", default=[100])
            job.add_argument("--step-size", type=float, nargs="+", default=[0.03])
    job = jobs.add_parser("score")
    for place in ("applications", "status_model", "grade_model", "target"):
        job.add_argument(place)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"fathom {given.job}").getOrCreate()
    if given.job == "score":
        score_snapshot(spark, given.applications, given.status_model, given.grade_model, given.target)
    elif given.job == "train-status":
        plan = {
            "forest": lambda: modeling.status_forest(given.seed),
            "logistic": modeling.status_logistic,
            "boosted": lambda: modeling.status_boosted(given.seed),
        }[given.model_kind]()
        output = train_status(
            spark, given.train, given.test, given.model, given.seed, plan, given.format, given.overwrite
        )
        output.write.parquet(given.predictions)
    else:
        output, accuracy = train_grade(
            spark,
            given.train,
            given.test,
            given.model,
            given.seed,
            folds=given.folds,
            fmt=given.format,
            overwrite=given.overwrite,
            parallelism=given.parallelism,
            maxIter=given.max_iter,
            stepSize=given.step_size,
        )
        output.write.parquet(given.predictions)
        print(f"accuracy {accuracy:.4f}, test error {1 - accuracy:.4f}")
