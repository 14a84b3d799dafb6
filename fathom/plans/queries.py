"""Every registered query: ``name -> function(spark, sf_dir)``, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import domain
from fathom.functions import codes
from fathom.functions.buckets import age_bucket, income_bucket
from fathom.operators import applications as apps
from fathom.operators import (
    calibration,
    correlation,
    dashboard,
    drift,
    encoding,
    evaluation,
    explain,
    features,
    frequent,
    modeling,
    outliers,
    profile_states,
    profiling,
    scoring,
    splitting,
    tree_paths,
)
from fathom.plans.rules import APPROVAL_RULES, RESPONSE_GRID
from fathom.sources import derived_tables as tables
from fathom.sources import readers, writers
from fathom.sources.scratch import scratch_path
from fathom.streaming import lifecycle
from fathom.streaming import scoring as streaming

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SEED = 7
OUTLIER_COLUMNS = ["person_income", "loan_amnt", "loan_percent_income"]
HISTOGRAM_COLUMNS = ["loan_amnt", "loan_int_rate", "person_age"]
DRIFT_COLUMNS = ["person_income", "loan_amnt", "loan_int_rate", "person_age"]
IMPUTED = ["person_income", "loan_int_rate", "loan_percent_income"]
STATUS_SHOWN = [*domain.STATUS_NUMERIC]
GRADE_SHOWN = [*domain.GRADE_NUMERIC, *domain.GRADE_DERIVED]
ORDINAL_SHOWN = [*domain.GRADE_ORDINAL, "actual_loan_interest", "employment_stability"]


def query(function: Query) -> Query:
    """Register a query under its name; a trailing underscore keeps clear of an import."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.loan_applications(spark, sf_dir)


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan table without its key and grade, as it is profiled."""
    return _loans(spark, sf_dir).drop("id", "loan_grade")


# --- sources and sinks ---------------------------------------------------------


@query
def scan_loans(spark, sf_dir):
    """Write the loan table as CSV and scan it back with a declared schema."""
    loans = _loans(spark, sf_dir)
    path = scratch_path(spark, "loans-csv")
    writers.write_csv(loans, path)
    return readers.read_loans(spark, path, schema=loans.schema)


@query
def table_shape(spark, sf_dir):
    return readers.table_shape(_loans(spark, sf_dir))


@query
def describe_json(spark, sf_dir):
    return writers.as_json(profiling.describe_text(_profiled(spark, sf_dir)))


@query
def describe_numeric_json(spark, sf_dir):
    return writers.as_json(describe_numeric(spark, sf_dir))


@query
def grade_distribution_json(spark, sf_dir):
    counts = _loans(spark, sf_dir).groupBy("loan_grade").agg(F.count(F.lit(1)).alias("count"))
    return writers.as_json(counts)


# --- profiling -------------------------------------------------------------------


@query
def class_balance(spark, sf_dir):
    return profiling.class_balance(_loans(spark, sf_dir))


@query
def null_profile(spark, sf_dir):
    return profiling.null_profile(tables.loan_dirty(spark, sf_dir))


@query
def approval_by_age_bucket(spark, sf_dir):
    return profiling.mean_by(
        _loans(spark, sf_dir), age_bucket(), "age_bucket", "loan_status", "average_loan_status_rate"
    )


@query
def approval_by_income_bucket(spark, sf_dir):
    """Highest approval rate first."""
    return profiling.mean_by(
        _loans(spark, sf_dir), income_bucket(), "income_bucket", "loan_status", "average_loan_status_rate"
    ).orderBy(F.col("average_loan_status_rate").desc())


@query
def pct_by_ownership(spark, sf_dir):
    return profiling.share_within(_loans(spark, sf_dir), ["person_home_ownership"], "loan_status")


@query
def pct_by_ownership_join(spark, sf_dir):
    return profiling.share_within(
        tables.loan_dirty(spark, sf_dir),
        ["person_home_ownership"],
        "loan_status",
        drop_null_groups=True,
        method="join",
    )


@query
def pct_by_intent(spark, sf_dir):
    """Nulls of the dirty table form a group of their own."""
    return profiling.share_within(tables.loan_dirty(spark, sf_dir), ["loan_intent"], "loan_status")


@query
def corr_matrix(spark, sf_dir):
    return correlation.correlation_matrix(_profiled(spark, sf_dir), digits=6)


@query
def corr_matrix_dirty(spark, sf_dir):
    return correlation.correlation_matrix(tables.loan_dirty(spark, sf_dir).drop("id"), digits=6)


@query
def corr_top_k(spark, sf_dir):
    return correlation.correlation_top(_profiled(spark, sf_dir), 10, digits=6)


@query
def corr_with_target(spark, sf_dir):
    return correlation.correlation_with(_profiled(spark, sf_dir), "loan_status", digits=6)


@query
def corr_lineitem(spark, sf_dir):
    lines = tables.driver_table(spark, sf_dir, "lineitem")
    return correlation.correlation_matrix(
        lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], digits=6
    )


@query
def quartiles(spark, sf_dir):
    return outliers.quartiles(_profiled(spark, sf_dir), profiling.numeric_columns(_profiled(spark, sf_dir)))


@query
def quartiles_lineitem(spark, sf_dir):
    lines = tables.driver_table(spark, sf_dir, "lineitem")
    return outliers.quartiles(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query
def iqr_bounds(spark, sf_dir):
    return outliers.iqr_bounds(_loans(spark, sf_dir), OUTLIER_COLUMNS)


@query
def iqr_outlier_flags(spark, sf_dir):
    return outliers.flag_outliers(_loans(spark, sf_dir).select("id", *OUTLIER_COLUMNS), OUTLIER_COLUMNS)


@query
def iqr_outlier_counts(spark, sf_dir):
    return outliers.outlier_counts(_loans(spark, sf_dir), OUTLIER_COLUMNS)


@query
def iqr_outlier_counts_events(spark, sf_dir):
    return outliers.outlier_counts(tables.driver_table(spark, sf_dir, "events"), ["value"])


@query
def impute_group_median(spark, sf_dir):
    dirty = tables.loan_dirty(spark, sf_dir).select("id", "person_age", *IMPUTED)
    return outliers.impute_group_median(dirty, IMPUTED, age_bucket(), "age_bucket")


@query
def describe_numeric(spark, sf_dir):
    described = profiling.describe_numeric(_profiled(spark, sf_dir))
    return described.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query
def grade_distribution(spark, sf_dir):
    return profiling.distribution(_loans(spark, sf_dir), "loan_grade")


@query
def feature_histogram(spark, sf_dir):
    return profiling.histogram(_loans(spark, sf_dir), HISTOGRAM_COLUMNS).select("column_name", "bin", "n")


@query
def share_of_order_priority(spark, sf_dir):
    orders = tables.driver_table(spark, sf_dir, "orders")
    return profiling.share_within(orders, ["o_orderstatus"], "o_orderpriority")


# --- features ------------------------------------------------------------------


@query
def age_bucket_(spark, sf_dir):
    return tables.loan_dirty(spark, sf_dir).select("id", "person_age", age_bucket().alias("age_bucket"))


@query
def income_bucket_(spark, sf_dir):
    return tables.loan_dirty(spark, sf_dir).select(
        "id", "person_income", income_bucket().alias("income_bucket")
    )


@query
def status_features(spark, sf_dir):
    shown = features.status_features(tables.loan_dirty(spark, sf_dir)).select("id", *STATUS_SHOWN)
    return shown


@query
def status_features_null_history(spark, sf_dir):
    made = features.status_features(_loans(spark, sf_dir), "null")
    return made.select("id", "age_to_history_length_ratio", "credit_risk")


@query
def grade_features(spark, sf_dir):
    made = features.grade_features(_loans(spark, sf_dir)).select("id", *GRADE_SHOWN)
    return made.withColumn("age_minus_history", F.round("age_minus_history", 9))


@query
def grade_features_ordinal(spark, sf_dir):
    return features.grade_features_ordinal(_loans(spark, sf_dir)).select("id", *ORDINAL_SHOWN)


@query
def status_layout(spark, sf_dir):
    """The twenty columns of the status model's vector, in order."""
    return features.layout_columns(tables.loan_dirty(spark, sf_dir), "status", "null", keep=("id",))


@query
def grade_layout(spark, sf_dir):
    """The nineteen columns of the grade model's vector, in order."""
    columns = features.layout_columns(_loans(spark, sf_dir), "grade", keep=("id",))
    return columns.withColumn("age_minus_history", F.round("age_minus_history", 9))


@query
def index_ownership(spark, sf_dir):
    return encoding.category_index(_loans(spark, sf_dir), "person_home_ownership")


@query
def index_grade(spark, sf_dir):
    return encoding.category_index(_loans(spark, sf_dir), "loan_grade", "alphabet")


def _onehot(spark, sf_dir, column):
    loans = _loans(spark, sf_dir).select("id", column)
    indexed = encoding.with_index(loans, encoding.category_index(loans, column), column)
    made = encoding.onehot_by_index(indexed, column, len(domain.KNOWN_CATEGORIES[column]) - 1)
    return made.drop(column, f"{column}_index")


@query
def onehot_ownership(spark, sf_dir):
    return _onehot(spark, sf_dir, "person_home_ownership")


@query
def onehot_intent(spark, sf_dir):
    return _onehot(spark, sf_dir, "loan_intent")


@query
def onehot_fixed(spark, sf_dir):
    rows = tables.loan_dirty(spark, sf_dir).select("id", "person_home_ownership", "loan_intent")
    return encoding.onehot_loans(rows, placeholder=True)


@query
def assemble_skip_count(spark, sf_dir):
    return features.assembled_counts(tables.loan_dirty(spark, sf_dir), "status", "null")


# --- evaluation --------------------------------------------------------------------


@query
def split_counts(spark, sf_dir):
    """Rows on each side of a split by a caller's slots, and beside them those of the split by hash:
    every row on one of its sides, four in five to learn from, within 2 % and what chance adds in a
    small table."""
    loans = _loans(spark, sf_dir).select("id")
    sides = splitting.split_counts(loans, F.col("id") % 5, 4)
    seen, held_out = splitting.split(loans, SEED)
    counts = ["n", "learned", "held"]
    parts = (loans, (1, 0, 0)), (seen, (0, 1, 0)), (held_out, (0, 0, 1))
    marked = [rows.select("id", *(F.lit(v).alias(c) for c, v in zip(counts, mark))) for rows, mark in parts]
    each = marked[0].union(marked[1]).union(marked[2]).groupBy("id").agg(*(F.sum(c).alias(c) for c in counts))
    n, both = F.sum("n"), F.col("learned") + F.col("held")
    off = F.abs(F.sum("learned") / n - 0.8)
    facts = each.agg(
        n.alias("n_all"),
        F.count(F.when(both < F.col("n"), 1)).alias("n_neither"),
        F.count(F.when(both > F.col("n"), 1)).alias("n_twice"),
        (off <= 0.02 + 1.0 / F.sqrt(n)).alias("is_four_fifths"),
    )
    # The facts are one row: both keys are 0, and the plan needs no cross join.
    sides, facts = sides.withColumn("key", F.col("n") % 1), facts.withColumn("key", F.col("n_all") % 1)
    return sides.join(F.broadcast(facts), "key").drop("key")


@query
def accuracy(spark, sf_dir):
    scored = tables.loan_scored(spark, sf_dir)
    return evaluation.accuracy(scored, "grade_label", "grade_prediction")


@query
def precision_recall(spark, sf_dir):
    return evaluation.precision_recall(tables.loan_scored(spark, sf_dir))


@query
def confusion_long(spark, sf_dir):
    return evaluation.confusion_long(tables.loan_scored(spark, sf_dir))


@query
def confusion_dense(spark, sf_dir):
    return evaluation.confusion_dense(tables.loan_scored(spark, sf_dir))


@query
def roc_curve(spark, sf_dir):
    return evaluation.roc_curve(tables.loan_scored(spark, sf_dir))


@query
def roc_curve_hard_class(spark, sf_dir):
    return evaluation.roc_curve(tables.loan_scored(spark, sf_dir), score="prediction")


@query
def roc_auc(spark, sf_dir):
    auc = evaluation.roc_auc(tables.loan_scored(spark, sf_dir))
    return auc.withColumn("auc", F.round("auc", 9))


@query
def calibrated_confidence(spark, sf_dir):
    """Every score as the rate observed for scores like it."""
    scored = tables.loan_scored(spark, sf_dir).select("id", "score", "label")
    fitted = calibration.calibrate(scored, calibration.isotonic_blocks(scored))
    return fitted.select("id", "score", F.round("confidence", 9).alias("confidence"))


@query
def calibration_error(spark, sf_dir):
    """How far the raw score is from what was observed, by tenths."""
    gaps = calibration.calibration_error(tables.loan_scored(spark, sf_dir), "score", "label")
    return gaps.withColumns({c: F.round(c, 9) for c in ("mean_confidence", "observed_rate", "gap")})


@query
def decode_predictions(spark, sf_dir):
    return tables.loan_scored(spark, sf_dir).select(
        "id",
        codes.decode_grade("grade_prediction").alias("grade"),
        codes.decode_status("prediction").alias("decision"),
    )


# --- applications and dashboards -----------------------------------------------------


@query
def validate_applications(spark, sf_dir):
    checked = apps.check_forms(tables.loan_forms(spark, sf_dir))
    return checked.withColumn("errors", F.array_join("errors", "; "))


@query
def rejected_forms(spark, sf_dir):
    """Forms with an error, with all their errors."""
    rejected = apps.rejected_forms(apps.check_forms(tables.loan_forms(spark, sf_dir)))
    return rejected.select("id", "username", F.array_join("errors", "; ").alias("errors"))


@query
def accepted_applications(spark, sf_dir):
    valid = apps.valid_forms(apps.check_forms(tables.loan_forms(spark, sf_dir)))
    accepted = features.percent_income(apps.accept(valid), "amount_requested")
    return accepted.drop("feature_importances", "submitted_at")


@query
def unscorable_applications(spark, sf_dir):
    """Applications that lack an input or a feature, with the reason."""
    dirty = tables.loan_dirty(spark, sf_dir)
    stored = dirty.select(
        *(c for c in dirty.columns if c not in ("loan_amnt", "loan_int_rate", "loan_percent_income")),
        F.col("loan_amnt").cast("double").alias("amount_requested"),
        F.col("loan_int_rate").alias("interest_rate"),
        (F.col("cb_person_default_on_file") == "Y").alias("prior_default"),
    )
    checked = scoring.model_inputs(stored).select("id", scoring.missing_features().alias("error"))
    return checked.filter("error IS NOT NULL")


@query
def pending_loans(spark, sf_dir):
    return apps.pending(tables.loan_scored(spark, sf_dir)).select("id", "username", "intent", "amount_requested")


@query
def next_pending(spark, sf_dir):
    """By a submission time with many ties, over text ids as they are stored."""
    rows = tables.loan_scored(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"),
        "username",
        "intent",
        "amount_requested",
        "status",
        F.timestamp_seconds((F.col("id") * 7919) % 1000).alias("submitted_at"),
    )
    return apps.next_pending(rows).drop("status", "submitted_at")


@query
def merge_scores(spark, sf_dir):
    """Two scores of every pending loan, the later one the opposite of the earlier."""
    scored = tables.loan_scored(spark, sf_dir)
    waiting = apps.pending(scored)
    new = waiting.select(
        "id",
        codes.decode_status("prediction").alias("status"),
        codes.decode_grade("grade_prediction").alias("loan_grade"),
        F.lit(2).alias("batch"),
    ).union(
        waiting.select(
            "id",
            codes.decode_status(1 - F.col("prediction")).alias("status"),
            codes.decode_grade(6 - F.col("grade_prediction")).alias("loan_grade"),
            F.lit(1).alias("batch"),
        )
    )
    return apps.merge_scores(
        scored.select("id", "username", "status", "loan_grade"), new, order_by="batch"
    )


@query
def merge_scores_bucketed(spark, sf_dir):
    """The merge over tables bucketed by id."""
    scored = tables.loan_scored(spark, sf_dir).select(
        "id", "username", "status", "loan_grade", "prediction", "grade_prediction"
    )
    new = apps.pending(scored).select(
        "id",
        codes.decode_status("prediction").alias("status"),
        codes.decode_grade("grade_prediction").alias("loan_grade"),
    )
    name = f"loans_{uuid.uuid4().hex}"
    sides = []
    for part, rows in (("a", scored.drop("prediction", "grade_prediction")), ("s", new)):
        sides.append(writers.write_bucketed(rows, f"{name}_{part}", scratch_path(spark, "bucketed"), "id", 16))
    return apps.merge_scores(*sides)


@query
def numeric_drift(spark, sf_dir):
    """Pending loans beside the decided ones, number by number."""
    loans = _loans(spark, sf_dir)
    new = F.col("id") % 10 == 0
    moved = drift.numeric_drift(loans.filter(~new), loans.filter(new), DRIFT_COLUMNS)
    return moved.withColumns({"distance": F.round("distance", 9), "at_value": F.round("at_value", 9)})


@query
def text_drift(spark, sf_dir):
    loans = _loans(spark, sf_dir)
    new = F.col("id") % 10 == 0
    moved = drift.text_drift(loans.filter(~new), loans.filter(new), list(domain.RAW_CATEGORICAL))
    return moved.withColumn("distance", F.round("distance", 9))


@query
def frequent_users(spark, sf_dir):
    """The users with most events, from bounded counters and one exact pass."""
    return frequent.frequent_values(tables.driver_table(spark, sf_dir, "events"), "user_id", 20)


@query
def frequent_order_keys(spark, sf_dir):
    """A column of very many values, few of them frequent."""
    return frequent.frequent_values(tables.driver_table(spark, sf_dir, "lineitem"), "l_orderkey", 20)


def _arrivals(spark, sf_dir):
    """The state of the profile after three folders of loans have come, and a fourth has come and gone."""
    rows = tables.loan_dirty(spark, sf_dir).drop("id")
    rows = tables.loan_dirty(spark, sf_dir).select((F.col("id") % 3).alias("part"), *rows.columns)
    folders = [scratch_path(spark, f"arrival-{i}") for i in range(4)]
    state = None
    for i, folder in enumerate(folders):
        rows.filter(F.col("part") == i % 3).drop("part").write.parquet(folder)
        state = profile_states.refresh(spark, folders[: i + 1], state)
    return profile_states.refresh(spark, folders[:3], state)


@query
def refreshed_profile(spark, sf_dir):
    shown = profile_states.described(_arrivals(spark, sf_dir))
    return shown.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query
def refreshed_correlations(spark, sf_dir):
    pairs = profile_states.correlations(_arrivals(spark, sf_dir))
    return pairs.withColumn("correlation", F.round("correlation", 6))


@query
def dashboard_rates(spark, sf_dir):
    return dashboard.rates(tables.loan_scored(spark, sf_dir))


@query
def dashboard_avg_amount(spark, sf_dir):
    return dashboard.average_amount(tables.loan_scored(spark, sf_dir))


@query
def dashboard_top_purpose(spark, sf_dir):
    return dashboard.top_purpose(tables.loan_scored(spark, sf_dir))


@query
def dashboard_grade_dist(spark, sf_dir):
    return dashboard.grade_distribution(tables.loan_scored(spark, sf_dir))


@query
def dashboard_purpose_dist(spark, sf_dir):
    return dashboard.purpose_distribution(tables.loan_scored(spark, sf_dir))


@query
def loan_list(spark, sf_dir):
    return dashboard.loan_list(tables.loan_scored(spark, sf_dir))


# --- models at their full settings -----------------------------------------------------
# What a fitted model gives is no number that SQL could state; the queries say what must hold of
# it, for every row or over all rows.

_MODELS: dict[tuple, modeling.PipelineModel] = {}


def _fitted(spark, sf_dir: str, plan: str) -> modeling.PipelineModel:
    """The model of a plan over the loan table, fitted once for each session and table."""
    key = (spark.sparkContext.applicationId, sf_dir, plan)
    if key not in _MODELS:
        plans = {
            "forest": lambda: modeling.status_forest(SEED),
            "logistic": modeling.status_logistic,
            "boosted": lambda: modeling.status_boosted(SEED),
            "perceptron": modeling.grade_perceptron,
            "tree": lambda: modeling.grade_tree(SEED),
            "tree_by_frequency": lambda: modeling.grade_tree(SEED, encoding="frequency"),
        }
        _MODELS[key] = modeling.train(_loans(spark, sf_dir), plans[plan]())
    return _MODELS[key]


def _scored(spark, sf_dir: str, plan: str) -> DataFrame:
    """id, prediction, the probability of the predicted class and the error of every row."""
    loans = _loans(spark, sf_dir).select("id", *domain.RAW_FEATURES)
    scored = modeling.score(modeling.spread(loans), _fitted(spark, sf_dir, plan))
    return scored.select(
        "id",
        F.col("prediction").cast("int").alias("prediction"),
        F.array_max("probabilities").alias("max_probability"),
        "error",
    )


@query
def score_status(spark, sf_dir):
    return _scored(spark, sf_dir, "forest")


@query
def score_status_lr(spark, sf_dir):
    """Also whether the probability is the sigmoid of the coefficients over the features."""
    loans = _loans(spark, sf_dir)
    model = _fitted(spark, sf_dir, "logistic")
    learned = model.stages[-1]
    weights = F.array(*(F.lit(float(w)) for w in learned.coefficients))
    terms = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
    margin = F.aggregate(terms, F.lit(float(learned.intercept)), lambda a, t: a + t)
    scored = modeling.score(loans.select("id", *domain.RAW_FEATURES), model)
    same = F.abs(F.col("probabilities")[1] - 1 / (1 + F.exp(-margin))) < 1e-9
    return scored.select("id", F.col("prediction").isin(0.0, 1.0).alias("is_class"), same.alias("is_sigmoid"))


@query
def score_status_gbt(spark, sf_dir):
    return _scored(spark, sf_dir, "boosted")


@query
def score_grade(spark, sf_dir):
    return _scored(spark, sf_dir, "perceptron")


@query
def score_grade_tree(spark, sf_dir):
    return _scored(spark, sf_dir, "tree_by_frequency")


@query
def score_status_dirty(spark, sf_dir):
    """Every row of a table with gaps, scored or with an error."""
    scored = modeling.score(modeling.spread(tables.loan_dirty(spark, sf_dir)), _fitted(spark, sf_dir, "forest"))
    return scored.select(
        "id", F.col("prediction").isNotNull().alias("is_scored"), F.col("error").isNotNull().alias("has_error")
    )


@query
def status_model_quality(spark, sf_dir):
    """Whether the status models reach the known precision and recall on the rows they learned."""
    loans = _loans(spark, sf_dir)
    found = None
    for plan in ("forest", "logistic"):
        scored = modeling.score(modeling.spread(loans), _fitted(spark, sf_dir, plan))
        bars = evaluation.precision_recall(scored, "loan_status").select(
            F.lit(plan).alias("model"),
            (F.col("precision") >= 0.8).alias("precise"),
            (F.col("recall") >= 0.6).alias("complete"),
        )
        found = bars if found is None else found.union(bars)
    return found


@query
def grade_test_error(spark, sf_dir):
    """The grade tree on the fifth it has not seen: no row lost, accuracy above a bar."""
    loans = _loans(spark, sf_dir)
    seen, held_out = splitting.split(loans, SEED)
    model = modeling.train(seen, modeling.grade_tree(SEED))
    graded = modeling.score(held_out.withColumn("grade_label", codes.encode_grade("loan_grade")), model)
    rows = graded.select(
        F.lit(True).alias("held_out"), (F.col("prediction") == F.col("grade_label")).alias("right")
    ).union(seen.select(F.lit(False), F.lit(None).cast("boolean")))
    n_held_out = F.count(F.when(F.col("held_out"), 1))
    return rows.agg(
        F.count("*").alias("n"),
        (n_held_out / F.count("*")).between(0.15, 0.25).alias("is_a_fifth"),
        (F.count(F.when(F.col("right"), 1)) / n_held_out >= 0.7).alias("is_accurate"),
    )


@query
def grade_tree_rules(spark, sf_dir):
    """The tree's text, line by line."""
    return explain.tree_rules(_fitted(spark, sf_dir, "tree"), spark)


@query
def cv_status(spark, sf_dir):
    """Every fold of the full forest, and whether its area under the curve is above a bar."""
    plan = modeling.status_forest(SEED)
    folds = modeling.cross_validate(_loans(spark, sf_dir), plan, SEED, 5, parallelism=4)[0]
    return folds.select("fold", (F.col("metric") >= 0.9).alias("is_good"))


@query
def cv_grade(spark, sf_dir):
    """The perceptron's grid of iterations and layers over three folds, and whether the accuracy is
    above a bar: 0.9, or 0.75 where fewer than 10,000 rows can be learned from."""
    plan = modeling.grade_perceptron()
    settings = modeling.grid(maxIter=[50, 100], layers=[[19, 15, 15, 7], [19, 24, 7]])
    loans = _loans(spark, sf_dir)
    bar = 0.9 if loans.count() >= 10_000 else 0.75
    folds = modeling.cross_validate(loans, plan, SEED, 3, settings, parallelism=3)[0]
    return folds.select("setting", "fold", (F.col("metric") >= bar).alias("is_good"))


@query
def search_grade(spark, sf_dir):
    """Depths of the grade tree by successive halving: every setting, rung and fold with its accuracy."""
    settings = modeling.grid(maxDepth=[1, 2, 3, 5, 7, 9])
    plan = modeling.grade_tree(SEED)
    return modeling.successive_halving(_loans(spark, sf_dir), plan, SEED, 3, settings, parallelism=3)[0]


@query
def status_feature_importance(spark, sf_dir):
    """All features by importance, strongest first."""
    return explain.feature_importance(_fitted(spark, sf_dir, "forest"), _loans(spark, sf_dir))


@query
def partial_dependence(spark, sf_dir):
    """Mean chance of approval at each income, over all rows."""
    loans = _loans(spark, sf_dir)
    incomes = [float(v) for v in domain.INCOME_EDGES]
    return explain.partial_dependence(modeling.spread(loans), _fitted(spark, sf_dir, "forest"), "person_income", incomes)


@query
def occlusion_attribution(spark, sf_dir):
    """For each column its rows, those at the typical value, and those of them with no change."""
    loans = _loans(spark, sf_dir)
    typical = explain.typical_values(loans)
    deltas = explain.occlusion_attribution(modeling.spread(loans), _fitted(spark, sf_dir, "forest"), typical)
    return deltas.groupBy("feature").agg(
        F.count("delta").alias("n"),
        F.count(F.when(F.col("was_typical"), 1)).alias("n_usual"),
        F.count(F.when(F.col("was_typical") & (F.col("delta") == 0), 1)).alias("n_usual_unchanged"),
    )


@query
def tree_shapley(spark, sf_dir):
    """Exact Shapley values of the full forest for every row and feature."""
    return tree_paths.tree_shapley(modeling.spread(_loans(spark, sf_dir), 1), _fitted(spark, sf_dir, "forest"))


@query
def tree_shapley_sums(spark, sf_dir):
    """Whether base and values of a row add up to the forest's probability."""
    sums = tree_paths.shapley_sums(modeling.spread(_loans(spark, sf_dir), 1), _fitted(spark, sf_dir, "forest"))
    far = F.abs(F.col("probability") - F.col("explained"))
    return sums.select("id", F.coalesce(far < 1e-9, F.lit(False)).alias("adds_up"))


@query
def rule_tree_shapley(spark, sf_dir):
    """Shapley values of a tree of rules, whose counts and rates come from the rows."""
    loans = _loans(spark, sf_dir)
    nodes, columns = tree_paths.rule_tree(loans, APPROVAL_RULES, "loan_status")
    values = tree_paths.shapley_of(loans, nodes, columns)
    return values.select("id", "feature", F.round("base", 9).alias("base"), F.round("value", 9).alias("value"))


@query
def rule_tree_response(spark, sf_dir):
    """The same tree's answer to the amount's share of income alone."""
    nodes, columns = tree_paths.rule_tree(_loans(spark, sf_dir), APPROVAL_RULES, "loan_status")
    answers = tree_paths.response(nodes, columns.index("loan_percent_income"), RESPONSE_GRID)
    return answers.select("grid_value", F.round("probability", 9).alias("probability"))


@query
def feature_response(spark, sf_dir):
    """The full forest's answer to each interest rate, from its nodes."""
    loans = _loans(spark, sf_dir)
    model = _fitted(spark, sf_dir, "forest")
    slot = explain.feature_names(model, loans).index(domain.SLOT_NAMES.get("loan_int_rate", "loan_int_rate"))
    return tree_paths.response(tree_paths.node_table(model, loans), slot, [float(v) for v in range(5, 25)])


def _accepted(forms):
    return apps.accept(apps.valid_forms(apps.check_forms(forms)))


@query
def score_pending(spark, sf_dir):
    """Every accepted application, whether it got a decision, and its strongest feature's presence."""
    loans = _loans(spark, sf_dir)
    status_model = _fitted(spark, sf_dir, "forest")
    scored = scoring.score_pending(
        modeling.spread(_accepted(tables.loan_forms(spark, sf_dir))),
        status_model,
        _fitted(spark, sf_dir, "perceptron"),
        explain.importances(status_model, loans),
    )
    return scored.select(
        "id",
        "username",
        F.col("status").isin("ACCEPTED", "REJECTED").alias("is_decided"),
        F.col("loan_grade").isin(domain.GRADES).alias("is_graded"),
        F.coalesce(F.size("feature_importances") == 20, F.lit(False)).alias("is_explained"),
        F.col("error").isNull().alias("is_scored"),
    )


# --- streams -----------------------------------------------------------------------------


def _application_stream(spark, sf_dir):
    """The loan table as a stream: order files as they arrive, joined with the customers."""
    schema = tables.driver_table(spark, sf_dir, "orders").schema
    orders = streaming.read_table(spark, sf_dir, "orders", schema)
    customer = tables.driver_table(spark, sf_dir, "customer")
    return tables.applications_from(spark, orders, customer)


@query
def stream_score_counts(spark, sf_dir):
    """What the stream scored beside the same forms scored as a table."""
    models = _fitted(spark, sf_dir, "forest"), _fitted(spark, sf_dir, "perceptron")
    forms = tables.forms_from(spark, _application_stream(spark, sf_dir))
    forms = forms.withColumn(streaming.ARRIVED, F.current_timestamp())
    path = streaming.run_once(streaming.append_to, streaming.scored_forms(forms, *models), "scored")
    keys = ["id", "status", "loan_grade"]
    streamed = spark.read.parquet(path).select(*keys)
    table = scoring.score_applications(modeling.spread(_accepted(tables.loan_forms(spark, sf_dir))), *models).select(*keys)
    sides = streamed.withColumn("side", F.lit(1)).union(table.withColumn("side", F.lit(-1)))
    same = sides.groupBy(*keys).agg(F.sum("side").alias("more"), F.count(F.when(F.col("side") == 1, 1)).alias("n"))
    return same.agg(F.sum("n").alias("n"), F.count(F.when(F.col("more") != 0, 1)).alias("n_different"))


@query
def stream_accepted_forms(spark, sf_dir):
    forms = tables.forms_from(spark, _application_stream(spark, sf_dir))
    forms = forms.withColumn(streaming.ARRIVED, F.current_timestamp())
    path = streaming.run_once(streaming.append_to, streaming.accepted_forms(forms), "accepted")
    return spark.read.parquet(path).drop("feature_importances", "submitted_at")


@query
def stream_dashboard_rates(spark, sf_dir):
    scored = tables.scored_from(spark, _application_stream(spark, sf_dir))
    path = streaming.run_once(streaming.update_to, streaming.running_counts(scored), "rates")
    return streaming.latest_rates(spark, path)


@query
def stream_top_purpose(spark, sf_dir):
    """The leading purposes of the running state after all loans have come."""
    scored = tables.scored_from(spark, _application_stream(spark, sf_dir))
    events = scored.select("username", "id", "intent", "status", F.current_timestamp().alias("event_time"))
    with lifecycle.rocksdb_state(spark):
        path = streaming.run_once(streaming.update_to, lifecycle.follow(events), "purposes")
    return lifecycle.latest_purposes(spark, path)


@query
def stream_merge_scores(spark, sf_dir):
    """Applications and decisions joined as they arrive; a closing row ends the wait of the others."""
    scored = tables.loan_scored(spark, sf_dir)
    # Not from the epoch on: a stream takes that as late.
    hour = F.col("id") % 500 + 24
    submitted = F.timestamp_seconds(hour * 3600).alias("submitted_at")
    decided = F.timestamp_seconds((hour + 2) * 3600).alias("decided_at")
    stored = scored.select("id", "username", "status", "loan_grade", submitted)
    made = apps.pending(scored).select(
        "id",
        codes.decode_status("prediction").alias("status"),
        codes.decode_grade("grade_prediction").alias("loan_grade"),
        decided,
    )
    closing = "timestamp_seconds(1000000000)"
    sides = [
        (stored, f"SELECT -1L AS id, '' AS username, '-' AS status, '-' AS loan_grade, {closing} AS submitted_at"),
        (made, f"SELECT -1L AS id, '-' AS status, '-' AS loan_grade, {closing} AS decided_at"),
    ]
    streams = []
    for rows, last in sides:
        folder = scratch_path(spark, "merge-stream")
        rows.unionByName(spark.sql(last)).write.parquet(folder)
        streams.append(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder))
    merged = lifecycle.merge_decisions(*streams, wait="10 days")
    path = streaming.run_once(streaming.append_to, merged, "merged")
    return spark.read.schema(merged.schema).parquet(path).filter("id >= 0").drop("submitted_at")
