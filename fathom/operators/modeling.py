"""Pipelines from raw loan columns to a prediction, training and cross-validation."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom import domain
from fathom.functions import derived
from fathom.functions.codes import encode_grade
from fathom.operators import forests
from fathom.operators.splitting import key_slot, with_fold
from fathom.sources.scratch import durable

STATUS_LABEL, GRADE_LABEL = "loan_status", "grade_label"


# --- features ----------------------------------------------------------------


def _derive(expressions: Mapping[str, str]) -> SQLTransformer:
    added = ", ".join(f"{text} AS {name}" for name, text in expressions.items())
    return SQLTransformer(statement=f"SELECT *, {added} FROM __THIS__")


def feature_stages(
    layout: str,
    encoding: str = "lists",
    handle_invalid: str = "skip",
    zero_history: str = "zero",
    scale: bool = False,
    unseen: str = "keep",
) -> list:
    """Stages from raw loan columns to the ``features`` vector.

    ``encoding="lists"`` uses the fixed category lists. ``encoding="frequency"`` indexes the
    listed categories by frequency in the training rows and one-hot encodes the index; ``unseen``
    says what a category not met in training does when scoring. Other values and nulls, of which
    free text may have any number, share the category ``OTHER VALUE``: the index kept by the driver
    is as long as the lists.
    """
    columns, expressions = derived.layout_expressions(layout, zero_history)
    stages = []
    if encoding == "frequency":
        slots = {*domain.OWNERSHIP_SLOTS, *domain.INTENT_SLOTS, "no_default_on_file"}
        expressions = {n: t for n, t in expressions.items() if n not in slots}
        coded = domain.RAW_CATEGORICAL if layout == "grade" else domain.RAW_CATEGORICAL[:2]
        vectors = [f"{c}_vec" for c in coded]
        numbers = [c for c in columns if c not in slots]
        columns = vectors + numbers if layout == "grade" else numbers + vectors
        indices = [f"{c}_index" for c in coded]
        listed = [f"{c}_listed" for c in coded]
        for c, name in zip(coded, listed):
            values = ", ".join(f"'{v}'" for v in domain.KNOWN_CATEGORIES[c])
            expressions[name] = f"CASE WHEN {c} IN ({values}) THEN {c} ELSE 'OTHER VALUE' END"
        stages = [
            StringIndexer(inputCols=listed, outputCols=indices, handleInvalid=unseen),
            OneHotEncoder(inputCols=indices, outputCols=vectors),
        ]
    elif encoding != "lists":
        raise ValueError(f"encoding must be 'lists' or 'frequency', got {encoding!r}")
    target = "unscaled_features" if scale else "features"
    stages = [
        _derive(expressions),
        *stages,
        VectorAssembler(inputCols=columns, outputCol=target, handleInvalid=handle_invalid),
    ]
    if scale:
        stages.append(StandardScaler(inputCol=target, outputCol="features", withMean=True, withStd=True))
    return stages


def feature_count(layout: str) -> int:
    return len(derived.layout_expressions(layout)[0])


# --- classifiers -------------------------------------------------------------


def random_forest(seed: int, trees: int = 100, depth: int = 10, min_rows: int = 5, **more):
    return RandomForestClassifier(
        labelCol=STATUS_LABEL,
        featuresCol="features",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_rows,
        seed=seed,
        **more,
    )


def logistic_regression(max_iter: int = 100, reg: float = 0.01, **more):
    return LogisticRegression(
        labelCol=STATUS_LABEL, featuresCol="features", maxIter=max_iter, regParam=reg, **more
    )


def boosted_trees(seed: int, rounds: int = 300, step: float = 0.01, **more):
    return GBTClassifier(
        labelCol=STATUS_LABEL, featuresCol="features", maxIter=rounds, stepSize=step, seed=seed, **more
    )


def perceptron(
    inputs: int,
    seed: int = 1234,
    hidden: Sequence[int] = (15, 15),
    max_iter: int = 100,
    block: int = 128,
    tol: float = 1e-6,
    step: float = 0.03,
):
    return MultilayerPerceptronClassifier(
        labelCol=GRADE_LABEL,
        featuresCol="features",
        layers=[inputs, *hidden, len(domain.GRADES)],
        blockSize=block,
        seed=seed,
        solver="l-bfgs",
        tol=tol,
        stepSize=step,
        maxIter=max_iter,
    )


def decision_tree(seed: int, depth: int = 5, **more):
    return DecisionTreeClassifier(
        labelCol=GRADE_LABEL, featuresCol="features", maxDepth=depth, seed=seed, **more
    )


# --- training ----------------------------------------------------------------


@dataclass(frozen=True)
class ModelPlan:
    """What to train: a feature layout with its options and a classifier."""

    layout: str
    classifier: Estimator
    options: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        return STATUS_LABEL if self.layout == "status" else GRADE_LABEL

    def stages(self) -> tuple[list, list]:
        """Stages up to the assembled columns, and those that learn from the vector."""
        stages = feature_stages(self.layout, **self.options)
        cut = next(i for i, s in enumerate(stages) if isinstance(s, VectorAssembler)) + 1
        return stages[:cut], [*stages[cut:], self.classifier]

    def pipeline(self) -> Pipeline:
        made, learned = self.stages()
        return Pipeline(stages=[*made, *learned])


def status_forest(seed: int, trees: int = 100, depth: int = 10, **options) -> ModelPlan:
    return ModelPlan("status", random_forest(seed, trees, depth), options)


def status_logistic(max_iter: int = 100, reg: float = 0.01, **options) -> ModelPlan:
    return ModelPlan("status", logistic_regression(max_iter, reg), options)


def status_boosted(seed: int, rounds: int = 300, step: float = 0.01, depth: int = 5, **options) -> ModelPlan:
    return ModelPlan("status", boosted_trees(seed, rounds, step, maxDepth=depth), options)


def grade_perceptron(
    seed: int = 1234,
    hidden: Sequence[int] = (15, 15),
    max_iter: int = 100,
    layout: str = "grade",
    scale: bool = True,
    **options,
) -> ModelPlan:
    classifier = perceptron(feature_count(layout), seed, hidden, max_iter)
    return ModelPlan(layout, classifier, {"scale": scale, **options})


def grade_tree(seed: int, depth: int = 5, **options) -> ModelPlan:
    return ModelPlan("grade", decision_tree(seed, depth), options)


def training_rows(df: DataFrame, plan: ModelPlan, key: str | None = "id") -> DataFrame:
    """The columns a model needs with a numeric label, written once.

    Fitting reads its input several times; the written table gives every pass, and every retry,
    the same rows in the same order, without redoing the joins behind ``df``.
    """
    return _counted_rows(df, plan, key)[0]


def _counted_rows(df: DataFrame, plan: ModelPlan, key: str | None = "id") -> tuple[DataFrame, int]:
    """``training_rows`` with their number."""
    label = F.col(STATUS_LABEL).cast("double") if plan.layout == "status" else encode_grade("loan_grade")
    keys = [key] if key and key in df.columns else []
    rows = df.select(*keys, *domain.RAW_FEATURES, label.alias(plan.label))
    written = durable(rows.filter(F.col(plan.label).isNotNull()), "training")
    # Partitions follow from the rows alone, in number, content and order: a learner that draws
    # rows by partition gives the same model whatever cores or shuffle settings a session has.
    place, n = F.xxhash64(*written.columns), written.count()
    partitions = boosting_partitions(n) if isinstance(plan.classifier, GBTClassifier) else training_partitions(n)
    dealt = written.repartition(partitions, place).sortWithinPartitions(place, *written.columns)
    return dealt, n


def training_partitions(rows: int) -> int:
    """A partition for every 4,096 rows of a small table, growing slowly beyond 64 of them."""
    return max(1, min(-(-rows // 4096), 64 + rows // 500_000))


def boosting_partitions(rows: int) -> int:
    """Fewer partitions where hundreds of short jobs follow one another.

    A round of boosting has a job with a shuffle for each level. Over many small partitions starting
    their tasks takes longer than the rows. Up to 49,152 rows the partitions are the same.
    """
    return min(training_partitions(rows), max(12, -(-rows // 262_144)))


def _vectors(rows: DataFrame, plan: ModelPlan, made: list, keep: Sequence[str] = ()) -> tuple[PipelineModel, DataFrame]:
    """Fitted feature stages and their persisted output: a learner reads it once per iteration."""
    maker = Pipeline(stages=made).fit(rows)
    vector = maker.stages[-1].getOutputCol()
    vectors = maker.transform(rows).select(vector, plan.label, *keep)
    return maker, vectors.persist(StorageLevel.MEMORY_AND_DISK)


# A forest of up to so many rows keeps the node each row has come to in each tree (400 bytes a row for
# 100 trees); with more it walks down from the tops again, which needs no memory. The model is the same.
NODE_IDS_ROWS = 10_000_000
# A forest of more rows than this is fitted by ``forests.fit_forest``: the same algorithm with other draws.
HISTOGRAM_ROWS = 500_000
# Fits that run side by side hold their rows at the same time: so many in all, or one fit alone.
PARALLEL_ROWS = 4_000_000


def _learner(learned: list, maker: PipelineModel, vectors: DataFrame, n: int) -> Pipeline:
    """The learning stages; a perceptron's first layer gets the width the vector really has."""
    *before, classifier = learned
    if isinstance(classifier, RandomForestClassifier) and n <= NODE_IDS_ROWS:
        # As many levels as the trees are deep need no checkpoint between them.
        classifier = classifier.copy({classifier.cacheNodeIds: True, classifier.checkpointInterval: -1})
    if isinstance(classifier, MultilayerPerceptronClassifier):
        width = vectors.schema[maker.stages[-1].getOutputCol()].metadata["ml_attr"]["num_attrs"]
        layers = [width, *classifier.getLayers()[1:]]
        classifier = classifier.copy({classifier.layers: layers})
    return Pipeline(stages=[*before, classifier])


def _learned(learner: Pipeline, vectors: DataFrame, n: int, setting: dict | None = None) -> PipelineModel:
    """The learning stages fitted to about ``n`` rows."""
    *before, classifier = learner.getStages()
    if isinstance(classifier, RandomForestClassifier) and n > HISTOGRAM_ROWS:
        classifier = classifier.copy(setting or {})
        scaled = Pipeline(stages=before).fit(vectors)
        made = scaled.transform(vectors)
        if forests.supports(classifier, made):
            return PipelineModel([*scaled.stages, forests.fit_forest(made, classifier, n)])
    return learner.fit(vectors, setting or {})


def train(df: DataFrame, plan: ModelPlan) -> PipelineModel:
    """Fit the plan; the result scores raw loan rows."""
    made, learned = plan.stages()
    rows, n = _counted_rows(df, plan, key=None)
    maker, vectors = _vectors(rows, plan, made)
    try:
        learner = _learned(_learner(learned, maker, vectors, n), vectors, n)
    finally:
        vectors.unpersist()
    return PipelineModel([*maker.stages, *learner.stages])


# --- prediction ----------------------------------------------------------------


def spread(df: DataFrame, tasks_per_core: int = 4) -> DataFrame:
    """The rows dealt evenly over the session's cores.

    A table of one file, or of a few large row groups, is read by a few tasks. Work that costs more
    for each row than a shuffle, as a walk through a forest does, should not be left to them.
    """
    return df.repartition(tasks_per_core * df.sparkSession.sparkContext.defaultParallelism)


def keep_invalid(model: PipelineModel) -> PipelineModel:
    """A copy of the model that scores rows with missing features instead of dropping them."""
    copy = model.copy()
    for stage in copy.stages:
        if isinstance(stage, VectorAssembler):
            stage.setHandleInvalid("keep")
    return copy


def score(df: DataFrame, model: PipelineModel, error: str = "error") -> DataFrame:
    """Every row of ``df`` with the model's outputs and a text column ``error``.

    A row whose vector lacks a feature gets no prediction, but null and the error; no row is
    dropped.
    """
    scorer = keep_invalid(model)
    assembled = next(s for s in scorer.stages if isinstance(s, VectorAssembler)).getOutputCol()
    scored = scorer.transform(df)
    lacking = F.exists(vector_to_array(assembled), F.isnan)
    return scored.withColumns(
        {
            "prediction": F.when(~lacking, F.col("prediction")),
            "probabilities": F.when(~lacking, vector_to_array("probability")),
            error: F.when(lacking, F.lit("missing features")),
        }
    ).drop("probability", "rawPrediction")


def predict(df: DataFrame, model: PipelineModel, prefix: str = "") -> DataFrame:
    """The columns of ``df`` with prediction, class probabilities and the highest probability.

    Rows with a missing feature stay, with nulls.
    """
    return score(df, model, "_missing").select(
        *(F.col(c) for c in df.columns),
        F.col("prediction").alias(f"{prefix}prediction"),
        F.col("probabilities").alias(f"{prefix}probabilities"),
        F.array_max("probabilities").alias(f"{prefix}max_probability"),
    )


# --- cross-validation ------------------------------------------------------------


def status_evaluator() -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(
        labelCol=STATUS_LABEL, rawPredictionCol="rawPrediction", metricName="areaUnderROC"
    )


def grade_evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(
        labelCol=GRADE_LABEL, predictionCol="prediction", metricName="accuracy"
    )


def grid(**values: Sequence) -> list[dict]:
    """Every combination of the named classifier settings; one empty setting without any."""
    combos: list[dict] = [{}]
    for name, options in values.items():
        combos = [{**c, name: o} for c in combos for o in options]
    return combos


def _measured(
    rows: DataFrame,
    label: str,
    made: list,
    learned: list,
    folds: int,
    settings: Sequence[dict],
    evaluator: Evaluator,
    parallelism: int,
    n: int,
) -> list[tuple[int, int, float]]:
    """(setting, fold, metric) of every setting on every fold of the ``n`` ``rows`` (with ``fold``)."""

    def vectors_of(seen: DataFrame) -> tuple[PipelineModel, DataFrame]:
        """Feature stages fitted to some of the rows, and the vectors of all."""
        maker = Pipeline(stages=made).fit(seen)
        vector = maker.stages[-1].getOutputCol()
        vectors = maker.transform(rows).select(vector, label, "fold")
        return maker, vectors.persist(StorageLevel.MEMORY_AND_DISK)

    # Stages that learn nothing from the rows give the same vectors on every fold.
    shared = None if any(isinstance(s, Estimator) for s in made) else vectors_of(rows)

    def run(fold: int) -> list[tuple[int, int, float]]:
        """All settings on one fold; its feature stages and vectors are made once."""
        maker, vectors = shared or vectors_of(rows.filter(F.col("fold") != fold))
        try:
            learner = _learner(learned, maker, vectors, n)
            classifier = learner.getStages()[-1]
            results = []
            for place, setting in enumerate(settings):
                chosen = {classifier.getParam(n): v for n, v in setting.items()}
                model = _learned(learner, vectors.filter(F.col("fold") != fold), n, chosen)
                measured = evaluator.evaluate(model.transform(vectors.filter(F.col("fold") == fold)))
                results.append((place, fold, measured))
            return results
        finally:
            if not shared:
                vectors.unpersist()

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, PARALLEL_ROWS // max(n, 1)))) as pool:
        try:
            return [r for found in pool.map(run, range(folds)) for r in found]
        finally:
            if shared:
                shared[1].unpersist()


def cross_validate(
    df: DataFrame,
    plan: ModelPlan,
    seed: int,
    folds: int,
    settings: Sequence[dict] = ({},),
    evaluator: Evaluator | None = None,
    key: str = "id",
    parallelism: int = 1,
) -> tuple[DataFrame, dict]:
    """Metric per (setting, fold) and the setting with the best mean.

    A row's fold follows from its key and the seed, so folds do not move with the partitioning.
    Feature stages are fitted without the fold they are measured on.
    """
    evaluator = evaluator or (status_evaluator() if plan.layout == "status" else grade_evaluator())
    made, learned = plan.stages()
    rows, n = _counted_rows(df, plan, key)
    rows = with_fold(rows, seed, folds, key)

    results = _measured(rows, plan.label, made, learned, folds, settings, evaluator, parallelism, n)
    frame = df.sparkSession.createDataFrame(
        [(json.dumps(settings[p], sort_keys=True), f, float(m)) for p, f, m in results],
        "setting string, fold int, metric double",
    )
    means = [sum(m for p, _, m in results if p == place) / folds for place in range(len(settings))]
    pick = max if evaluator.isLargerBetter() else min
    return frame, settings[means.index(pick(means))]


def successive_halving(
    df: DataFrame,
    plan: ModelPlan,
    seed: int,
    folds: int,
    settings: Sequence[dict],
    keep: int = 2,
    evaluator: Evaluator | None = None,
    key: str = "id",
    parallelism: int = 1,
) -> tuple[DataFrame, dict]:
    """Search that tries all settings on few rows and only the better ones on more.

    On each rung every setting left is cross-validated; one in ``keep`` of them, by the mean metric,
    goes on to a rung with ``keep`` times the rows. The last rung has all rows. Rows belong to a
    rung by their key's hash, so larger rungs hold the smaller ones, and folds are the same on all
    of them. Returns (setting, rung, fraction, fold, metric) and the best setting of the last rung.
    Equal means go by the order of ``settings``.
    """
    if keep < 2:
        raise ValueError("keep must be at least 2")
    evaluator = evaluator or (status_evaluator() if plan.layout == "status" else grade_evaluator())
    made, learned = plan.stages()
    rows, n = _counted_rows(df, plan, key)
    rows = with_fold(rows, seed, folds, key)
    rungs, left = 0, len(settings)
    while left > 1:
        rungs, left = rungs + 1, -(-left // keep)
    slots = 1 << 20
    # Other numbers than the folds' decide about rungs.
    slot = key_slot(key, seed + 7919, slots)
    open_, measures = list(range(len(settings))), []
    for rung in range(rungs + 1):
        fraction = 1.0 / keep ** (rungs - rung)
        some = rows.filter(slot < int(fraction * slots))
        chosen = [settings[p] for p in open_]
        found = _measured(some, plan.label, made, learned, folds, chosen, evaluator, parallelism, int(n * fraction))
        measures += [(json.dumps(chosen[p], sort_keys=True), rung, fraction, f, float(m)) for p, f, m in found]
        means = [sum(m for p, _, m in found if p == place) / folds for place in range(len(chosen))]
        sign = -1 if evaluator.isLargerBetter() else 1
        ranked = sorted(range(len(chosen)), key=lambda place: (sign * means[place], place))
        open_ = [open_[p] for p in ranked[: -(-len(open_) // keep)]]
    frame = df.sparkSession.createDataFrame(
        measures, "setting string, rung int, fraction double, fold int, metric double"
    )
    return frame, settings[open_[0]]


@dataclass(frozen=True)
class TunedModel:
    """A model refitted with the best setting of a search, and the metric of each (setting, fold)."""

    model: PipelineModel
    setting: dict
    metrics: DataFrame


def tune(
    df: DataFrame,
    plan: ModelPlan,
    seed: int,
    folds: int,
    evaluator: Evaluator | None = None,
    key: str = "id",
    parallelism: int = 1,
    **values: Sequence,
) -> TunedModel:
    """Search by ``cross_validate`` over the grid of ``values`` and refit the best on all rows."""
    metrics, best = cross_validate(df, plan, seed, folds, grid(**values), evaluator, key, parallelism)
    chosen = plan.classifier.copy({plan.classifier.getParam(n): v for n, v in best.items()})
    return TunedModel(train(df, ModelPlan(plan.layout, chosen, plan.options)), best, metrics)


def tuning_metrics(metrics: DataFrame) -> DataFrame:
    """Mean and deviation of the metric per setting of a search."""
    return metrics.groupBy("setting").agg(
        F.avg("metric").alias("mean_metric"), F.stddev_pop("metric").alias("std_metric")
    )
