"""Saving and loading fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml import classification as mlc
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

_LOADERS = {
    cls.__name__: cls
    for cls in (
        PipelineModel,
        CrossValidatorModel,
        mlc.DecisionTreeClassificationModel,
        mlc.RandomForestClassificationModel,
        mlc.GBTClassificationModel,
        mlc.LogisticRegressionModel,
        mlc.MultilayerPerceptronClassificationModel,
    )
}


def save_model(model, path: str, overwrite: bool = False) -> None:
    """Write a fitted model; without ``overwrite`` an existing target is an error."""
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_model(spark: SparkSession, path: str):
    """Load any model this package fits, picked by the class its metadata names."""
    metadata = DefaultParamsReader.loadMetadata(path, spark)
    name = metadata["class"].rsplit(".", 1)[-1]
    if name not in _LOADERS:
        raise ValueError(f"Error loading model from {path!r}: unknown class {metadata['class']}")
    return _LOADERS[name].load(path)
