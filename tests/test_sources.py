"""Reading, writing, scratch tables and stored models."""

import pytest

from fathom.operators import modeling
from fathom.sources import models, readers, scratch, writers


def test_csv_round_trip(spark, train_rows, test_rows, tmp_path):
    writers.write_csv(train_rows, str(tmp_path / "train"))
    assert readers.read_loans(spark, str(tmp_path / "train")).exceptAll(train_rows).count() == 0
    inferred = readers.read_loans(spark, str(tmp_path / "train"), infer=True)
    assert dict(inferred.drop("id").dtypes) == dict(train_rows.drop("id").dtypes)
    writers.write_csv(test_rows, str(tmp_path / "test"))
    back = readers.read_loans(spark, str(tmp_path / "test"))
    assert back.columns == test_rows.columns and back.exceptAll(test_rows).count() == 0


def test_separator_and_existing_target(spark, train_rows, tmp_path):
    path = str(tmp_path / "semi")
    train_rows.write.option("header", True).option("sep", ";").csv(path)
    assert readers.read_loans(spark, path, sep=";").count() == 3
    with pytest.raises(Exception, match="already exists"):
        writers.write_csv(train_rows, path)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_missing_path_is_an_error(spark, fmt):
    with pytest.raises(ValueError, match="Error"):
        readers.read_loans(spark, "nonexistent/path/train", fmt)


def test_durable_keeps_rows_and_schema(spark, loans):
    kept = scratch.durable(loans)
    assert dict(kept.dtypes) == dict(loans.dtypes)
    assert kept.exceptAll(loans).count() == 0 and kept.count() == loans.count()


class Cluster:
    """The parts of a cluster session that the scratch folder depends on."""

    master = "spark://somewhere:7077"

    def __init__(self, settings, checkpoint=None):
        self.settings, self.checkpoint = settings, checkpoint
        self.sparkContext = self.conf = self

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, folder):
        self.checkpoint = f"{folder.rstrip('/')}/run"


def test_scratch_folder_is_stable_and_the_learners_use_it(spark):
    own = scratch.scratch_root(spark)
    assert scratch.scratch_root(spark) == own
    assert spark.sparkContext.getCheckpointDir()


def test_scratch_folder_of_a_cluster():
    named = {scratch.SETTING: "hdfs:///shared/"}
    assert scratch.scratch_root(Cluster(named, "hdfs:///shared/abc")) == "hdfs:///shared"
    assert scratch.scratch_root(Cluster(named)) == "hdfs:///shared/run"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Cluster({}))


def test_models_are_stored_and_loaded(spark, loans, tmp_path):
    model = modeling.train(loans, modeling.status_forest(1, trees=3, depth=3))
    path = str(tmp_path / "forest")
    models.save_model(model, path)
    with pytest.raises(Exception, match="exist"):
        models.save_model(model, path)
    models.save_model(model, path, overwrite=True)
    loaded = models.load_model(spark, path)
    ours = model.transform(loans).select("id", "prediction")
    assert loaded.transform(loans).select("id", "prediction").exceptAll(ours).count() == 0
    models.save_model(model.stages[-1], str(tmp_path / "stage"))
    assert models.load_model(spark, str(tmp_path / "stage")).getNumTrees == 3


def test_prediction_output(spark, loans, tmp_path):
    model = modeling.train(loans, modeling.status_logistic(max_iter=5))
    output = writers.prediction_output(model.transform(loans))
    assert dict(output.dtypes) == {"id": "bigint", "loan_status_prediction": "int"}
    writers.write_predictions(model.transform(loans), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1500


def test_csv_columns_are_matched_in_every_file(spark, train_rows, tmp_path):
    names = train_rows.columns
    writers.write_csv(train_rows.coalesce(1), str(tmp_path / "loans"))
    train_rows.select(*reversed(names)).coalesce(1).write.mode("append").option("header", True).csv(str(tmp_path / "loans"))
    with pytest.raises(Exception):
        readers.read_loans(spark, str(tmp_path / "loans")).collect()


def test_wide_ids_are_read_and_bad_records_reported(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text("id,person_age,person_income\n3000000000,30,40000\n2,thirty,40000\n3,41,50000.5\n")
    assert {r["id"] for r in readers.read_loans(spark, str(path)).collect()} == {3000000000, 2, 3}
    bad = readers.rejected_records(spark, str(path)).collect()
    assert sorted(r["id"] for r in bad) == [2, 3] and all("," in r["record"] for r in bad)
