"""The forest learner for many rows against counts by hand and Spark's learner."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from fathom.operators import forests, modeling, tree_paths


def test_thresholds_lie_between_distinct_values():
    assert forests.thresholds(np.array([1.0, 3.0, 3.0, 9.0]), 4).tolist() == [2.0, 6.0]
    assert forests.thresholds(np.array([5.0, 5.0]), 4).tolist() == []
    many = forests.thresholds(np.arange(1000.0), 8)
    assert len(many) == 7 and np.abs(np.diff(many) - 125).max() <= 1


def test_rows_are_drawn_like_a_poisson_number_and_the_same_again():
    times = forests.times_drawn(7, 3, (2, 1), 200_000)
    assert (times == forests.times_drawn(7, 3, (2, 1), 200_000)).all()
    assert (times != forests.times_drawn(7, 4, (2, 1), 200_000)).any()
    share = np.bincount(times, minlength=5)[:5] / len(times)
    assert share == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613, 0.0153], abs=0.005)
    assert times.mean() == pytest.approx(1, abs=0.01)


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 9, (6, 3, 4, 2))
    table[:, 1:] = table[:, :1, ::-1]  # every feature counts the same rows
    table[:, 1, 0] += table[:, 1, 3]
    table[:, 1, 3] = 0

    def gini(c):
        return 1 - ((c / c.sum()) ** 2).sum()

    for counts, row in zip(table, forests.best_splits(table, 5, 0.0)):
        gains = {}
        for f in range(3):
            for i in range(3):
                left, right = counts[f, : i + 1].sum(0), counts[f, i + 1 :].sum(0)
                if min(left.sum(), right.sum()) >= 5:
                    n = counts[f].sum()
                    parts = left.sum() / n * gini(left) + right.sum() / n * gini(right)
                    gains[f, i] = gini(counts[f].sum(0)) - parts
        assert row[2] == pytest.approx(max(gains.values()))
        assert gains[int(row[0]), int(row[1])] == pytest.approx(row[2])
        assert (row[3:5] == counts[0].sum(0)).all()
        assert (row[5:] == counts[int(row[0]), : int(row[1]) + 1].sum(0)).all()


@pytest.mark.parametrize("step", [7, 1000])
def test_tables_count_every_drawn_row_of_an_open_node(monkeypatch, step):
    monkeypatch.setattr(forests, "STEP_ROWS", step)
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 6, (300, 4)).astype(np.uint8)  # 3 intervals of 2 classes
    times = rng.integers(0, 4, 300).astype(np.uint8)
    tree = forests.Tree()
    tree.split(0, 2, 0, 0.1, ([1, 1], [1, 1]))
    tree.open = [2]
    (search,) = forests._searches([tree], 1, 7, 4, 2, 2)
    table = np.zeros((1, 2, 6), np.int32)
    forests._add_block(codes, times, search, 6, table)
    for j, feature in enumerate(search.drawn[:, 0]):
        right = codes[:, 2] // 2 > 0
        assert table[0, j].tolist() == [times[right & (codes[:, feature] == c)].sum() for c in range(6)]


@pytest.fixture(scope="module")
def large(loans):
    """A forest by way of the learner for many rows, and the same plan by Spark's."""
    plan = modeling.status_forest(7, trees=20, depth=6)
    made, learned = plan.stages()
    rows, n = modeling._counted_rows(loans, plan)
    maker, vectors = modeling._vectors(rows, plan, made)
    learner = modeling._learner(learned, maker, vectors, n)
    patch = pytest.MonkeyPatch()
    patch.setattr(modeling, "HISTOGRAM_ROWS", 0)
    ours = modeling._learned(learner, vectors, n)
    patch.undo()
    yield vectors.persist(), ours, modeling._learned(learner, vectors, n), n
    vectors.unpersist()


def test_large_tables_do_not_reach_the_slow_learner(loans, monkeypatch):
    """Spark's learner only gets a row of each class, for the settings around the nodes."""
    seen = []
    fit = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    monkeypatch.setattr(modeling, "HISTOGRAM_ROWS", 0)
    model = modeling.train(loans, modeling.status_forest(7, trees=2, depth=2))
    assert seen == [2] and model.stages[-1].getNumTrees == 2


def test_it_learns_as_well_as_sparks(large):
    vectors, ours, sparks, _ = large
    measure = modeling.status_evaluator()
    assert measure.evaluate(ours.transform(vectors)) > measure.evaluate(sparks.transform(vectors)) - 0.02
    forest = ours.stages[-1]
    assert forest.getNumTrees == 20 and forest.numClasses == 2 and forest.numFeatures == 20
    assert forest.getMaxDepth() == 6 and max(t.depth for t in forest.trees) <= 6
    assert np.argmax(forest.featureImportances.toArray()) == np.argmax(sparks.stages[-1].featureImportances.toArray())


def test_nodes_hold_the_rows_that_come_to_them(large):
    """Covers add up, leaves keep the smallest number of rows, siblings differ."""
    vectors, ours, _, n = large
    nodes = {(r.tree, r.node): r for r in tree_paths.node_table(ours, vectors).collect()}
    for (tree, number), node in nodes.items():
        if number == 0:
            assert node.cover == pytest.approx(n, rel=0.1)
        if node.feature >= 0:
            left, right = nodes[tree, node.left], nodes[tree, node.right]
            assert left.cover + right.cover == node.cover and min(left.cover, right.cover) >= 5
            if left.feature < 0 and right.feature < 0:
                assert (left.value > 0.5) != (right.value > 0.5)


def test_same_rows_and_seed_give_the_same_forest(large, loans, monkeypatch):
    monkeypatch.setattr(modeling, "HISTOGRAM_ROWS", 0)
    plan = modeling.status_forest(7, trees=3, depth=3)
    texts = {modeling.train(rows, plan).stages[-1].toDebugString.split("\n", 1)[1] for rows in (loans, loans.repartition(3))}
    assert len(texts) == 1


def test_unusual_settings_are_left_to_spark(large):
    vectors, *_ = large
    usual = modeling.random_forest(7)
    assert forests.supports(usual, vectors)
    assert not forests.supports(usual.copy({usual.impurity: "entropy"}), vectors)
    assert not forests.supports(usual.copy({usual.subsamplingRate: 0.5}), vectors)


def test_cross_validation_of_many_rows(loans, monkeypatch):
    monkeypatch.setattr(modeling, "HISTOGRAM_ROWS", 0)
    plan = modeling.status_forest(7, trees=10, depth=5)
    rows = modeling.cross_validate(loans, plan, 7, 2)[0].collect()
    assert len(rows) == 2 and all(r["metric"] > 0.8 for r in rows)
    assert modeling.cross_validate(loans.select(*loans.columns, F.lit(1).alias("more")), plan, 7, 2)[0].collect() == rows


def test_vectors_are_made_once_for_all_folds(loans, monkeypatch):
    """Stages that learn nothing are not run again for every fold."""
    made = []
    transform = modeling.PipelineModel.transform
    monkeypatch.setattr(modeling.PipelineModel, "transform", lambda self, df, *a: made.append(1) or transform(self, df, *a))
    plan = modeling.status_logistic(max_iter=2)
    modeling.cross_validate(loans, plan, 7, 3)
    assert len(made) == 1 + 3  # the vectors, and each fold's scores
