"""Shapley values and responses of trees against sums over all subsets of features."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import domain
from fathom.operators import modeling, tree_paths
from fathom.operators.tree_paths import Attribution, leaves


def walk(nodes, x, known, at=0):
    """The tree's answer when only the features in ``known`` are known."""
    node = nodes[at]
    if node["feature"] < 0:
        return node["value"]
    sides = [nodes[node["left"]]["cover"], nodes[node["right"]]["cover"]]
    if node["feature"] in known:
        v = x[node["feature"]]
        low = v in node["categories"] if node["categories"] is not None else v <= node["threshold"]
        return walk(nodes, x, known, node["left"] if low else node["right"])
    total = sum(sides)
    return sum(c / total * walk(nodes, x, known, node[s]) for c, s in zip(sides, ("left", "right")))


def subsets_shapley(nodes, x, features):
    values = []
    for j in range(features):
        others = [i for i in range(features) if i != j]
        value = 0.0
        for k in range(features):
            weight = math.factorial(k) * math.factorial(features - k - 1) / math.factorial(features)
            for some in combinations(others, k):
                value += weight * (walk(nodes, x, {*some, j}) - walk(nodes, x, set(some)))
        values.append(value)
    return values


def random_tree(rng, features, depth, categories=False):
    nodes = []

    def grow(left, cover):
        number = len(nodes)
        nodes.append({"tree": 0, "node": number, "feature": -1, "threshold": None, "categories": None,
                      "left": -1, "right": -1, "value": float(rng.random()), "cover": cover})
        if left and rng.random() < 0.9:
            part = float(rng.uniform(0.05, 0.95)) * cover
            mine = {"feature": int(rng.integers(features))}
            if categories and rng.random() < 0.5:
                mine["categories"] = [float(c) for c in rng.choice(5, int(rng.integers(1, 4)), replace=False)]
            else:
                mine["threshold"] = float(rng.integers(0, 5))
            mine["left"], mine["right"] = grow(left - 1, part), grow(left - 1, cover - part)
            nodes[number] |= mine
        return number

    grow(depth, 100.0)
    return nodes


@pytest.mark.parametrize("categories", [False, True])
def test_values_equal_sums_over_all_subsets(categories):
    rng = np.random.default_rng(4)
    for _ in range(25):
        features = int(rng.integers(1, 6))
        nodes = random_tree(rng, features, 4, categories)
        x = rng.integers(-1, 6, (12, features)).astype(float)
        attribution = Attribution(leaves(nodes), features)
        found = attribution(x)
        for row, own in zip(x, found):
            assert own == pytest.approx(subsets_shapley(nodes, row, features), abs=1e-12)
            assert attribution.base + own.sum() == pytest.approx(walk(nodes, row, set(range(features))), abs=1e-12)


def test_many_features_on_one_path():
    """Paths of more conditions than patterns are counted for."""
    rng = np.random.default_rng(6)
    depth = 14
    nodes = []
    for i in range(depth):
        nodes.append({"tree": 0, "node": 2 * i, "feature": i, "threshold": 0.0, "categories": None,
                      "left": 2 * i + 1, "right": 2 * i + 2, "value": 0.0, "cover": 2.0 ** (depth - i)})
        nodes.append({"tree": 0, "node": 2 * i + 1, "feature": -1, "threshold": None, "categories": None,
                      "left": -1, "right": -1, "value": float(i), "cover": 2.0 ** (depth - i - 1)})
    nodes.append({"tree": 0, "node": 2 * depth, "feature": -1, "threshold": None, "categories": None,
                  "left": -1, "right": -1, "value": 99.0, "cover": 1.0})
    x = rng.normal(size=(40, depth))
    attribution = Attribution(leaves(nodes), depth)
    by_number = {n["node"]: n for n in nodes}
    for row, own in zip(x, attribution(x)):
        assert attribution.base + own.sum() == pytest.approx(walk(by_number, row, set(range(depth))), abs=1e-9)


@pytest.fixture(scope="module")
def small_forest(loans):
    return modeling.train(loans, modeling.status_forest(7, trees=4, depth=4))


def test_forest_values_add_up_to_its_probability(loans, small_forest):
    sums = tree_paths.shapley_sums(loans, small_forest)
    row = sums.agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("probability") - F.col("explained"))).alias("far")
    ).first()
    assert row.n == loans.count() and row.far < 1e-9


def test_forest_values_equal_sums_over_all_subsets(loans, small_forest):
    """Each tree of depth 4 on its own, over the features it uses."""
    nodes = tree_paths.node_table(small_forest, loans)
    rows = [r.asDict() for r in nodes.collect()]
    names = domain.STATUS_LAYOUT
    some = loans.orderBy("id").limit(5)
    found = {(r.id, r.feature): r.value for r in tree_paths.tree_shapley(some, small_forest, nodes=nodes).collect()}
    assert len(found) == 5 * len(names)
    from pyspark.ml.functions import vector_to_array

    vectors = {
        r.id: r.x for r in modeling.score(some, small_forest).select("id", vector_to_array("features").alias("x")).collect()
    }
    slots = [domain.SLOT_NAMES.get(n, n) for n in names]
    for key, x in vectors.items():
        total = [0.0] * len(names)
        for tree in range(4):
            own = {r["node"]: r for r in rows if r["tree"] == tree}
            used = sorted({r["feature"] for r in own.values() if r["feature"] >= 0})
            renamed = {n: {**r, "feature": used.index(r["feature"]) if r["feature"] >= 0 else -1} for n, r in own.items()}
            for f, value in zip(used, subsets_shapley(renamed, [x[f] for f in used], len(used))):
                total[f] += value / 4
        assert [found[key, s] for s in slots] == pytest.approx(total, abs=1e-10)


def test_rows_that_lack_a_feature(spark, null_rows, loans, small_forest):
    values = tree_paths.tree_shapley(null_rows, small_forest).collect()
    assert len(values) == 2 * len(domain.STATUS_LAYOUT) and all(v.value is None for v in values)
    assert tree_paths.tree_shapley(loans.limit(0), small_forest).count() == 0
    twice = loans.limit(3).union(loans.limit(3))
    assert tree_paths.tree_shapley(twice, small_forest).count() == 6 * len(domain.STATUS_LAYOUT)


def test_response_equals_the_walk_with_one_known_feature(loans, small_forest):
    nodes = tree_paths.node_table(small_forest, loans)
    rows = [r.asDict() for r in nodes.collect()]
    feature = domain.STATUS_LAYOUT.index("loan_int_rate")
    values = [0.0, 8.0, 12.5, 30.0]
    found = {r.grid_value: r.probability for r in tree_paths.response(nodes, feature, [*values, 8.0]).collect()}
    assert sorted(found) == values
    x = [0.0] * len(domain.STATUS_LAYOUT)
    for v in values:
        x[feature] = v
        trees = [{r["node"]: r for r in rows if r["tree"] == t} for t in range(4)]
        assert found[v] == pytest.approx(sum(walk(t, x, {feature}) for t in trees) / 4, abs=1e-12)


def test_response_reads_no_rows(loans, small_forest):
    nodes = tree_paths.node_table(small_forest, loans)
    plan = tree_paths.response(nodes, 0, [1.0, 2.0])._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "orders" not in plan


def test_trees_of_one_leaf(spark):
    nodes = spark.createDataFrame([(0, 0, -1, None, None, -1, -1, 0.25, 10.0)], tree_paths.NODE_SCHEMA)
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id bigint, a double")
    got = {r.id: (r.base, r.value) for r in tree_paths.shapley_of(df, nodes, ["a"]).collect()}
    assert got == {1: (0.25, 0.0), 2: (0.25, None)}
    assert tree_paths.response(nodes, 0, [1.0]).first().probability == 0.25


def test_rule_tree_counts_every_node(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 5, 1), (2, 1.0, 9, 0), (3, 3.0, 5, 1), (4, None, 5, 1), (5, 4.0, 5, None)],
        "id bigint, a double, b int, y int",
    )
    rules = {"column": "a", "up_to": 2, "low": {"column": "b", "up_to": 6, "low": None, "high": None}, "high": None}
    nodes, columns = tree_paths.rule_tree(df, rules, "y")
    assert columns == ["a", "b"]
    got = [(r.node, r.feature, r.cover, r.value) for r in nodes.orderBy("node").collect()]
    assert got == [(0, 0, 3.0, 2 / 3), (1, 1, 2.0, 0.5), (2, -1, 1.0, 1.0), (3, -1, 1.0, 0.0), (4, -1, 1.0, 1.0)]


def test_rows_by_tables_of_all_patterns_equal_those_by_their_own(monkeypatch):
    """Also with leaves that no training row came to, and few conditions listed."""
    rng = np.random.default_rng(9)
    nodes = [{**n, "tree": t} for t in range(3) for n in random_tree(rng, 6, 6, categories=t == 1)]
    bottom = next(n for n in reversed(nodes) if n["feature"] < 0)
    bottom["cover"] = 0.0
    x = rng.integers(-1, 6, (2500, 6)).astype(float)
    attribution = Attribution(leaves(nodes), 6)
    listed = attribution(x)
    assert listed == pytest.approx(np.concatenate([attribution(part) for part in np.array_split(x, 5)]), abs=1e-12)
    monkeypatch.setattr(tree_paths, "LISTED_CONDITIONS", 2)
    assert listed == pytest.approx(Attribution(leaves(nodes), 6)(x), abs=1e-12)


def test_every_pattern_of_a_leaf_by_one_integral():
    rng = np.random.default_rng(3)
    for m in (1, 2, 5, 8):
        conditions = tuple(tree_paths.Condition(f, share=float(s)) for f, s in enumerate(rng.uniform(0.01, 1, m)))
        leaf = tree_paths.Leaf(0, 0.7, conditions)
        met = (np.arange(1 << m)[:, None] >> np.arange(m) & 1) == 1
        assert tree_paths._every_pattern(leaf) == pytest.approx(tree_paths._changes(leaf, met), abs=1e-13)


@pytest.mark.parametrize("states, kept", [(2**10, 2**28), (2**11, 0), (1, 5_000)])
@pytest.mark.parametrize("categories", [False, True])
def test_leaves_that_share_a_table_give_what_each_gives_alone(monkeypatch, states, kept, categories):
    monkeypatch.setattr(tree_paths, "GROUP_STATES", states)
    monkeypatch.setattr(tree_paths, "KEPT_BYTES", kept)
    monkeypatch.setattr(tree_paths, "CHUNK_ROWS", 700)
    rng = np.random.default_rng(8)
    nodes = [dict(n, tree=t) for t in range(3) for n in random_tree(rng, 6, 7, categories)]
    x = rng.integers(-1, 6, (1_500, 6)).astype(float)
    attribution = Attribution(leaves(nodes), 6)
    n_leaves = sum(map(len, attribution.listed.values()))
    n_tables = sum(map(len, attribution.groups.values()))
    assert n_tables == n_leaves if states == 1 else n_tables < n_leaves / 3
    monkeypatch.setattr(tree_paths, "LISTED_ROWS", 2_000)
    alone = attribution(x)
    monkeypatch.setattr(tree_paths, "LISTED_ROWS", 1_000)
    for _ in range(2):  # tables made, then kept as far as they may
        assert np.abs(attribution(x) - alone).max() < 1e-12
        assert sum(t[0].nbytes for t in attribution.kept.values()) <= kept


def test_batches_and_gaps(spark, monkeypatch):
    """Rows of several batches, some without a vector or a number of it."""
    nodes = random_tree(np.random.default_rng(9), 3, 4)
    frame = spark.createDataFrame(
        [tuple(n[c] for c in ("tree", "node", "feature", "threshold", "categories", "left", "right", "value", "cover")) for n in nodes],
        tree_paths.NODE_SCHEMA,
    )
    rows = [(i, float(i % 7), None if i % 11 == 0 else float(i % 5), float("nan") if i % 13 == 0 else 2.0) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").coalesce(1)
    by_number = {n["node"]: n for n in nodes}
    sums = tree_paths.shapley_of(df, frame, ["a", "b", "c"]).groupBy("id").agg(
        F.max("base").alias("base"), F.sum("value").alias("gain"), F.count("value").alias("n")
    )
    found = {r.id: r for r in sums.collect()}
    assert len(found) == 3_000
    for i, *x in rows:
        if i % 11 == 0 or i % 13 == 0:
            assert found[i].n == 0
        else:
            assert found[i].n == 3
            assert found[i].base + found[i].gain == pytest.approx(walk(by_number, x, {0, 1, 2}), abs=1e-12)
