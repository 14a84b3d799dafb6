"""Exact attribution and response of tree models, from the table of their nodes.

A tree is the sum of its leaves. A leaf counts as far as a row meets the conditions on the way to
it; where a feature is left open, the share of training rows that went the leaf's way stands in for
its condition. So a leaf is a product with one factor for each feature on its path: 1 or 0 for the
row's own value, the share ``z`` for an open one. Everything here follows from that product:

* Shapley values: the weight of a feature's change is a sum over all subsets of the others. Subsets
  of the same size have the same weight, so the sum is read off the coefficients of the polynomial
  of the other features' factors ``z + o t``. Rows only differ in which conditions they meet, so
  each pattern of met conditions is worked out once for all rows of a batch, and a row adds up the
  entries of its patterns.
* Response to one feature: all others stay open, so it follows from the nodes alone, without rows.

Node tables have (tree, node, feature, threshold, categories, left, right, value, cover); a leaf
has feature -1. They are as large as the model's settings allow, not as the data, and only they
reach the driver and are sent to the executors.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.explain import feature_names
from fathom.operators.modeling import score
from fathom.sources.scratch import scratch_path
from fathom.sources.shipping import ship

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, categories array<double>, "
    "left int, right int, value double, cover double"
)
# Rows whose long patterns are worked out once, and those whose patterns are named together.
BATCH_ROWS = 100_000
CHUNK_ROWS = 4_000
# Leaves with more conditions have only the patterns worked out that rows have.
LISTED_CONDITIONS = 10
# Rows of a table that leaves share; at least as many as one listed leaf has patterns, at most 2^15.
GROUP_STATES = 1_024
# Bytes of tables that a task keeps from batch to batch; the others are made again.
KEPT_BYTES = 1 << 28
# Fewer rows have only their own patterns worked out.
LISTED_ROWS = 1_000


def node_table(model: PipelineModel, df: DataFrame, target: int = 1) -> DataFrame:
    """Nodes of a fitted tree or forest; ``value`` is the share of class ``target`` at the node.

    ``cover`` is the weight of the training rows that came to the node.
    """
    spark = df.sparkSession
    learned = model.stages[-1]
    path = scratch_path(spark, "model-nodes")
    learned.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    forest = "nodeData" in stored.columns
    tree, node = (F.col("treeID"), "nodeData.") if forest else (F.lit(0), "")
    split = F.col(f"{node}split")
    cover = F.aggregate(f"{node}impurityStats", F.lit(0.0), lambda a, x: a + x)
    continuous = split["numCategories"] == -1
    return stored.select(
        tree.cast("int").alias("tree"),
        F.col(f"{node}id").alias("node"),
        F.when(F.col(f"{node}leftChild") >= 0, split["featureIndex"]).otherwise(-1).alias("feature"),
        F.when(continuous, F.try_element_at(split["leftCategoriesOrThreshold"], F.lit(1))).alias("threshold"),
        F.when(~continuous, split["leftCategoriesOrThreshold"]).alias("categories"),
        F.col(f"{node}leftChild").alias("left"),
        F.col(f"{node}rightChild").alias("right"),
        (F.element_at(f"{node}impurityStats", target + 1) / cover).alias("value"),
        cover.alias("cover"),
    )


@dataclass(frozen=True)
class Condition:
    """What a path asks of one feature: above ``low``, up to ``high``, in none of the excluded
    and all of the wanted sets of categories; ``share`` of the training rows went this way."""

    feature: int
    low: float = -math.inf
    high: float = math.inf
    inside: tuple[frozenset, ...] = ()
    outside: tuple[frozenset, ...] = ()
    share: float = 1.0

    def met(self, values: np.ndarray) -> np.ndarray:
        ok = (values > self.low) & (values <= self.high)
        for some in self.inside:
            ok &= np.isin(values, list(some))
        for some in self.outside:
            ok &= ~np.isin(values, list(some))
        return ok


@dataclass(frozen=True)
class Leaf:
    tree: int
    value: float
    conditions: tuple[Condition, ...]


def leaves(rows: Sequence) -> list[Leaf]:
    """Every leaf with one condition for each feature on its path; ``rows`` are of a node table."""
    nodes = {(r["tree"], r["node"]): r for r in rows}
    children = {(r["tree"], c) for r in rows if r["feature"] >= 0 for c in (r["left"], r["right"])}
    found = []
    for top in sorted(set(nodes) - children):
        open_ = [(top, {})]
        while open_:
            at, path = open_.pop()
            node = nodes[at]
            if node["feature"] < 0:
                found.append(Leaf(at[0], node["value"], tuple(path[f] for f in sorted(path))))
                continue
            feature, known = node["feature"], node["cover"]
            old = path.get(feature, Condition(feature))
            for side, child in (("left", node["left"]), ("right", node["right"])):
                below = (at[0], child)
                share = old.share * (nodes[below]["cover"] / known if known else 0.0)
                low, high, inside, outside = old.low, old.high, old.inside, old.outside
                if node["categories"] is not None:
                    some = (frozenset(node["categories"]),)
                    inside, outside = (inside + some, outside) if side == "left" else (inside, outside + some)
                elif side == "left":
                    high = min(high, node["threshold"])
                else:
                    low = max(low, node["threshold"])
                open_.append((below, {**path, feature: Condition(feature, low, high, inside, outside, share)}))
    return found


def _changes(leaf: Leaf, met: np.ndarray) -> np.ndarray:
    """Shapley values of the leaf's features for each pattern (row of ``met``) of met conditions."""
    m = len(leaf.conditions)
    share = np.array([c.share for c in leaf.conditions])
    own = met.astype(float)
    # others[p, j]: coefficients of the product of (share + own t) over all features but j.
    others = np.zeros((len(met), m, m))
    others[:, :, 0] = 1.0
    each = np.arange(m)
    for i in range(m):
        rest = each != i
        part = others[:, rest]
        grown = part * share[i]
        grown[:, :, 1:] += part[:, :, :-1] * own[:, i, None, None]
        others[:, rest] = grown
    sizes = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    return leaf.value * (own - share) * (others @ np.array(sizes))


def _every_pattern(leaf: Leaf) -> np.ndarray:
    """``_changes`` of all patterns, bit i for condition i.

    The weighted sum over subsets is the integral over t of the product of ``z + t (o - z)`` over the
    other features: a polynomial, so a sum over few places is exact.
    """
    m = len(leaf.conditions)
    bits = np.arange(1 << m)[:, None] >> np.arange(m) & 1
    share = np.array([c.share for c in leaf.conditions])
    if not share.all():
        return _changes(leaf, bits == 1)
    at, weight = np.polynomial.legendre.leggauss((m + 1) // 2)
    t = (at + 1) / 2
    whole = weight[None, :] * (leaf.value / 2)
    for z in share:
        whole = np.concatenate([whole * (z - t * z), whole * (z + t * (1 - z))])
    off, on = share[:, None] * (1 - t), share[:, None] + t * (1 - share[:, None])
    changes = np.empty((1 << m, m))
    for i, z in enumerate(share):
        own = bits[:, i] == 1
        changes[:, i] = np.where(own, (1 - z) * (whole @ (1 / on[i])), -z * (whole @ (1 / off[i])))
    return changes


def _combinations(states: dict[int, np.ndarray]) -> int:
    return math.prod(int(state.max()) + 1 for state in states.values())


class Attribution:
    """Shapley values of all features over a whole model."""

    def __init__(self, found: list[Leaf], features: int):
        self.features = features
        self.trees = len({leaf.tree for leaf in found}) or 1
        self.base = sum(leaf.value * math.prod(c.share for c in leaf.conditions) for leaf in found) / self.trees
        found = [leaf for leaf in found if leaf.conditions]
        # A feature's values only matter by where they lie between the model's borders.
        self.borders: list[np.ndarray] = []
        of: list[list[Condition]] = [[] for _ in range(features)]
        for leaf in found:
            for c in leaf.conditions:
                of[c.feature].append(c)
        for used in of:
            edges = {e for c in used for e in (c.low, c.high) if math.isfinite(e)}
            # A category is the interval that ends at it; the next number starts another one.
            marks = {x for c in used for some in (*c.inside, *c.outside) for x in some}
            self.borders.append(np.array(sorted(edges | marks | {np.nextafter(x, -math.inf) for x in marks})))
        self.listed: dict[int, list[Leaf]] = {}
        for leaf in found:
            if len(leaf.conditions) <= LISTED_CONDITIONS:
                self.listed.setdefault(leaf.tree, []).append(leaf)
        self.groups = {tree: self._grouped(some) for tree, some in self.listed.items()}
        self.long = [leaf for leaf in found if len(leaf.conditions) > LISTED_CONDITIONS]
        # Tables of trees, for the next batch.
        self.kept: dict[int, tuple] = {}

    def _grouped(self, some: list[Leaf]) -> list[tuple[list[Leaf], dict[int, np.ndarray]]]:
        """Neighbouring leaves of a tree that share a table, and for each of their features the state
        an interval stands for.

        Intervals in which the same leaves have their condition met are one state. A table has a row
        for each combination of states; leaves near each other share most conditions, so several of
        them need hardly more rows than one.
        """
        groups: list[tuple[list[Leaf], dict[int, np.ndarray]]] = []
        for leaf in some:
            met = {c.feature: self._table(c).astype(np.int64) for c in leaf.conditions}
            states = dict(groups[-1][1]) if groups else {}
            for feature, own in met.items():
                finer = own + 2 * states[feature] if feature in states else own
                states[feature] = np.unique(finer, return_inverse=True)[1]
            if groups and _combinations(states) <= GROUP_STATES:
                groups[-1][0].append(leaf)
                groups[-1] = (groups[-1][0], states)
            else:
                groups.append(([leaf], met))
        return groups

    def _table(self, condition: Condition) -> np.ndarray:
        """Whether the condition is met in each interval of its feature."""
        borders = self.borders[condition.feature]
        beyond = np.nextafter(borders[-1], math.inf) if len(borders) else 0.0
        return condition.met(np.append(borders, beyond))

    def _tables(self, groups: list) -> tuple[np.ndarray, np.ndarray, list[int], dict[int, np.ndarray]]:
        """The tables of a tree's groups below each other, where each begins, the features of their columns,
        and by feature and interval what a row in it adds to the number of its row in each table."""
        starts = np.cumsum([0, *(_combinations(states) for _, states in groups)])
        columns = sorted({f for _, states in groups for f in states})
        column = {f: i for i, f in enumerate(columns)}
        table = np.empty((starts[-1], len(columns)))
        parts = {f: np.zeros((len(self.borders[f]) + 1, len(groups)), np.int16) for f in columns}
        for n, (some, states) in enumerate(groups):
            rows = np.arange(starts[n + 1] - starts[n])
            digits, size = {}, 1
            for f, state in states.items():
                parts[f][:, n] = state * size
                digits[f] = rows // size % (state.max() + 1)
                size *= state.max() + 1
            own = np.zeros((len(columns), len(rows)))
            for leaf in some:
                pattern = np.zeros(len(rows), np.int64)
                for i, c in enumerate(leaf.conditions):
                    bits = np.zeros(states[c.feature].max() + 1, np.int64)
                    bits[states[c.feature]] = self._table(c)
                    pattern += (bits << i).take(digits[c.feature])
                for c, changes in zip(leaf.conditions, np.ascontiguousarray(_every_pattern(leaf).T)):
                    own[column[c.feature]] += changes.take(pattern)
            table[starts[n] : starts[n + 1]] = own.T
        return table, starts, columns, parts

    def _add_tree(self, tree: int, place: list[np.ndarray], total: np.ndarray) -> None:
        """Add the leaves of one tree: each row of ``place`` adds up one table row for each group."""
        groups = self.groups[tree]
        made = self.kept.get(tree) or self._tables(groups)
        table, starts, columns, parts = made
        if tree not in self.kept and sum(t[0].nbytes for t in self.kept.values()) + table.nbytes <= KEPT_BYTES:
            self.kept[tree] = made
        # Places are within range; "clip" spares a copy through a buffer.
        take = partial(np.take, axis=0, mode="clip")
        for begin in range(0, len(total), CHUNK_ROWS):
            rows = slice(begin, begin + CHUNK_ROWS)
            own = np.zeros((len(total[rows]), len(columns)))
            at, part = np.zeros((2, len(own), len(groups)), np.int16)
            for feature, adds in parts.items():
                take(adds, place[feature][rows], out=part)
                at += part
            entry, values = at.T + starts[:-1, None], np.empty_like(own)
            for n in range(len(groups)):
                take(table, entry[n], out=values)
                own += values
            total[rows, columns] += own

    def _add_leaf(self, leaf: Leaf, place: list[np.ndarray], total: np.ndarray) -> None:
        """Add a leaf of many conditions: only the patterns that rows have are worked out."""
        pattern = np.zeros(len(total), np.int64)
        for i, c in enumerate(leaf.conditions):
            pattern |= (self._table(c).astype(np.int64) << i)[place[c.feature]]
        seen, of = np.unique(pattern, return_inverse=True)
        met = seen[:, None] >> np.arange(len(leaf.conditions)) & 1 == 1
        changes = _changes(leaf, met)
        for i, c in enumerate(leaf.conditions):
            total[:, c.feature] += changes[:, i][of]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Values (rows, features) of the rows of ``x``."""
        place = [np.searchsorted(b, x[:, f], "left") for f, b in enumerate(self.borders)]
        total = np.zeros((len(x), self.features))
        for tree, some in self.listed.items():
            if len(x) >= LISTED_ROWS:
                self._add_tree(tree, place, total)
            else:
                for leaf in some:
                    self._add_leaf(leaf, place, total)
        for leaf in self.long:
            self._add_leaf(leaf, place, total)
        return total / self.trees


def shapley_of(df: DataFrame, nodes: DataFrame, features: Sequence[str], key: str = "id") -> DataFrame:
    """(key, base, feature, value) for a tree given by its ``nodes`` over columns of ``df``.

    ``features[i]`` is the column that feature i of the nodes splits. Values add up to the row's
    prediction less ``base``, the mean prediction of the training rows; a column the tree does not
    use gets 0. A row that lacks one of the columns (null or NaN) has null values.
    """
    vectors = F.array(*(F.col(f).cast("double") for f in features))
    return _attributed(df.select(F.col(key), vectors.alias("_x")), nodes, list(features), key)


def tree_shapley(
    df: DataFrame, model: PipelineModel, key: str = "id", target: int = 1, nodes: DataFrame | None = None
) -> DataFrame:
    """(key, base, feature, value): exact Shapley values of a fitted tree or forest for every row.

    For each row ``base`` and its values add up to the model's probability of class ``target``.
    Open features are averaged along the paths by the training rows at each node. A row that lacks
    a feature has null values. There is no shuffle; repeated rows and keys are kept.
    """
    names = feature_names(model, df)
    scored = score(df, model, "_missing")
    whole = F.when(F.col("_missing").isNull(), vector_to_array("features"))
    nodes = nodes if nodes is not None else node_table(model, df, target)
    return _attributed(scored.select(F.col(key), whole.alias("_x")), nodes, names, key)


def _attributed(rows: DataFrame, nodes: DataFrame, names: list[str], key: str) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    width = len(names)
    shared = spark.sparkContext.broadcast(Attribution(leaves(nodes.collect()), width))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's own tables go with it.
        attribution = copy.copy(shared.value)
        attribution.kept = {}

        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = np.full((len(table), width), np.nan)
            lists = table["_x"].combine_chunks()
            x[lists.is_valid().to_numpy(zero_copy_only=False)] = (
                lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            )
            whole = ~np.isnan(x).any(axis=1)
            flat = np.full(x.shape, np.nan)
            if whole.any():
                flat[whole] = attribution(x[whole])
            missing = pa.array(np.repeat(~whole, width))
            values = pa.array(flat.ravel(), mask=missing.to_numpy(zero_copy_only=False))
            found = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, width, dtype=np.int32), values)
            base = pa.array(np.full(len(table), attribution.base))
            return pa.RecordBatch.from_arrays(
                [table[key].combine_chunks(), base, found], names=[key, "base", "values"]
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_ROWS:
                yield made(held)
                held = []
        if held:
            yield made(held)

    kind = rows.schema[key].dataType.simpleString()
    listed = rows.mapInArrow(work, f"`{key}` {kind}, base double, values array<double>")
    labels = F.array(*(F.lit(n) for n in names))
    return listed.select(
        F.col(key), "base", F.explode(F.arrays_zip(labels.alias("feature"), F.col("values").alias("value"))).alias("v")
    ).select(F.col(key), "base", "v.feature", "v.value")


def shapley_sums(df: DataFrame, model: PipelineModel, key: str = "id", target: int = 1) -> DataFrame:
    """(key, probability, explained): the model's probability beside base plus all values."""
    values = tree_shapley(df, model, key, target)
    sums = values.groupBy(key).agg(F.max("base").alias("base"), F.sum("value").alias("gain"), F.count("value").alias("n"))
    scored = score(df, model, "_missing").select(F.col(key), F.col("probabilities")[target].alias("probability"))
    explained = F.when(F.col("n") > 0, F.col("base") + F.col("gain")).alias("explained")
    return scored.join(sums, key).select(key, "probability", explained)


# --- response to one feature --------------------------------------------------------------------


def path_table(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, value, feature, low, high, share): the conditions of every leaf.

    Only for trees without categorical splits. A tree that is one leaf has a row without a feature.
    """
    rows = []
    for number, leaf in enumerate(leaves(nodes.collect())):
        if any(c.inside or c.outside for c in leaf.conditions):
            raise ValueError("a response to numbers needs trees with numeric splits only")
        for c in leaf.conditions or [Condition(-1)]:
            rows.append((leaf.tree, number, leaf.value, c.feature, c.low, c.high, c.share))
    schema = "tree int, leaf int, value double, feature int, low double, high double, share double"
    return nodes.sparkSession.createDataFrame(rows, schema)


def response(nodes: DataFrame, feature: int, values: Sequence[float]) -> DataFrame:
    """(grid_value, probability): the model's answer to one feature with all others left open.

    It is the walk through the nodes that follows ``feature`` by its value and splits at all other
    nodes by the training rows' shares. The table's rows play no part: the work is the model's
    leaves times the values, however many rows were learned.
    """
    spark = nodes.sparkSession
    paths = path_table(nodes)
    trees = nodes.select("tree").distinct().count()
    grid = F.explode(F.array(*(F.lit(float(v)) for v in sorted(set(values)))))
    met = ((F.col("grid_value") > F.col("low")) & (F.col("grid_value") <= F.col("high"))).cast("double")
    factor = F.when(F.col("feature") == feature, met).otherwise(F.col("share"))
    weighed = (
        paths.withColumn("grid_value", grid)
        .groupBy("grid_value", "leaf")
        .agg((F.product(factor) * F.first("value")).alias("part"))
    )
    return weighed.groupBy("grid_value").agg((F.sum("part") / trees).alias("probability"))


# --- trees given as rules ------------------------------------------------------------------------


def rule_tree(df: DataFrame, rules: dict, label: str) -> tuple[DataFrame, list[str]]:
    """The node table of a tree of rules over columns of ``df``, and its columns in order.

    ``rules`` is ``{"column": c, "up_to": number, "low": rules, "high": rules}`` or None for a leaf.
    One pass counts the rows that come to each node (``cover``) and their mean label (``value``);
    rows that lack the label or one of the columns are left out.
    """
    columns: list[str] = []
    nodes: list[dict] = []

    def place(rule: dict | None, reach) -> int:
        number = len(nodes)
        node = {"reach": reach, "feature": -1, "threshold": None, "left": -1, "right": -1}
        nodes.append(node)
        if rule is not None:
            if rule["column"] not in columns:
                columns.append(rule["column"])
            low = F.col(rule["column"]) <= rule["up_to"]
            node |= {"feature": columns.index(rule["column"]), "threshold": float(rule["up_to"])}
            node["left"] = place(rule["low"], reach & low)
            node["right"] = place(rule["high"], reach & ~low)
            nodes[number] = node
        return number

    place(rules, F.lit(True))
    whole = df.dropna(subset=[label, *columns])
    measures = []
    for i, node in enumerate(nodes):
        measures.append(F.count(F.when(node["reach"], 1)).alias(f"n{i}"))
        measures.append(F.sum(F.when(node["reach"], F.col(label)).cast("double")).alias(f"s{i}"))
    counted = whole.agg(*measures).first()
    rows = []
    for i, node in enumerate(nodes):
        n = counted[f"n{i}"]
        value = counted[f"s{i}"] / n if n else 0.0
        rows.append((0, i, node["feature"], node["threshold"], None, node["left"], node["right"], value, float(n)))
    return df.sparkSession.createDataFrame(rows, NODE_SCHEMA), columns
