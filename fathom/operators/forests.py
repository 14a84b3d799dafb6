"""Random forests over many rows, from histograms that the tasks make of whole blocks of rows.

It is the algorithm of Spark's learner: thresholds from the quantiles of a sample, every row in every
tree as often as a Poisson draw says, some features drawn for each node, the split with the largest
gain, all trees a level at a time. Spark walks row by row through objects of the heap; here a block
of rows is an array of bytes, and a level of a tree takes a few array operations over it.

A block holds for each row and feature the number of the interval the value lies in, together with
the row's class, in one byte or two. A task adds up, for each tree, a table by open node, drawn
feature, interval and class; tables are summed by tree, and only the best split of each node comes
to the driver. Rows find their node from the top again on each level, and their draws again from
the block's number, so nothing is kept between levels. Counts are whole numbers: the model does
not depend on the order in which they are added up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.sources.scratch import scratch_path
from fathom.sources.shipping import ship

# Rows of a block, and those that take their steps through a tree together.
BLOCK_ROWS = 131_072
STEP_ROWS = 16_384
# A learner samples so many rows, or the square of its intervals, to find thresholds.
SAMPLED_ROWS = 10_000
NODE_SCHEMA = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
    "rawCount: bigint, gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def supports(classifier: RandomForestClassifier, vectors: DataFrame) -> bool:
    """Whether ``fit_forest`` knows all settings and kinds of features; what it lacks is left to Spark."""
    usual = {"featureSubsetStrategy": "auto", "impurity": "gini", "subsamplingRate": 1.0, "bootstrap": True}
    usual |= {"minWeightFractionPerNode": 0.0}
    chosen = {p.name: v for p, v in classifier.extractParamMap().items()}
    attributes = vectors.schema[chosen["featuresCol"]].metadata.get("ml_attr", {}).get("attrs", {})
    return (
        all(chosen[name] == value for name, value in usual.items())
        and not classifier.isSet("weightCol")
        and not classifier.isSet("thresholds")
        and set(attributes) <= {"numeric"}
        and chosen["maxBins"] <= 1024
    )


def thresholds(values: np.ndarray, intervals: int) -> np.ndarray:
    """Borders between at most ``intervals`` intervals of about the same number of sampled values."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) < intervals:
        return between
    stride = len(values) / intervals
    chosen, target, seen = [], stride, np.cumsum(counts)
    for i in range(1, len(distinct)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            chosen.append(between[i - 1])
            target += stride
    return np.array(chosen)


def _poisson_cuts() -> np.ndarray:
    """``draw >= cuts[k]`` for 32-bit draws: a Poisson number of mean 1 is above k."""
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
    return (below * 2**32).astype(np.uint64).clip(max=2**32 - 1).astype(np.uint32)


CUTS = _poisson_cuts()


def times_drawn(seed: int, tree: int, block: tuple[int, int], rows: int) -> np.ndarray:
    """How often a tree has each row of a block; the same on every call."""
    rng = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFFFFFFFFFF, tree, *block]))
    draw = rng.integers(0, 2**32, rows, dtype=np.uint32)
    times = (draw >= CUTS[0]).astype(np.uint8)
    for cut in CUTS[1:3]:
        times += draw >= cut
    often = np.flatnonzero(times == 3)
    for cut in CUTS[3:]:
        often = often[draw[often] >= cut]
        times[often] += 1
    return times


@dataclass
class Tree:
    """Nodes by number; a child has a higher number than its parent, a right child follows its left one."""

    feature: list[int] = field(default_factory=lambda: [-1])
    interval: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    counts: list[list[float]] = field(default_factory=lambda: [[]])
    open: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, interval: int, gain: float, sides: tuple[list, list]) -> int:
        """Give a node two leaves and return the number of the left one."""
        first = len(self.feature)
        self.feature[node], self.interval[node], self.left[node], self.gain[node] = feature, interval, first, gain
        for i, counts in enumerate(sides):
            self.feature.append(-1)
            self.interval.append(-1)
            self.left.append(first + i)
            self.gain.append(-1.0)
            self.counts.append(counts)
        return first


def _drawn_features(seed: int, tree: int, level: int, nodes: int, features: int, some: int) -> np.ndarray:
    rng = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFFFFFFFFFF, tree, level, features]))
    return rng.random((nodes, features)).argsort(axis=1)[:, :some]


@dataclass(frozen=True)
class _Search:
    """What a task must know of a tree to count a level: steps to a node and features of open nodes."""

    # A node's feature, the code from which a row goes right (more than any code in a leaf) and its
    # left child, in one number.
    step: np.ndarray
    # Number of an open node, -1 for others.
    place: np.ndarray
    # Drawn features (how many of them, open node).
    drawn: np.ndarray
    depth: int


def _searches(trees: list[Tree], level: int, seed: int, features: int, some: int, classes: int) -> list[_Search]:
    made = []
    for t, tree in enumerate(trees):
        place = np.full(len(tree.feature), -1)
        place[tree.open] = np.arange(len(tree.open))
        drawn = _drawn_features(seed, t, level, len(tree.open), features, some)
        feature = np.array(tree.feature)
        cut = np.where(feature >= 0, (np.array(tree.interval) + 1) * classes, 0xFFFF)
        step = np.maximum(feature, 0) | cut << 16 | np.array(tree.left) << 32
        made.append(_Search(step, place, np.ascontiguousarray(drawn.T), level))
    return made


def _add_block(codes: np.ndarray, times: np.ndarray, search: _Search, wide: int, table: np.ndarray) -> None:
    """Add the rows of a block to a tree's table (open node, drawn feature, code).

    Rows take their steps a few thousand at a time, so that their numbers stay in a core's cache.
    """
    features, cells = codes.shape[1], codes.ravel()
    # Places are within range; "clip" spares a check of each.
    take = partial(np.take, mode="clip")
    rows = np.flatnonzero(times)
    # Small tables are added to at once; for large ones the numbers of the whole block are kept.
    held = STEP_ROWS if len(table) * wide <= STEP_ROWS else len(rows)
    index, weight, kept = np.empty((len(search.drawn), held), np.intp), np.empty(held), 0

    def count(n: int) -> None:
        for j in range(len(search.drawn)):
            found = np.bincount(index[j, :n], weight[:n], len(table) * wide)
            table[:, j] += found.reshape(len(table), wide).astype(table.dtype)

    for begin in range(0, len(rows), STEP_ROWS):
        some = rows[begin : begin + STEP_ROWS]
        at, node = some * features, np.zeros(len(some), np.intp)
        for _ in range(search.depth):
            step = take(search.step, node)
            code = take(cells, at + (step & 0xFFFF))
            node = (step >> 32) + (code >= (step >> 16 & 0xFFFF))
        place = take(search.place, node)
        open_ = place >= 0
        if not open_.all():
            some, at, place = some[open_], at[open_], place[open_]
        upto = slice(kept, kept + len(some))
        weight[upto] = take(times, some)
        base = place * wide
        for j, drawn in enumerate(search.drawn):
            np.add(base, take(cells, at + take(drawn, place)), out=index[j, upto])
        kept += len(some)
        if held == STEP_ROWS:
            count(kept)
            kept = 0
    count(kept)


def _gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, 1 - (counts**2).sum(-1) / n**2, 0.0)


def best_splits(table: np.ndarray, min_rows: int, min_gain: float) -> np.ndarray:
    """For each node of a table (node, feature, interval, class) a row: place of the feature, interval, gain,
    class counts of the node and of its left side. The gain is -inf where no split is allowed."""
    left = table.cumsum(axis=2, dtype=float)
    total = left[:, :, -1:]
    left = left[:, :, :-1]
    right = total - left
    n, n_left, n_right = total.sum(-1), left.sum(-1), right.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _gini(total) - (n_left / n) * _gini(left) - (n_right / n) * _gini(right)
    allowed = (n_left >= min_rows) & (n_right >= min_rows) & (gain >= min_gain)
    gain = np.where(allowed, gain, -np.inf).reshape(len(table), -1)
    best = gain.argmax(axis=1)
    nodes = np.arange(len(table))
    sides = left.reshape(len(table), -1, table.shape[-1])[nodes, best]
    of, interval = np.divmod(best, left.shape[2])
    return np.column_stack([of, interval, gain[nodes, best], total[:, 0, 0], sides])


def _blocks(vectors: DataFrame, features: str, label: str, borders: list[np.ndarray], classes: int) -> DataFrame:
    """(part, block, codes): blocks of rows, a code for each row and feature."""
    kind = np.uint8 if (max(map(len, borders)) + 1) * classes <= 256 else np.uint16

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        part, made = 0, 0

        def block() -> pa.RecordBatch:
            cells = np.concatenate(held)
            columns = [pa.array([v]) for v in (part, made, cells.tobytes())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "codes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["part"][0].as_py()
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, len(borders))
            y = batch["y"].to_numpy().astype(np.int64)
            codes = np.empty(x.shape, kind)
            for f, edges in enumerate(borders):
                codes[:, f] = np.searchsorted(edges, x[:, f], "left") * classes + y
            held.append(codes)
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield block()
                held, made = [], made + 1
        if held:
            yield block()

    rows = vectors.select(
        F.spark_partition_id().cast("bigint").alias("part"),
        vector_to_array(features).alias("x"),
        F.col(label).cast("double").alias("y"),
    )
    return rows.mapInArrow(coded, "part bigint, block bigint, codes binary")


def _level(
    blocks: DataFrame, searches: list[_Search], seed: int, features: int, bins: int, classes: int, limits: tuple
) -> dict[int, np.ndarray]:
    """``best_splits`` of every tree that has open nodes."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(searches)
    wide = bins * classes
    kind = np.uint8 if wide <= 256 else np.uint16

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, number, raw in zip(*(batch[c] for c in ("part", "block", "codes"))):
                codes = np.frombuffer(raw.as_buffer(), kind).reshape(-1, features)
                for t, search in enumerate(trees):
                    if not search.drawn.size:
                        continue
                    if t not in tables:
                        tables[t] = np.zeros((*search.drawn.shape[::-1], wide), np.int32)
                    times = times_drawn(seed, t, (part.as_py(), number.as_py()), len(codes))
                    _add_block(codes, times, search, wide, tables[t])
        for t in list(tables):
            columns = [pa.array([t], pa.int32()), pa.array([tables.pop(t).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "found"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for tree, raw in zip(batch["tree"].to_pylist(), batch["found"]):
                part = np.frombuffer(raw.as_buffer(), np.int32)
                if tree in tables:
                    tables[tree] += part
                else:
                    tables[tree] = part.astype(np.int64)
        for tree, table in tables.items():
            shape = (*shared.value[tree].drawn.shape[::-1], bins, classes)
            best = best_splits(table.reshape(shape), *limits)
            columns = [pa.array([tree], pa.int32()), pa.array([best.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "found"])

    cores = spark.sparkContext.defaultParallelism
    found = blocks.coalesce(2 * cores).mapInArrow(counted, "tree int, found binary")
    try:
        # The tables of a tree meet in one task.
        rows = found.repartition(2 * cores, "tree").mapInArrow(chosen, "tree int, found binary").collect()
    finally:
        shared.unpersist()
    return {r.tree: np.frombuffer(r.found).reshape(-1, 3 + 2 * classes) for r in rows}


def _grow(tree: Tree, level: int, best: np.ndarray, drawn: np.ndarray, classes: int, depth: int) -> None:
    """Split the open nodes of a tree by their best splits and open the children that may go on."""
    next_: list[int] = []
    for node, features, row in zip(tree.open, drawn, best):
        total, left = row[3 : 3 + classes], row[3 + classes :]
        if not tree.counts[node]:
            tree.counts[node] = total.tolist()
        if not row[2] > 0:
            continue
        sides = left.tolist(), (total - left).tolist()
        first = tree.split(node, int(features[int(row[0])]), int(row[1]), float(row[2]), sides)
        if level + 1 < depth:
            # A child of one class stays a leaf.
            next_ += [first + i for i, counts in enumerate(sides) if sum(c > 0 for c in counts) > 1]
    tree.open = next_


def _stored(tree: Tree, borders: list[np.ndarray]) -> list[tuple]:
    """Nodes as Spark stores them, in order from the top; siblings that predict the same become one leaf."""
    label = [int(np.argmax(c)) for c in tree.counts]
    inner = [f >= 0 for f in tree.feature]
    for node in reversed(range(len(inner))):
        first = tree.left[node]
        if inner[node] and not inner[first] and not inner[first + 1] and label[first] == label[first + 1]:
            inner[node] = False
    rows: list[list] = []
    open_ = [(0, None, 0)]
    while open_:
        node, parent, side = open_.pop()
        number = len(rows)
        if parent is not None:
            rows[parent][6 + side] = number
        counts = tree.counts[node]
        total = sum(counts)
        impurity = 1 - sum((c / total) ** 2 for c in counts) if total else 0.0
        row = [number, float(label[node]), impurity, counts, int(total), -1.0, -1, -1, (-1, [], -1)]
        if inner[node]:
            feature, first = tree.feature[node], tree.left[node]
            row[5] = tree.gain[node]
            row[8] = (feature, [float(borders[feature][tree.interval[node]])], -1)
            open_ += [(first + 1, number, 1), (first, number, 0)]
        rows.append(row)
    return [tuple(r) for r in rows]


def fit_forest(vectors: DataFrame, classifier: RandomForestClassifier, n: int) -> RandomForestClassificationModel:
    """The forest of a classifier that ``supports`` accepts over about ``n`` rows."""
    spark = vectors.sparkSession
    ship(spark)
    features, label = classifier.getFeaturesCol(), classifier.getLabelCol()
    seed, count, depth = classifier.getSeed(), classifier.getNumTrees(), classifier.getMaxDepth()
    intervals = classifier.getMaxBins()
    share = min(1.0, max(intervals**2, SAMPLED_ROWS) / max(n, 1))
    sampled = vectors.sample(False, share, seed).select(vector_to_array(features)).collect()
    sample = np.array([r[0] for r in sampled])
    borders = [thresholds(sample[:, f], intervals) for f in range(sample.shape[1])]
    width, bins = len(borders), max(map(len, borders)) + 1
    classes = max(int(vectors.agg(F.max(label)).first()[0]) + 1, 2)
    some = math.ceil(math.sqrt(width)) if count > 1 else width
    limits = classifier.getMinInstancesPerNode(), classifier.getMinInfoGain()

    trees = [Tree() for _ in range(count)]
    blocks = _blocks(vectors, features, label, borders, classes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for level in range(depth):
            searches = _searches(trees, level, seed, width, some, classes)
            found = _level(blocks, searches, seed, width, bins, classes, limits)
            for t, best in found.items():
                _grow(trees[t], level, best, searches[t].drawn.T, classes, depth)
            if not any(tree.open for tree in trees):
                break
    finally:
        blocks.unpersist()
    return _model(vectors, classifier, [_stored(tree, borders) for tree in trees], width, classes)


def _model(
    vectors: DataFrame, classifier: RandomForestClassifier, trees: list[list[tuple]], width: int, classes: int
) -> RandomForestClassificationModel:
    """A model of Spark with the given nodes: one fitted to a row of each class gives all the rest of it."""
    spark = vectors.sparkSession
    schema = vectors.select(classifier.getFeaturesCol(), F.col(classifier.getLabelCol()).cast("double")).schema
    rows = [(Vectors.dense([float(c)] * width), float(c)) for c in range(classes)]
    shell = classifier.fit(spark.createDataFrame(rows, schema))
    path = scratch_path(spark, "forest")
    shell.write().save(path)
    nodes = [(t, node) for t, tree in enumerate(trees) for node in tree]
    spark.createDataFrame(nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
