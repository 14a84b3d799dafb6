"""The prefix trie of conversations with figures rolled up over its subtrees.

A node is a sequence of first turns that some conversation starts with. Sequences are compared by
sums of hashes of (place, role, text): a sum over a prefix grows turn by turn, so one pass over
sorted turns gives every prefix of every conversation its key, and a conversation of any length is
spread over tasks.

Rollup is by centroid decomposition of the forest of parent edges. In every component the centroid
is the deepest node whose subtree has at least half of the component's weight. It is taken out:
the total of its part of the component becomes its own result and is added to all nodes on the path
from it to the component's top, whose subtrees hold it; what is left falls apart into the upper part
and one part below each child, each of at most half the weight. Components halve, so rounds grow
with the logarithm of the rows, however deep the trie is. A node's weight is the number of
conversations through it, so a subtree's first weight needs no rollup: it is the number of turns
that its members have from its top on.

Rounds over components with more than ``component_rows`` weight are joins and aggregates; smaller
ones are gathered, many in a task, and go through the same rounds as arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import ship
from fathom.sources.scratch import durable

# Conversations of a group of five share first turns; how many follows from the id.
GROUP, MOST_SHARED = 5, 9
# Weight up to which a component is worked on inside one task.
COMPONENT_ROWS = 10_000
# Rows of components gathered for one pass over arrays.
BATCH_ROWS = 100_000
_PARTS = ["s0", "s1", "s2", "s3"]
_LOW = 0xFFFFFFFF


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, pos (from 1), turn_hash, bytes of ``turns`` (conv_id, turn, role, text).

    Turns are in the order of turn, null first, equal ones by role, then text. Rows are range
    sorted and counted chunk by chunk, so a long conversation is spread over tasks.
    """
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    spelled = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    placed = durable(
        rows.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text").select(
            "conv_id",
            F.monotonically_increasing_id().alias("place"),
            F.sha2(spelled, 256).alias("turn_hash"),
            F.octet_length("text").cast("bigint").alias("bytes"),
        ),
        "turns",
    ).withColumn("chunk", F.shiftright("place", 33))
    held = placed.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "chunk").orderBy("place")
    return placed.join(before, ["conv_id", "chunk"]).select(
        "conv_id", "chunk", (F.col("before") + F.row_number().over(within)).alias("pos"), "turn_hash", "bytes"
    )


def rebuilt_turns(turns: DataFrame, group: int = GROUP, most_shared: int = MOST_SHARED) -> DataFrame:
    """conv_id, chunk, pos, turn_hash, bytes of every conversation c after rebuilding.

    c starts with the first h turns of conversation ``c - c % group`` (all if it has fewer, none
    if it is absent), h = crc32(c) % most_shared, and goes on with its own turns after its first
    h. ``%`` has the sign of c. A conversation without any turns left has one row with pos 0.
    """
    numbered = durable(numbered_turns(turns), "numbered")
    shared = (F.crc32(F.col("conv_id").cast("string")) % most_shared).alias("shared")
    lengths = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = lengths.select("conv_id", shared, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    firsts = numbered.filter(F.col("pos") < most_shared).select(
        F.col("conv_id").alias("base"), "pos", "turn_hash", "bytes"
    )
    taken = convs.join(firsts, "base").filter(F.col("pos") <= F.col("shared"))
    from_base = taken.select("conv_id", F.lit(-1).cast("bigint").alias("chunk"), "pos", "turn_hash", "bytes")
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    # As many turns come from the base as it has, h at most.
    shifts = convs.join(bases, "base", "left").select(
        "conv_id", "shared", F.least("shared", F.coalesce("base_turns", F.lit(0))).alias("given")
    )
    own = numbered.join(shifts, "conv_id").filter(F.col("pos") > F.col("shared"))
    from_own = own.select(
        "conv_id", "chunk", (F.col("pos") - F.col("shared") + F.col("given")).alias("pos"), "turn_hash", "bytes"
    )
    start = lengths.select(
        "conv_id",
        F.lit(-2).cast("bigint").alias("chunk"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit("").alias("turn_hash"),
        F.lit(0).cast("bigint").alias("bytes"),
    )
    return start.unionByName(from_base).unionByName(from_own)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, bytes, last (is it the whole conversation), rest (turns from here on, itself
    included), s0 to s3 (sums that name the prefix) and b0 to b3 (those of the prefix before)."""
    one, two = F.xxhash64("turn_hash", "pos"), F.xxhash64("pos", "turn_hash", F.lit(7))
    halves = [one.bitwiseAND(_LOW), F.shiftrightunsigned(one, 32), two.bitwiseAND(_LOW), F.shiftrightunsigned(two, 32)]
    starts = F.col("pos") == 0
    hashed = rebuilt.select(
        "conv_id", "chunk", "pos", "bytes", *(F.when(starts, 0).otherwise(h).alias(p) for p, h in zip(_PARTS, halves))
    )
    hashed = durable(hashed, "rebuilt")
    held = hashed.groupBy("conv_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(p).alias(p) for p in _PARTS)
    )
    of_conv = Window.partitionBy("conv_id")
    earlier = of_conv.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(
        "conv_id",
        "chunk",
        F.sum("n").over(of_conv).alias("rows"),
        *(F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"before_{p}") for p in _PARTS),
    )
    within = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.join(before, ["conv_id", "chunk"]).withColumns(
        {f"sum_{p}": F.sum(p).over(within) + F.col(f"before_{p}") for p in _PARTS}
    )
    return sums.select(
        "conv_id",
        F.col("pos").alias("depth"),
        "bytes",
        (F.col("pos") == F.col("rows") - 1).alias("last"),
        (F.col("rows") - F.col("pos")).alias("rest"),
        *(F.col(f"sum_{p}").alias(p) for p in _PARTS),
        *((F.col(f"sum_{p}") - F.col(p)).alias(f"b{i}") for i, p in enumerate(_PARTS)),
    )


def _ends(rows: DataFrame) -> DataFrame:
    """depth, s0 to s3, ends_sha256 of nodes at which conversations end.

    Ids are range sorted by node and id and joined to one text for each node and partition; these
    few pieces of a node are then hashed one after another, without being held together.
    """
    key = ["depth", *_PARTS]
    ends = rows.filter("last").select(*key, "conv_id")
    placed = ends.repartitionByRange(*key, "conv_id").withColumn("piece", F.spark_partition_id())
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = placed.groupBy(*key, "piece").agg(F.array_join(ids, ",").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for *node, _, text in zip(*columns):
                if node != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            yield _batch(out)
        if at is not None:
            yield _batch([(*at, digest.hexdigest())])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * len(key) + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=[*key, "ends_sha256"]
        )

    schema = ", ".join(f"{k} bigint" for k in key) + ", ends_sha256 string"
    together = pieces.repartition(*key).sortWithinPartitions(*key, "piece")
    return together.mapInArrow(work, schema)


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row for each node of ``prefixes``: conv_id, depth, parent_conv_id, n_convs, n_children,
    weight, leaves and saved (its own), ends_sha256. (conv_id, depth) names a node."""
    key = ["depth", *_PARTS]
    grouped = rows.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum("rest").alias("weight"),
        F.min("bytes").alias("bytes"),
        *(F.min(f"b{i}").alias(f"b{i}") for i in range(len(_PARTS))),
    )
    grouped = durable(grouped.join(_ends(rows), key, "left"), "nodes")
    children = (
        grouped.filter("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), *(F.col(f"b{i}").alias(p) for i, p in enumerate(_PARTS)))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    counted = durable(grouped.join(children, key, "left"), "nodes")
    parents = counted.select(
        (F.col("depth") + 1).alias("depth"),
        *(F.col(p).alias(f"b{i}") for i, p in enumerate(_PARTS)),
        F.col("conv_id").alias("parent_conv_id"),
    )
    joined = counted.filter("depth > 0").join(parents, ["depth", *(f"b{i}" for i in range(len(_PARTS)))])
    root = counted.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    empty = F.sha2(F.lit(""), 256)
    return root.unionByName(joined).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "weight",
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
        *_PARTS,
    )


# --- rollup -----------------------------------------------------------------------------------


def decompose(
    parent: np.ndarray, weight: np.ndarray, values: list[np.ndarray]
) -> list[np.ndarray]:
    """Sums of each of ``values`` over the subtree of every node of a forest.

    ``parent`` is a row or -1; ``weight`` the total of positive weights of a node's subtree. All
    components go through their rounds together.
    """
    parent, weight = parent.copy(), weight.copy()
    up = parent.copy()  # for paths; ``parent`` is cut where a component ends
    totals = [np.zeros(len(parent), v.dtype) for v in values]
    alive = np.arange(len(parent))
    while len(alive):
        # The top of a node's component, by doubling.
        top = np.arange(len(parent))
        top[alive] = np.where(parent[alive] >= 0, parent[alive], alive)
        while True:
            further = top[top[alive]]
            if (further == top[alive]).all():
                break
            top[alive] = further
        half = alive[2 * weight[alive] >= weight[top[alive]]]
        half = half[np.lexsort((weight[half], top[half]))]
        first = np.ones(len(half), bool)
        first[1:] = top[half[1:]] != top[half[:-1]]
        centroid = half[first]
        centroid_of = np.full(len(parent), -1)
        centroid_of[top[centroid]] = centroid
        # Below the centroid: nodes whose walk upwards meets it. Cut it out and look at the tops.
        cut = np.zeros(len(parent), bool)
        cut[centroid] = True
        rest = alive[~cut[alive]]
        child = rest[(parent[rest] >= 0) & cut[parent[rest]]]
        parent[child] = -1
        part = np.arange(len(parent))
        part[rest] = np.where(parent[rest] >= 0, parent[rest], rest)
        while len(rest):
            further = part[part[rest]]
            if (further == part[rest]).all():
                break
            part[rest] = further
        below = np.zeros(len(parent), bool)
        below[child] = True
        under = rest[below[part[rest]]]
        gained = []
        for value, total in zip(values, totals):
            gain = value.copy()
            # Totals of the parts below, added up at their centroid.
            np.add.at(gain, up[part[under]], value[under])
            total[centroid] += gain[centroid]
            gained.append(gain)
        # Along the paths from the centroids to their tops, all components in step.
        source, at = centroid, parent[centroid]
        while True:
            on = at >= 0
            source, at = source[on], at[on]
            if not len(at):
                break
            for total, gain in zip(totals, gained):
                total[at] += gain[source]
            weight[at] -= weight[source]
            at = parent[at]
        alive = rest
    return totals


def _rollup_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole components one after another; a batch may end inside one."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(len(t) for t in held) >= BATCH_ROWS:
            table = pa.concat_tables(held).combine_chunks()
            tops = np.stack([table[c].to_numpy() for c in ("top_conv", "top_depth")])
            changes = np.flatnonzero((tops[:, 1:] != tops[:, :-1]).any(axis=0)) + 1
            if len(changes):
                yield _rolled(table.slice(0, changes[-1]))
                held = [table.slice(changes[-1])]
            else:
                held = [table]
    if held:
        table = pa.concat_tables(held)
        if len(table):
            yield _rolled(table)


def _rolled(table: pa.Table) -> pa.RecordBatch:
    columns = {n: table[n].to_numpy() for n in ("conv_id", "depth", "weight", "leaves", "saved", "top_conv", "top_depth")}
    parents = table["parent_conv_id"].fill_null(-1).to_numpy()
    # A node's parent stands in the same component, but for the top.
    order = np.lexsort((columns["conv_id"], columns["depth"]))
    keys = np.stack([columns["depth"][order], columns["conv_id"][order]])
    pairs = np.zeros(len(table), [("depth", np.int64), ("conv", np.int64)])
    pairs["depth"], pairs["conv"] = keys
    wanted = np.zeros(len(table), pairs.dtype)
    wanted["depth"], wanted["conv"] = columns["depth"] - 1, parents
    at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
    top = (columns["conv_id"] == columns["top_conv"]) & (columns["depth"] == columns["top_depth"])
    parent = np.where(~top & (pairs[at] == wanted), order[at], -1)
    leaves, saved = decompose(parent, columns["weight"], [columns["leaves"], columns["saved"]])
    done = [
        columns["conv_id"],
        columns["depth"],
        leaves + table["extra_leaves"].to_numpy(),
        saved + table["extra_saved"].to_numpy(),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in done], names=["conv_id", "depth", "n_leaves", "saved_tokens"])


_STATE = ["conv_id", "depth", "parent_conv_id", "weight", "leaves", "saved", "extra_leaves", "extra_saved", "top_conv", "top_depth"]
_TOP = ["top_conv", "top_depth"]


def rollup(nodes: DataFrame, names: DataFrame, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: sums over the subtree of each of ``nodes``.

    ``names`` (member, depth, conv_id) gives the node that a conversation passes at a depth, for
    at least the conversations that name nodes: it leads from a node to any node above it.
    """
    root = nodes.filter("depth = 0").first()
    state = nodes.withColumns(
        {
            "extra_leaves": F.lit(0).cast("bigint"),
            "extra_saved": F.lit(0).cast("bigint"),
            "top_conv": F.lit(root["conv_id"] if root else 0).cast("bigint"),
            "top_depth": F.lit(0).cast("bigint"),
        }
    ).select(*_STATE)
    finished: list[DataFrame] = []
    small: list[DataFrame] = []
    while True:
        sizes = durable(state.groupBy(*_TOP).agg(F.max("weight").alias("size")), "component-sizes")
        large = sizes.filter(F.col("size") > component_rows)
        if large.isEmpty():
            small.append(state)
            break
        sized = durable(state.join(sizes, _TOP), "components")
        small.append(sized.filter(F.col("size") <= component_rows).select(*_STATE))
        open_ = sized.filter(F.col("size") > component_rows)
        # Only one node of each weight on the way down has half of a component: the lightest.
        centroids = (
            open_.filter(2 * F.col("weight") >= F.col("size"))
            .groupBy(*_TOP)
            .agg(F.min_by(F.struct("conv_id", "depth", "weight"), "weight").alias("c"))
            .select(*_TOP, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"))
        )
        centroids = durable(centroids, "centroids")
        # Below a centroid: the node passed one step under its depth is one of its children.
        step = names.select(
            F.col("member").alias("conv_id"), F.col("depth").alias("c_step"), F.col("name").alias("child"), F.col("above").alias("child_parent")
        )
        marked = open_.drop("size").join(centroids, _TOP).withColumn("c_step", F.col("c_depth") + 1)
        deeper = F.col("depth") > F.col("c_depth")
        tested = marked.filter(deeper).join(step, ["conv_id", "c_step"], "left")
        under = (F.col("child_parent") == F.col("c_conv")).alias("under")
        tested = tested.select(*_STATE, "c_conv", "c_depth", "c_weight", "child", F.coalesce(under, F.lit(False)).alias("under"))
        others = marked.filter(~deeper).select(
            *_STATE, "c_conv", "c_depth", "c_weight", F.lit(None).cast("bigint").alias("child"), F.lit(False).alias("under")
        )
        marked = durable(tested.unionByName(others), "marked")
        itself = (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        gains = (
            marked.filter(F.col("under") | itself)
            .groupBy(*_TOP, "c_conv", "c_depth", "c_weight")
            .agg(F.sum("leaves").alias("gain_leaves"), F.sum("saved").alias("gain_saved"))
        )
        gains = durable(gains, "gains")
        path = (
            names.filter(F.col("depth").isNotNull())
            .join(gains.withColumnRenamed("c_conv", "member"), "member")
            .filter((F.col("depth") < F.col("c_depth")) & (F.col("depth") >= F.col("top_depth")))
            .select(F.col("name").alias("conv_id"), "depth", "c_weight", "gain_leaves", "gain_saved")
        )
        finished.append(
            marked.filter(itself).join(gains.select(*_TOP, "gain_leaves", "gain_saved"), _TOP).select(
                "conv_id",
                "depth",
                (F.col("extra_leaves") + F.col("gain_leaves")).alias("n_leaves"),
                (F.col("extra_saved") + F.col("gain_saved")).alias("saved_tokens"),
            )
        )
        left = marked.filter(~itself).drop("c_weight").join(path, ["conv_id", "depth"], "left")
        zero = F.lit(0).cast("bigint")
        state = durable(
            left.select(
                "conv_id",
                "depth",
                "parent_conv_id",
                (F.col("weight") - F.coalesce("c_weight", zero)).alias("weight"),
                "leaves",
                "saved",
                (F.col("extra_leaves") + F.coalesce("gain_leaves", zero)).alias("extra_leaves"),
                (F.col("extra_saved") + F.coalesce("gain_saved", zero)).alias("extra_saved"),
                F.when(F.col("under"), F.col("child")).otherwise(F.col("top_conv")).alias("top_conv"),
                F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            ),
            "components",
        )
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    done = rest.repartition(*_TOP).sortWithinPartitions(*_TOP).mapInArrow(
        _rollup_batches, "conv_id bigint, depth bigint, n_leaves bigint, saved_tokens bigint"
    )
    for more in finished:
        done = done.unionByName(more)
    return done


def conversation_trie(
    turns: DataFrame, group: int = GROUP, most_shared: int = MOST_SHARED, component_rows: int = COMPONENT_ROWS
) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered and rebuilt as in ``numbered_turns`` and ``rebuilt_turns``. Null roles and
    texts are empty, a null turn comes first, repeated rows are turns of their own, equal turns go
    by role and text. Rows without conv_id are left out; further columns are not read. Without
    any conversation there is no node.
    """
    ship(turns.sparkSession)
    rows = durable(prefixes(rebuilt_turns(turns, group, most_shared)), "prefixes")
    nodes = durable(trie_nodes(rows), "trie")
    key = ["depth", *_PARTS]
    names = rows.select("conv_id", *key).withColumnRenamed("conv_id", "member").join(
        nodes.select(*key, F.col("conv_id").alias("name"), F.col("parent_conv_id").alias("above")), key
    )
    names = durable(names.select("member", "depth", "name", "above"), "names")
    rolled = rollup(nodes, names, component_rows)
    return nodes.join(rolled, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


ORACLE = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda x, unused: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS own, t.p, t.role, t.text FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.p <= h.h
  UNION ALL SELECT h.c, 1, t.p, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.p > h.h),
s AS (SELECT h.c, coalesce(list({'role': role, 'text': text} ORDER BY own, p) FILTER (role IS NOT NULL), []) AS s
  FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
x AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM s),
p AS (SELECT c, n, d, s[1:d] AS k, CASE WHEN d > 0 THEN s[1:d - 1] END AS up, CASE WHEN d > 0 THEN strlen(s[d].text) ELSE 0 END AS bytes FROM x),
node AS (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n_convs, min(bytes) AS bytes,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY d, k),
kids AS (SELECT up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY up),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.k = node.k AND kids.k IS NOT NULL),
above AS (SELECT f.c, f.d, f.n_children, (f.n_convs - 1) * f.bytes AS own, p.k AS k FROM full_ f JOIN p ON p.c = f.c AND p.d <= f.d),
sums AS (SELECT k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(own) AS saved FROM above GROUP BY k)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, parent.c AS parent_conv_id, f.n_convs, f.n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_ f JOIN sums ON sums.k = f.k LEFT JOIN node parent ON f.d > 0 AND parent.k = f.up
"""
