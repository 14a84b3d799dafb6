"""Near-duplicates by Jaccard likeness of five-word shingles, found through a wide SimHash.

Two texts are near-duplicates when they share at least ``LEAST`` of their distinct shingles. Their
64-bit SimHashes then differ in about ten bits, too many for an index of few keys. A text
therefore has a SimHash of eight 64-bit words. The index is keyed by two neighbouring bytes and
their position, in a ring of 64 bytes: at a likeness of 0.8 a byte is shared with a chance of 0.27,
and some two neighbours are in 98% of the pairs, in more than 99.7% from 0.85. In a list the first
two words of every pair are compared; ``MAX_BITS`` of their 128 bits may differ, which is mean
and 3.6 standard deviations at 0.8. This gives coarse groups. Within them every pair counts: the
shingles are compared themselves, and what is linked has the likeness asked for.

Texts with the same shingles collapse before the index. Long lists and large groups are cut into
blocks by hash, every pair of blocks is one small piece of work, and links that span a piece's
connected parts leave it, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import forget, grouped_texts, plain_names, ship
from fathom.llm.components import connected_components
from fathom.sources.scratch import durable

SHINGLE_WORDS = 5
LEAST = 0.8
WORDS = 8
# Of the 128 bits of two words.
MAX_BITS = 34
# Lists and groups longer than this are compared block by block.
BLOCK = 512
GROUP_BLOCK = 256


def shingles(text: str) -> np.ndarray:
    """Ascending hashes of the distinct shingles; a text of fewer words is one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE_WORDS:
        return np.array([digest(joined, 43)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - SHINGLE_WORDS])).tolist()
    stops = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
    hashes = (digest(joined[a:b], 43) for a, b in zip(starts, stops))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` independent hashes of each one (splitmix64)."""
    x = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of distinct shingles as ``WORDS`` signed words."""
    set_ = np.zeros(64 * WORDS, np.int64)
    for start in range(0, len(hashes), 4096):
        part = _mixed(hashes[start : start + 4096]).view(np.uint8)
        set_ += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(set_ * 2 > len(hashes), bitorder="little").view(np.int64)


def _with_marks(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_words``, its fingerprint, and ``_set``, a digest of its shingles."""
    ship(docs.sparkSession)
    marks = [T.StructField("_words", T.ArrayType(T.LongType())), T.StructField("_set", T.LongType())]
    schema = T.StructType([*docs.schema.fields, *marks])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget()
        for batch in batches:
            prints, sets = [], []
            for _, texts in grouped_texts(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                for text in texts:
                    hashes = shingles(text)
                    prints.append(fingerprint(hashes))
                    sets.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
            columns = [
                pa.array(prints, pa.list_(pa.int64())),
                pa.array(np.array(sets, np.uint64).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, "_words", "_set"]
            )

    return docs.mapInArrow(work, schema)


def _lists(words: Column) -> Column:
    """Keys of every two neighbouring bytes and their position."""
    byte = [F.shiftright(words[i // 8], 8 * (i % 8)).bitwiseAND(F.lit(255)) for i in range(8 * WORDS)]
    return F.array(
        *(
            (F.lit(i << 16) + F.shiftleft(byte[i], 8) + byte[(i + 1) % len(byte)]).cast("int")
            for i in range(len(byte))
        )
    )


def near(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where the two words of two arrays of fingerprints differ in few bits."""
    return np.bitwise_count((first ^ second).view(np.uint64)).sum(axis=-1, dtype=np.int64) <= MAX_BITS


def spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what ``linked(one, others)`` connects among n things, one less than a part's size."""
    links = []
    todo = np.arange(n)
    while len(todo):
        wave, todo = [int(todo[0])], todo[1:]
        while wave and len(todo):
            one = wave.pop()
            hit = linked(one, todo)
            reached = todo[hit].tolist()
            links.extend((one, other) for other in reached)
            wave.extend(reached)
            todo = todo[~hit]
    return links


def _whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows sorted by their first columns, none of which breaks off within a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for c in range(keys):
            column = batch.column(c).to_numpy(zero_copy_only=False)
            same &= column == column[-1]
            if held:
                last = held[-1].column(c)[-1].as_py()
                if last != column[0]:
                    yield pa.Table.from_batches(held)
                    held = []
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if first:
            held.append(batch.slice(0, first))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of a sorted table's runs of equal keys."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in range(keys):
        column = table.column(c).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, table.num_rows))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b)]
    pairs = np.unique(np.stack([np.minimum(*ends), np.maximum(*ends)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["a", "b"]
    )


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between first words of fingerprints, from (list, piece, w0, w1)."""
    for table in _whole(batches, 2):
        starts, sizes = _runs(table, 2)
        values = np.stack([table.column(c).to_numpy() for c in (2, 3)], axis=1)
        run = np.repeat(np.arange(len(starts)), sizes)
        small = sizes <= 16
        a, b = [], []
        for step in range(1, 16):
            at = np.flatnonzero(small[run[: len(run) - step]] & (run[step:] == run[: len(run) - step]))
            if not len(at):
                break
            at = at[near(values[at], values[at + step])]
            a.append(values[at, 0])
            b.append(values[at + step, 0])
        for i in np.flatnonzero(~small):
            own = np.unique(values[starts[i] : starts[i] + sizes[i]], axis=0)
            links = spanning(len(own), lambda one, others: near(own[others], own[one]))
            a.append(own[[x for x, _ in links], 0])
            b.append(own[[y for _, y in links], 0])
        yield _pairs(a, b)


def _verified(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between nodes by their texts' likeness, from (root, piece, node, text)."""
        forget()
        for table in _whole(batches, 2):
            nodes, texts = table.column(2).to_numpy(), table.column(3)
            a, b = [], []
            for start, size in zip(*_runs(table, 2)):
                held = [shingles(t or "") for t in texts.slice(start, size).to_pylist()]
                sizes = np.fromiter(map(len, held), np.int64, len(held))
                number = np.unique(np.concatenate(held), return_inverse=True)[1]
                parts = np.split(number, np.cumsum(sizes)[:-1])
                mark = np.zeros(number.max() + 1, np.int64)

                def alike(one: int, others: np.ndarray) -> np.ndarray:
                    few, many = np.minimum(sizes[others], sizes[one]), np.maximum(sizes[others], sizes[one])
                    hit = few / many >= least
                    near_ = np.flatnonzero(hit)
                    if len(near_):
                        mark[parts[one]] = 1
                        chosen = others[near_]
                        begins = np.cumsum(sizes[chosen]) - sizes[chosen]
                        shared = np.add.reduceat(mark[np.concatenate([parts[o] for o in chosen])], begins)
                        mark[parts[one]] = 0
                        hit[near_] = shared / (sizes[chosen] + sizes[one] - shared) >= least
                    return hit

                links = spanning(len(held), alike)
                a.append(nodes[[start + x for x, _ in links]])
                b.append(nodes[[start + y for _, y in links]])
            yield _pairs(a, b)

    return work


def _in_pieces(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``blocks`` and ``block``, repeated for every ``piece`` of two blocks."""
    pieces = "transform(sequence(0L, blocks - 1), o -> least(o, block) * blocks + greatest(o, block))"
    return (
        rows.withColumn("piece", F.explode(F.expr(pieces)))
        .drop("blocks", "block")
        .repartition(key, "piece")
        .sortWithinPartitions(key, "piece")
    )


def coarse_groups(sets: DataFrame) -> DataFrame:
    """(w0, root): groups of the first words of fingerprints (_words) that are close to another one."""
    postings = sets.select(
        F.explode(_lists(F.col("_words"))).alias("list"),
        F.col("_words")[0].alias("w0"),
        F.col("_words")[1].alias("w1"),
    )
    # At most one row for each key there is, 4 million; in fact the few long ones.
    long_ = (
        postings.groupBy("list").count().filter(F.col("count") > BLOCK)
        .select("list", F.ceil(F.col("count") / BLOCK).cast("bigint").alias("blocks"))
    )
    dealt = (
        postings.join(F.broadcast(long_), "list", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
        .withColumn("block", F.pmod(F.xxhash64("w0", "w1"), F.col("blocks")))
    )
    pieces = _in_pieces(dealt, "list").select("list", "piece", "w0", "w1")
    links = pieces.mapInArrow(_coarse, "a bigint, b bigint").distinct()
    return connected_components(links).select(F.col("node").alias("w0"), "root")


def deduplicate(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of every group of near-duplicates stays.

    A group is what links of a likeness of ``least``, 0.8 or more, connect; the index is made for
    0.8 and finds fewer below. It is the row with the group's smallest id that stays; of rows that
    repeat this id, one. In a group of null ids only, one row stays as well. Null and wordless
    texts are alike.
    """
    if least < LEAST:
        raise ValueError(f"the index is made for a likeness of {LEAST} or more")
    columns = docs.columns
    docs = plain_names(docs, "doc_id", "text")
    marked = durable(_with_marks(docs).withColumn("_row", F.monotonically_increasing_id()), "marked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row"))
    sets = marked.groupBy("_words", "_set").agg(F.min(order).alias("best"))
    sets = durable(sets.withColumn("node", F.xxhash64("_words", "_set")), "sets")
    first = F.col("_words")[0].alias("w0")
    grouped = (
        sets.select("node", F.col("best")["_row"].alias("_row"), first)
        .join(coarse_groups(sets), "w0", "left")
        .select("node", "_row", F.coalesce("root", "w0").alias("root"))
    )
    grouped = durable(grouped, "grouped")
    several = grouped.groupBy("root").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / GROUP_BLOCK).cast("bigint")
    chosen = (
        grouped.join(several, "root")
        .select("root", "node", "_row", blocks.alias("blocks"))
        .withColumn("block", F.pmod("node", F.col("blocks")))
    )
    texts = chosen.join(marked.select("_row", "text"), "_row")
    pieces = _in_pieces(texts, "root").select("root", "piece", "node", "text")
    links = pieces.mapInArrow(_verified(least), "a bigint, b bigint").distinct()
    found = connected_components(links)
    kept = (
        sets.select("node", "best")
        .join(found, "node", "left")
        .groupBy(F.coalesce("root", "node"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best")["_row"].alias("_row"))
    )
    return marked.join(kept, "_row", "left_semi").select(*docs.columns).toDF(*columns)
