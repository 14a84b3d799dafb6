"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits share at least four of their eight bytes
at the same positions. Lists of one position and value would hold 1/256 of all fingerprints each,
and tallying them pair by pair would be quadratic. The index is therefore keyed by three
positions and their bytes: 20 triples cover every set of four positions, so each pair that reaches
four shared positional bytes meets in a list, and lists are 2^24 times finer than the table.
In a list every pair's shared positional bytes are tallied, pairs with four or more are kept and
verified by counting differing bits.

Copies collapse before the index: it holds distinct fingerprints. A long list is cut into blocks
by the fingerprint's hash, and every pair of blocks is one task's small piece of work. What leaves
a piece are links that span its connected parts, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import forget, ship, with_text_column
from fathom.llm.components import connected_components
from fathom.sources.scratch import durable

SHINGLE_WORDS = 4
MAX_BITS = 4
# Fingerprints differing in MAX_BITS bits share this many of 8 positional bytes at least.
LEAST_SHARED = 8 - MAX_BITS
# A list longer than this is compared block by block.
BLOCK = 512

# Three groups of positions; triples lie in one group, or two in a group and one in the next.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of 8 positions such that every 4 positions contain one of them."""
    found = []
    for g, own in enumerate(_GROUPS):
        found.extend(combinations(own, 3))
        for pair in combinations(own, 2):
            found.extend(tuple(sorted((*pair, other))) for other in _GROUPS[(g + 1) % 3])
    return sorted(found)


def fingerprint(text: str) -> int:
    """The signed 64-bit SimHash of the text's word shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE_WORDS:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: n - SHINGLE_WORDS])).tolist()
        stops = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts)
        )
    set_ = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[start : start + 65_536])
        set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    bits = np.packbits(set_ * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """``docs`` with its fingerprint as a long; null text counts as empty, fingerprint 0."""

    def make():
        forget()
        return lambda texts: [fingerprint(t) for t in texts]

    return with_text_column(docs, name, "bigint", make)


def _positional_keys(fp: Column) -> Column:
    byte = [F.shiftright(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    return F.array(
        *(
            F.lit(n << 24)
            + F.shiftleft(byte[i], 16)
            + F.shiftleft(byte[j], 8)
            + byte[k]
            for n, (i, j, k) in enumerate(covering_triples())
        )
    )


def near(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Where two arrays of fingerprints share enough positional bytes and then differ in few bits."""
    differing = np.bitwise_xor(first, second).view(np.uint64)  # bits are counted without a sign
    shared = (np.ascontiguousarray(differing).view(np.uint8).reshape(*differing.shape, 8) == 0).sum(axis=-1)
    return (shared >= 8 - bits) & (np.bitwise_count(differing) <= bits)


def _spanning(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what is connected among ``values``, one less than a part's size."""
    near_, far = [], []
    todo = np.arange(len(values))
    while len(todo):
        wave, todo = todo[:1], todo[1:]
        while len(wave) and len(todo):
            hit = np.zeros(len(todo), bool)
            by = np.zeros(len(todo), np.int64)
            for start in range(0, len(wave), 256):
                close = near(values[todo][:, None], values[wave[start : start + 256]][None, :], bits)
                any_ = close.any(axis=1) & ~hit
                by[any_] = wave[start + close[any_].argmax(axis=1)]
                hit |= any_
            near_.append(by[hit])
            far.append(todo[hit])
            wave, todo = todo[hit], todo[~hit]
    if not near_:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return values[np.concatenate(near_)], values[np.concatenate(far)]


def _links(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list and piece; a list that goes on in the next batch is held back."""
        held = None

        def linked(table: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(table), bool)
            new[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(table)))
            run = np.repeat(np.arange(len(starts)), sizes)
            values = table[:, 2]
            a, b = [], []
            small = sizes <= 16
            for step in range(1, 16):
                at = np.flatnonzero(small[run[: len(run) - step]] & (run[step:] == run[: len(run) - step]))
                if not len(at):
                    break
                at = at[near(values[at], values[at + step], bits)]
                a.append(values[at])
                b.append(values[at + step])
            for i in np.flatnonzero(~small):
                x, y = _spanning(np.unique(values[starts[i] : starts[i] + sizes[i]]), bits)
                a.append(x)
                b.append(y)
            ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
            pairs = np.unique(np.stack([np.minimum(*ends), np.maximum(*ends)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            table = table if held is None else np.concatenate([held, table])
            if not len(table):
                continue
            last = np.flatnonzero((table[:, :2] == table[-1, :2]).all(axis=1))[0]
            held = table[last:]
            if last:
                yield linked(table[:last])
        if held is not None and len(held):
            yield linked(held)

    return work


def fingerprint_links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints; what they connect is what all near pairs connect."""
    if bits > MAX_BITS:
        raise ValueError(f"the index is made for {MAX_BITS} differing bits, not {bits}")
    ship(distinct.sparkSession)
    postings = distinct.select(
        F.explode(_positional_keys(F.col("fingerprint"))).alias("list"), "fingerprint"
    )
    sizes = postings.groupBy("list").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("bigint")
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    pieces = (
        postings.join(sizes, "list")
        .select("list", "fingerprint", blocks.alias("blocks"))
        .select("list", "fingerprint", "blocks", block.alias("block"))
        .select(
            "list",
            F.explode(
                F.expr(
                    "transform(sequence(0L, blocks - 1), o -> least(o, block) * blocks + greatest(o, block))"
                )
            ).alias("piece"),
            "fingerprint",
        )
        .repartition("list", "piece")
        .sortWithinPartitions("list", "piece")
    )
    return pieces.mapInArrow(_links(bits), "a bigint, b bigint").distinct()


def fingerprint_components(fingerprints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fingerprint, root) of every fingerprint that is linked to another one."""
    distinct = durable(fingerprints.select("fingerprint").distinct(), "fingerprints")
    found = connected_components(fingerprint_links(distinct, bits))
    return found.select(F.col("node").alias("fingerprint"), "root")


def _with_root(marked: DataFrame, bits: int) -> DataFrame:
    """``marked`` (doc_id, fingerprint, …) with ``root`` and ``component_id``.

    The smallest id is found per fingerprint and then per component, so that copies are combined
    before anything is joined.
    """
    roots = fingerprint_components(marked, bits)
    firsts = (
        marked.groupBy("fingerprint")
        .agg(F.min("doc_id").alias("first"))
        .join(roots, "fingerprint", "left")
        .withColumn("root", F.coalesce("root", "fingerprint"))
    )
    firsts = durable(firsts, "firsts")
    lowest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    known = firsts.join(lowest, "root").select("fingerprint", "root", "component_id")
    return marked.join(known, "fingerprint")


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Null or wordless texts have fingerprint zero and are linked like any other. A text of fewer
    than four words is one shingle. Repeated rows are kept. A null id never is a component's
    smallest id; a component of null ids only has a null component_id. Columns besides doc_id and
    text are not read.
    """
    marked = durable(with_fingerprint(docs.select("doc_id", "text")).drop("text"), "simhash")
    return _with_root(marked, bits).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def deduplicate(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of every group of near-duplicates stays.

    It is the row with the group's smallest id; of rows that repeat this id in the group, one. In
    a group of null ids only, one row stays as well.
    """
    if bits > MAX_BITS:
        raise ValueError(f"the index is made for {MAX_BITS} differing bits, not {bits}")
    columns = docs.columns
    marked = durable(
        with_fingerprint(docs, "_fingerprint").withColumn("_row", F.monotonically_increasing_id()),
        "marked",
    )
    rows = marked.select("_row", F.col("_fingerprint").alias("fingerprint"), "doc_id")
    kept = (
        _with_root(rows, bits)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("_row").alias("_row"))
        .select("_row")
    )
    return marked.join(kept, "_row", "left_semi").select(*columns)
