"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared without case, punctuation and line breaks. A test item may differ from a
passage by a budget of edits, a share of its length. Cut into one piece more than the budget, at
least one piece of any such passage is untouched: documents are searched for exact hits of all
pieces at once, and each hit says where its item would start. There the item is aligned by Myers'
bit-parallel distance, all of the item's rows in one machine-independent integer per text letter.

Items are the stated query set. They are numbered in Spark and brought to the executors in blocks
of bounded size, one pass over the documents for each block, whatever the number of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import forget, grouped_texts, ship
from fathom.operators.ordering import running_totals
from fathom.sources.scratch import durable

# Edits allowed per letter of an item: pieces are about 1 / ERROR_RATE letters long.
ERROR_RATE = 0.04
# Letters of all items of a block; bounds what is broadcast. A longer item is a block of its own.
BLOCK_CHARS = 4_000_000
_APART = re.compile(r"[\W_]+")


def normalized(text: str) -> str:
    """Lower case words with single spaces between them."""
    return " ".join(_APART.sub(" ", text.lower()).split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of nearly equal length with their offsets; together they are the item."""
    count = min(budget + 1, len(item))
    cuts = [len(item) * i // count for i in range(count + 1)] if count else []
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any substring of ``text``, end of the first best one)."""
    size = len(pattern)
    if not size:
        return 0, 0
    places: dict[str, int] = {}
    for i, letter in enumerate(pattern):
        places[letter] = places.get(letter, 0) | 1 << i
    full, last = (1 << size) - 1, 1 << (size - 1)
    more, less, score = full, 0, size
    best, end = size, 0
    for i, letter in enumerate(text):
        same = places.get(letter, 0)
        vertical = same | less
        across = (((same & more) + more) ^ more) | same
        up = less | (full & ~(across | more))
        down = more & across
        score += 1 if up & last else -1 if down & last else 0
        up, down = up << 1 & full, down << 1 & full
        more, less = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


def _stands_alone(text: str, start: int, stop: int) -> bool:
    """Is the stretch no part of longer words?"""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    after = stop < len(text) and text[stop].isalnum() and text[stop - 1].isalnum()
    return not (before or after)


class Searcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate)) for i, t in ((i, normalized(t)) for i, t in items) if t]
        of: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                of.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, wanted in of.items():
            self.automaton.add_word(piece, (len(piece), wanted))
        if of:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(item's place in the block, distance, end in the normalized text), best match of each item."""
        if not self.items:
            return []
        text = normalized(text)
        starts: dict[int, set[int]] = {}
        for end, (size, wanted) in self.automaton.iter(text):
            for n, offset in wanted:
                start = end + 1 - size - offset
                if self.items[n][2] or _stands_alone(text, start, start + len(self.items[n][1])):
                    starts.setdefault(n, set()).add(start)
        found = []
        for n, places in sorted(starts.items()):
            _, item, budget = self.items[n]
            best, at = budget + 1, 0
            # Overlapping places are searched together: each letter is aligned once per item.
            spans: list[list[int]] = []
            for start in sorted(places):
                low, high = max(0, start - budget), start + len(item) + budget
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            for low, high in spans:
                distance, end = myers(item, text[low:high])
                if distance < best:
                    best, at = distance, low + end
            if best <= budget:
                found.append((n, best, at))
        return found


def _search(items, rate: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        block = items.value
        searcher = Searcher(block, rate)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for start, group in grouped_texts(texts):
                for i, text in enumerate(group, start):
                    rows.extend((ids[i], searcher.items[n][0], d, end) for n, d, end in searcher(text))
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "distance", "end"])

    return work


def _keep_clean(items, rate: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        searcher = Searcher(items.value, rate)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            clean = [not searcher(text) for _, group in grouped_texts(texts) for text in group]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return work


def _blocks(benchmark: DataFrame) -> Iterator:
    """The items, block by block, as broadcasts of bounded size."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    placed = running_totals(items, ["item_id", "text"], {"chars": F.char_length("text").cast("bigint")})
    block = F.floor((F.col("chars") - F.char_length("text")) / BLOCK_CHARS)
    placed = placed.withColumn("block", block.cast("bigint"))
    last = placed.agg(F.max("block")).first()[0]
    for number in range(0 if last is None else last + 1):
        rows = placed.filter(F.col("block") == number).select("item_id", "text").collect()
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, end) for every document that holds a test item.

    One row per document row and item: the least number of edits and where the first such passage
    ends in the normalized text. Items and texts that are null or have no word match nothing; an
    item shorter than 1 / ``error_rate`` letters must appear exactly, as whole words. Items that repeat are found
    under each of their ids, rows that repeat a document each give their matches; items without an
    id are not searched for, documents without one keep their null. Columns besides doc_id, text
    and item_id, text are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text IS NOT NULL")
    found = None
    for shared in _blocks(benchmark):
        part = texts.mapInArrow(
            _search(shared, error_rate), "doc_id bigint, item_id bigint, distance bigint, end bigint"
        )
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "doc_id bigint, item_id bigint, distance bigint, end bigint")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item.

    Rows are judged by themselves, not by id: of rows that share a doc_id only those with a
    passage go. One pass over the documents for each block of items, without a shuffle; what a
    pass keeps is written before the next one, so that a task holds one block at a time.
    """
    ship(docs.sparkSession)
    kept, before = docs, 0
    for shared in _blocks(benchmark):
        kept = durable(kept, "clean") if before else kept
        kept = kept.mapInArrow(_keep_clean(shared, error_rate), docs.schema)
        before += 1
    return kept
