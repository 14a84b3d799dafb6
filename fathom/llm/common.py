"""Helpers that the operators share: reading documents, shipping the package, batches of texts."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts are worked on in groups of about this many characters, whatever Spark's batch size is.
GROUP_CHARS = 4_000_000

_shipped: set[str] = set()
_kept: dict = {}


def kept(key: object, make: Callable[[], object]):
    """What ``make`` gives, once for each worker process.

    A worker runs the tasks of one operator after another. Only the last one's object stays, so
    that their memories of words do not add up.
    """
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what an earlier operator left in this worker process."""
    if _kept:
        _kept.clear()
        gc.collect()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors, once per application."""
    context: SparkContext = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, str(file.relative_to(root.parent)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fathom-code-")), "fathom_code.zip")
    Path(path).write_bytes(held.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def plain_names(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all columns but the ``used`` ones numbered, so that none meets a helper column.

    ``toDF(*docs.columns)`` gives the names back, as long as the columns keep their order.
    """
    return docs.toDF(*(c if c in used else f"c{i}" for i, c in enumerate(docs.columns)))


def crc32_of_id() -> Column:
    """crc32 of the id's decimal text; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string"))


def grouped_texts(texts: list[str | None], most: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with about ``most`` characters each; a null text is an empty one."""
    start, chars, held = 0, 0, []
    for i, text in enumerate(texts):
        held.append(text or "")
        chars += len(held[-1])
        if chars >= most:
            yield start, held
            start, chars, held = i + 1, 0, []
    if held:
        yield start, held


def with_text_column(
    docs: DataFrame, name: str, kind: str, make: Callable[[], Callable[[list[str]], list]]
) -> DataFrame:
    """Add one column computed in Python from ``text``; every other column passes through.

    ``make()`` runs once per task and returns a function from texts to values.
    """
    ship(docs.sparkSession)
    arrow = {"bigint": pa.int64(), "string": pa.string()}[kind]
    fields = [f for f in docs.columns if f != name]
    docs = docs.select(*fields)
    schema = docs.withColumn(name, F.lit(None).cast(kind)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            values: list = []
            gc.disable()  # millions of short-lived strings and no cycles among them
            for _, group in grouped_texts(texts):
                values.extend(compute(group))
            gc.enable()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(work, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> list[tuple]:
    """(label, doc_id, text) of up to ``most`` documents for each label, the same in every run.

    ``labels`` is (doc_id, label). Documents come in the order of their id's hash. A first pass
    counts each label, a second one keeps ids below a hash bound that leaves about twice as many
    as wanted; only those few rows reach the driver. Of rows that share an id the smallest text
    stands for all.
    """
    ids = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label").distinct()
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    if not counts:
        return []
    place = (F.xxhash64(F.col("doc_id"), F.lit(1)).cast("double") / float(1 << 63) + 1.0) / 2.0
    bounds = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2.0 * most + 50) / n))))
    near = ids.withColumn("_place", place).filter(F.col("_place") <= F.element_at(bounds, F.col("label")))
    taken: dict = {}
    for row in sorted(near.collect(), key=lambda r: (r["_place"], r["doc_id"])):
        held = taken.setdefault(row["label"], [])
        if len(held) < most:
            held.append(row["doc_id"])
    spark = docs.sparkSession
    chosen = spark.createDataFrame(
        [(k, i) for k, held in taken.items() for i in held],
        T.StructType(
            [
                T.StructField("_label", labels.schema["label"].dataType),
                T.StructField("doc_id", docs.schema["doc_id"].dataType),
            ]
        ),
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("_label", "doc_id").agg(F.min("text").alias("text")).collect()
    return sorted((r["_label"], r["doc_id"], r["text"] or "") for r in rows)
