"""Toxicity by multiple-instance learning: noisy-or over sentence scores, trained from documents.

A document is toxic if any of its sentences is. Each sentence gets a probability from the weights
of its words, each the sum of the weights of the word and its first letters; the document's is one minus the product of the sentences' complements. Training
fits the word weights to document labels alone, by proximal gradient steps that leave words
without evidence at zero. The same sentence scores then locate the offending sentences.

The model is fitted on a bounded sample of labelled documents (``SAMPLE`` for each label) on the
driver and is a dictionary of the words and beginnings with a weight. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import crc32_of_id, grouped_texts, labelled_sample, ship

# Documents of each label that the model is fitted on, at most; whole texts.
SAMPLE = 2000
# Documents of the sample that a word or beginning must appear in to get a weight.
LEAST_DOCUMENTS = 3
BEGINNINGS = (3, 4, 5)
STEPS = 200
RATE = 0.5
SPARSITY = 3e-4
FIRST_BIAS = -7.0
# Words whose weight a worker remembers.
REMEMBERED = 400_000
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = (".", "!", "?", "\n")


def features(word: str) -> list[str]:
    """The word itself and its beginnings, marked so that they are no words."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


class _Known(dict):
    """Weights of words, summed up when first asked for."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(dict.fromkeys(_ENDS, np.inf))
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(_ENDS, np.inf))
        get = self.weights.get
        value = self[word] = sum(get(f, 0.0) for f in features(word))
        return value


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def sentences(self, text: str) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(probability of each sentence with a word, tokens, token's sentence or -1 for an end)."""
        tokens = _TOKEN.findall(text.lower())
        values = np.array(list(map(self._known.__getitem__, tokens)), np.float64)
        ends = np.isinf(values)
        which = np.cumsum(ends)
        which[ends] = -1
        words = ~ends
        used, which[words] = np.unique(which[words], return_inverse=True)
        logits = np.bincount(which[words], values[words], len(used)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -40, 40))), tokens, which

    def __post_init__(self):
        self._known = _Known(self.weights)

    def score(self, text: str) -> float:
        found, _, _ = self.sentences(text)
        return float(-np.expm1(np.log1p(-np.minimum(found, 1 - 1e-12)).sum()))


def fit(rows: list[tuple[str, int]], steps: int = STEPS) -> Model:
    """The model of (text, label 0 or 1) rows; without both labels every weight is zero."""
    labels = np.array([y for _, y in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        return Model({}, FIRST_BIAS)
    tokens = [_TOKEN.findall(t.lower()) for t, _ in rows]
    place: dict[str, int] = {}
    in_documents: dict[str, int] = {}
    sentence, word, document = [], [], []
    for d, held in enumerate(tokens):
        for feature in {f for w in set(held) if w not in _ENDS for f in features(w)}:
            in_documents[feature] = in_documents.get(feature, 0) + 1
        new = True
        for token in held:
            if token in _ENDS:
                new = True
                continue
            if new:
                document.append(d)
                new = False
            sentence.append(len(document) - 1)
            word.append(place.setdefault(token, len(place)))
    names = sorted(f for f, n in in_documents.items() if n >= LEAST_DOCUMENTS)
    number = {f: i for i, f in enumerate(names)}
    pairs = [(w, number[f]) for token, w in place.items() for f in features(token) if f in number]
    of_word, feature = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    sentence, word, document = (np.array(x, np.int64) for x in (sentence, word, document))
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    theta, bias = np.zeros(len(names)), FIRST_BIAS
    moment = np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        by_type = np.bincount(of_word, theta[feature], len(place))
        logit = bias + np.bincount(sentence, by_type[word], len(document))
        p = 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))
        none = np.exp(np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), len(rows)))
        any_ = np.maximum(1 - none, 1e-12)
        by_doc = share * np.where(labels == 1, -none / any_, 1.0)
        by_sentence = by_doc[document] * p
        by_type = np.bincount(word, by_sentence[sentence], len(place))
        gradient = np.append(np.bincount(feature, by_type[of_word], len(names)), by_sentence.sum())
        # All weights move in proportion to their gradient, the fastest by RATE: what few documents
        # speak for stays slow and below the threshold.
        moment = 0.8 * moment + 0.2 * gradient
        move = RATE * (1 - step / (steps + 1)) / max(np.abs(moment).max(), 4 * SPARSITY)
        theta = theta - move * moment[:-1]
        theta = np.sign(theta) * np.maximum(np.abs(theta) - move * SPARSITY, 0)
        bias -= move * moment[-1]
    kept = np.flatnonzero(theta)
    return Model({names[i]: float(theta[i]) for i in kept}, float(bias))


def held_out():
    """Whether a row is kept from learning: a fifth of the ids, and rows without an id."""
    return F.coalesce(F.pmod(crc32_of_id(), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on documents that have a label (``labels``: doc_id, toxic) and are not held out.

    A document with several labels is toxic if one of them says so; null labels say nothing.
    """
    known = (
        labels.filter(~held_out() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("label"))
    )
    return fit([(text, label) for label, _, text in labelled_sample(docs, known, sample)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null, empty or wordless text has no sentence and scores 0. Rows that repeat a doc_id are
    scored each; a null id counts as held out. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = [own.score(t) for _, ts in grouped_texts(batch.column(2).to_pylist()) for t in ts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"]
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, words, score) of sentences that score at least ``least`` on their own."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, tokens, which = own.sentences(text or "")
                for i in np.flatnonzero(found >= least).tolist():
                    out.append((doc_id, i, " ".join(tokens[j] for j in np.flatnonzero(which == i)), found[i]))
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.float64())
            columns = [pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sentence", "words", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, sentence int, words string, score double"
    )
