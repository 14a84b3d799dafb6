"""Language of every word by a linear-chain conditional random field, and of documents from it.

A word's score for a language is the sum of learned weights of its letter n-grams (those that hold
a word border are its affixes) and, for words frequent in training, of its lexicon entry; learned
transitions tie neighbouring words. Training sequences are spans of documents of different
languages put in a row, so that transitions know changes of language within a text; the labels
are those of the documents. Forward-backward gives each word's distribution, and a document's
language is the one with the largest expected share of its words.

The model is fitted on the driver on a bounded sample (``SAMPLE`` documents for each label,
from each of which up to ``TEXT_SPANS`` spans are drawn by chance from the whole text). Labelling is one pass without a shuffle over whole texts. Long
texts are cut into blocks whose transfer matrices are multiplied for all blocks at once, then
chained, so that a text of any length is exact and no loop runs over single words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import crc32_of_id, grouped_texts, kept, labelled_sample, ship

UNDETERMINED = "und"
# Documents of each label that the model is fitted on at most, and spans drawn from each whole text.
SAMPLE = 150
TEXT_SPANS = 25
# Words of a training sequence and of its spans.
SEQUENCE, SPAN = 64, 16
# Hashed n-gram weights; words of the lexicon come behind them.
BUCKETS = 1 << 16
LONGEST_GRAM = 4
LEXICON = 2000
STEPS = 40
RATE = 0.15
DECAY = 1e-4
BLOCK = 32
# Words whose scores a worker remembers.
REMEMBERED = 200_000
# Letters labelled together; bounds the arrays of a group of texts.
GROUP_CHARS = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat bucket numbers, start of each word's) of all n-grams of the words with their borders."""
    joined = "".join([f"^{w}$" for w in words])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(code))
    found = np.zeros((len(code), LONGEST_GRAM), np.int64)
    value = np.zeros(len(code), np.uint32)
    for n in range(1, LONGEST_GRAM + 1):
        shifted = np.zeros(len(code), np.uint32)
        shifted[: len(code) - n + 1] = code[n - 1 :]
        value = (value ^ shifted) * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        # An n-gram that runs over the word's end gets the last bucket, which has no weight.
        found[:, n - 1] = np.where(left >= n, (mixed >> np.uint32(16)).astype(np.int64) % (BUCKETS - 1), BUCKETS - 1)
    return found.ravel(), starts * LONGEST_GRAM


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    transitions: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words x labels), remembered by word."""
        get = self.known.get
        places = list(map(get, words))
        if None in places:
            new = sorted({w for w, p in zip(words, places) if p is None})
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                self.scores = None
                new = sorted(set(words))
            base = len(self.known)
            self.known.update((w, base + i) for i, w in enumerate(new))
            fresh = self.score_words(new)
            self.scores = fresh if self.scores is None else np.concatenate([self.scores, fresh])
            places = list(map(get, words))
        return self.scores[np.array(places)]

    def score_words(self, words: list[str]) -> np.ndarray:
        out = []
        for start in range(0, len(words), 50_000):
            part = words[start : start + 50_000]
            grams, starts = gram_features(part)
            scores = np.add.reduceat(self.weights[grams], starts, axis=0)
            entry = np.array([self.lexicon.get(w, -1) for w in part])
            scores[entry >= 0] += self.weights[entry[entry >= 0]]
            out.append(scores)
        return np.concatenate(out)

    def posteriors(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        return posteriors(self.emissions(words), np.exp(self.transitions), lengths)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def posteriors(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward-backward: each position's distribution, for texts of the given positive lengths."""
    kinds = scores.shape[1]
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    at = np.arange(len(scores)) + np.repeat(first * BLOCK - (np.cumsum(lengths) - lengths), lengths)
    emit = np.ones((total * BLOCK, kinds))
    emit[at] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    real = np.zeros(total * BLOCK, bool)
    real[at] = True
    emit, real = emit.reshape(total, BLOCK, kinds), real.reshape(total, BLOCK)

    # What each block does to the state before it.
    through = np.tile(np.eye(kinds), (total, 1, 1))
    for s in range(BLOCK):
        step = (through @ moves) * emit[:, s, None, :]
        through = np.where(real[:, s, None, None], step, through)
        through /= through.sum(axis=(1, 2), keepdims=True)

    # States before and after every block, text by text; longer texts come first.
    order = np.argsort(-blocks, kind="stable")
    before, after = np.empty((total, kinds)), np.empty((total, kinds))
    state = np.full((len(lengths), kinds), 1.0 / kinds)
    active = np.searchsorted(-blocks[order], -np.arange(1, int(blocks.max()) + 1), "right")
    for j, n in enumerate(active):
        here = first[order[:n]] + j
        before[here] = state[:n]
        state[:n] = _scaled((state[:n, None, :] @ through[here])[:, 0])
    state = np.full((len(lengths), kinds), 1.0 / kinds)
    for j in range(len(active) - 1, -1, -1):
        here = first[order[: active[j]]] + j
        after[here] = state[: active[j]]
        state[: active[j]] = _scaled((through[here] @ state[: active[j], :, None])[:, :, 0])

    result = np.empty_like(emit)
    for s in range(BLOCK):
        step = _scaled((before @ moves) * emit[:, s])
        before = np.where(real[:, s, None], step, before)
        result[:, s] = before
    for s in range(BLOCK - 1, -1, -1):
        result[:, s] *= after
        step = _scaled((emit[:, s] * after) @ moves.T)
        after = np.where(real[:, s, None], step, after)
    return _scaled(result.reshape(-1, kinds)[at])


def fit(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> Model:
    """The model of (text, label) rows; labels in code point order."""
    labels = sorted({y for _, y in rows})
    kinds = len(labels)
    rng = np.random.default_rng(seed)
    spans: list[list[str]] = []
    owner: list[int] = []
    often: dict[str, Counter] = {y: Counter() for y in labels}
    for text, label in rows:
        words = words_of(text)
        often[label].update(words)
        # Spans lie anywhere in the text; a short one is filled up with its own words.
        starts = np.arange(0, len(words), SPAN)
        if len(starts) > TEXT_SPANS:
            starts = np.sort(rng.choice(starts, TEXT_SPANS, replace=False))
        for i in starts.tolist():
            span = words[i : i + SPAN]
            spans.append((span * SPAN)[:SPAN])
            owner.append(labels.index(label))
    lexicon_words = sorted({w for c in often.values() for w, _ in c.most_common(LEXICON // max(1, kinds))})
    lexicon = {w: BUCKETS + i for i, w in enumerate(lexicon_words)}
    weights = np.zeros((BUCKETS + len(lexicon), kinds))
    moves = np.full((kinds, kinds), -1.0) + 2.0 * np.eye(kinds)
    model = Model(labels, weights, lexicon, moves)
    if kinds < 2 or not spans:
        return model
    # Pairs of spans of one document's language stay together, so that both moves are seen.
    order = rng.permutation(len(spans))
    per = SEQUENCE // SPAN
    while len(order) % per:
        order = np.append(order, order[: per - len(order) % per])
    order = order.reshape(-1, per)
    types = sorted({w for s in spans for w in s})
    place = {w: i for i, w in enumerate(types)}
    ids = np.array([[place[w] for s in row for w in spans[s]] for row in order])
    gold = np.repeat(np.array(owner)[order], SPAN, axis=1)
    grams, starts = gram_features(types)
    of_type = np.repeat(np.arange(len(types)), np.diff(np.append(starts, len(grams))))
    entry = np.array([lexicon.get(w, -1) for w in types])
    listed = entry >= 0
    texts, size = ids.shape
    right = np.eye(kinds)[gold]
    seen = np.zeros((kinds, kinds))
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
    moment = [np.zeros_like(weights), np.zeros_like(moves)]
    square = [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        scores = np.add.reduceat(weights[grams], starts, axis=0)
        scores[listed] += weights[entry[listed]]
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))[ids] + 1e-30
        move = np.exp(moves)
        ahead, back = np.empty_like(emit), np.empty_like(emit)
        state = np.full((texts, kinds), 1.0 / kinds)
        for s in range(size):
            state = ahead[:, s] = _scaled((state @ move) * emit[:, s])
        state = np.full((texts, kinds), 1.0 / kinds)
        for s in range(size - 1, -1, -1):
            back[:, s] = state
            state = _scaled((emit[:, s] * state) @ move.T)
        both = _scaled(ahead * back)
        pair = ahead[:, :-1, :, None] * move * (emit[:, 1:] * back[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        off = (right - both).reshape(-1, kinds)
        by_type = np.stack([np.bincount(ids.ravel(), off[:, k], len(types)) for k in range(kinds)], axis=1)
        change = np.stack([np.bincount(grams, by_type[of_type, k], len(weights)) for k in range(kinds)], axis=1)
        change[entry[listed]] += by_type[listed]
        change[BUCKETS - 1] = 0
        change = [change / ids.size - DECAY * weights, (seen - pair.sum(axis=(0, 1))) / ids.size]
        for i, target in enumerate((weights, moves)):
            moment[i] = 0.9 * moment[i] + 0.1 * change[i]
            square[i] = 0.99 * square[i] + 0.01 * change[i] ** 2
            target += RATE * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-6)
    weights[BUCKETS - 1] = 0
    return Model(labels, weights.astype(np.float32).astype(np.float64), lexicon, moves)


def held_out():
    """Whether a row is kept from learning: a third of the ids, and rows without an id."""
    return F.coalesce(F.pmod(crc32_of_id(), F.lit(3)) == 1, F.lit(True))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on documents with a language that are not held out. Reads doc_id, text, lang."""
    known = docs.filter(~held_out()).select("doc_id", F.col("lang").alias("label"))
    return fit([(text, label) for label, _, text in labelled_sample(docs, known, sample)])


def _model(shared) -> Model:
    """The broadcast model, one for each worker process, so that it remembers words between tasks."""
    return kept(shared.value[0], lambda: Model(*shared.value[1:]))


def _broadcast(spark, model: Model):
    import uuid

    ship(spark)
    return spark.sparkContext.broadcast(
        (uuid.uuid4().hex, model.labels, model.weights, model.lexicon, model.transitions)
    )


def _document(model: Model, texts: list[str]) -> Iterator[tuple[str, float]]:
    """(language, expected share of it) of each text."""
    words = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    some = np.flatnonzero(lengths)
    if not len(some) or not model.labels:
        yield from ((UNDETERMINED, 0.0) for _ in texts)
        return
    found = model.posteriors([w for i in some for w in words[i]], lengths[some])
    starts = np.cumsum(lengths[some]) - lengths[some]
    share = np.add.reduceat(found, starts, axis=0) / lengths[some, None]
    place = dict(zip(some.tolist(), range(len(some))))
    for i, text in enumerate(texts):
        if i not in place or not any(map(str.isalpha, text)):
            yield UNDETERMINED, 0.0
            continue
        best = int(share[place[i]].argmax())
        yield model.labels[best], float(min(1.0, share[place[i], best]))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the language with the largest expected share of words.

    A null text, one without a letter, or a model without labels gives ``und`` and 0. Equal shares
    go to the first label in code point order. Only ``text`` is looked at; other columns pass.
    """
    shared = _broadcast(docs.sparkSession, model)
    docs = docs.select(*(c for c in docs.columns if c not in ("lang_pred", "score")))
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            rows = [r for _, ts in grouped_texts(texts, GROUP_CHARS) for r in _document(own, ts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(work, schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; repeated rows are kept."""
    named = with_language(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, stop, lang, score) of runs of words of one language, in code points.

    ``score`` is the run's mean probability. Texts without a word have no row.
    """
    shared = _broadcast(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = list(_WORD.finditer(text or ""))
                if not hits or not own.labels:
                    continue
                found = own.posteriors([h.group().lower() for h in hits], np.array([len(hits)]))
                best = found.argmax(axis=1)
                cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(hits)]
                for a, b in zip(cuts, cuts[1:]):
                    out.append(
                        (doc_id, hits[a].start(), hits[b - 1].end(), own.labels[best[a]], float(found[a:b, best[a]].mean()))
                    )
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64())
            columns = [pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "stop", "lang", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, start bigint, stop bigint, lang string, score double"
    )
