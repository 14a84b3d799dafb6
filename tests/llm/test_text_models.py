"""Language, toxicity and license operators: exactness of their parts, held-out accuracy, odd rows."""

import random

import duckdb
import numpy as np
import pytest

from fathom.llm import language_crf as crf
from fathom.llm import license_scan, toxicity
from fathom.llm.common import documents

SF = "/root/testdata/sf0.01"


def test_block_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 33, 64, 52, 200])
    scores, moves = rng.normal(size=(lengths.sum(), 3)) * 3, np.exp(rng.normal(size=(3, 3)))
    got, start = crf.posteriors(scores, moves, lengths), 0
    for n in lengths:
        emit, ahead, back = np.exp(scores[start : start + n]), np.zeros((n, 3)), np.ones((n, 3))
        state = np.ones(3) / 3
        for i in range(n):
            state = ahead[i] = (state @ moves) * emit[i] / ((state @ moves) * emit[i]).sum()
        for i in range(n - 2, -1, -1):
            back[i] = moves @ (emit[i + 1] * back[i + 1])
            back[i] /= back[i].sum()
        both = ahead * back
        assert np.abs(both / both.sum(axis=1, keepdims=True) - got[start : start + n]).max() < 1e-9
        start += n


@pytest.fixture(scope="module")
def language_model(spark):
    return crf.train(documents(spark, SF))


def test_language_held_out(spark, language_model):
    docs = documents(spark, SF)
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = [r for r in crf.identify(docs, language_model).collect() if r.held_out]
    assert len(rows) > 250
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) >= 0.98


def test_words_of_mixed_text(spark, make_docs, language_model, small_documents):
    parts = [" ".join(next(t for _, t, lang, _ in small_documents if lang == x).split()[:30]) for x in ("en", "de", "fr")]
    spans = crf.language_spans(make_docs([(1, " ".join(parts)), (2, None), (3, "12 34")]), language_model).collect()
    assert [(r.doc_id, r.lang) for r in sorted(spans, key=lambda r: r.start)] == [(1, "en"), (1, "de"), (1, "fr")]


def test_language_of_odd_rows(make_docs, odd_rows, language_model, small_documents):
    rows = crf.identify(make_docs([*odd_rows, (20, "12 ²³ %"), (21, None)], extra=["score"]), language_model).collect()
    assert len(rows) == len(odd_rows) + 2
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 20, 21}
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert [r.lang_pred for r in rows if r.doc_id == 4] == [small_documents[0][2]] * 2
    assert crf.identify(make_docs([]), language_model).count() == 0


def test_language_without_labels(make_docs):
    model = crf.train(make_docs([(1, "some words here"), (2, None)]))
    assert [r.lang_pred for r in crf.identify(make_docs([(1, "some words")]), model).collect()] == ["und"]
    one = crf.train(make_docs([(i, "some words here", "xx") for i in range(9)]))
    assert crf.identify(make_docs([(1, "some words")]), one).first().lang_pred == "xx"


def labelled(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    bad = ["vilexa", "vilexo", "vilexu", "grump"]
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        toxic = i % 3 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += f" {rng.choice(bad)} {rng.choice(bad)}"
        rows.append((i, ". ".join(sentences) + ".", int(toxic)))
    return rows


def test_toxicity_learns_from_documents_and_locates_sentences(spark, make_docs, odd_rows):
    rows = labelled(random.Random(1), 900)
    docs = make_docs([(i, t) for i, t, _ in rows] + [(r[0] if r[0] is None else r[0] + 5000, r[1]) for r in odd_rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) + len(odd_rows)
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert all(r.score == 0 for r in found if r.doc_id in (5001, 5002, 5003))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    hits = toxicity.offending_sentences(docs, model).collect()
    assert np.mean([("vilex" in h.words or "grump" in h.words) for h in hits]) > 0.95


def test_toxicity_without_labels(spark, make_docs):
    docs = make_docs([(1, "a b. c")])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).first().predicted == 0
    assert toxicity.score(make_docs([]), toxicity.train(docs, none)).count() == 0


def test_license_bands_and_odd_rows(spark, make_docs, odd_rows):
    assert license_scan.collision_probability(5 / 6) > 0.99
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    docs, wanted = list(odd_rows), set()
    for n, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items()) * 3):
        docs.append((100 + n, f"{filler(n % 5)} {text.upper()}\n{filler(20)}"))
        wanted.add((100 + n, name))
    found = license_scan.license_matches(make_docs(docs, extra=["license", "found"])).collect()
    assert wanted <= {(r.doc_id, r.license) for r in found}
    assert all(r.containment >= 0.8 and (r.doc_id >= 100 or r.doc_id == 6) for r in found)
    assert license_scan.license_matches(make_docs([])).count() == 0
    assert license_scan.license_matches(make_docs(docs), {"tiny": "MIT License"}).count() == 0


def test_labels_of_short_texts_are_learned():
    """Long texts under one label and short ones, from other letters, under a second."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(text("abcdefgh", 60), "long") for _ in range(100)] + [(text("rstuvwxy", 10), "short") for _ in range(100)]
    rows += [("one", "one word")]
    model = crf.fit(rows)
    found = list(crf._document(model, [text("rstuvwxy", 10) for _ in range(50)] + [text("abcdefgh", 60) for _ in range(50)]))
    assert [label for label, _ in found] == ["short"] * 50 + ["long"] * 50


def test_training_reads_beyond_the_beginning_of_texts():
    """What tells the labels apart comes after a thousand words they share."""
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    text = lambda own: " ".join([word("abc") for _ in range(1000)] + [word(own) for _ in range(3000)])
    rows = [(text("klmn"), "x") for _ in range(15)] + [(text("rstu"), "y") for _ in range(15)]
    model = crf.fit(rows)
    found = list(crf._document(model, [" ".join(word(s) for _ in range(40)) for s in ("klmn", "rstu")]))
    assert [label for label, _ in found] == ["x", "y"]
