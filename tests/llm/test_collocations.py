"""Collocations against a plain count in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fathom.llm import collocations
from fathom.llm.collocations import Cutter

SCHEMA = "doc_id bigint, text string, lang string, phrase string, code string"


def plain(rows, support, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    out = []
    for (lang, words), a in counts.items():
        if len(words) == 1 or a < support:
            continue
        longer = [
            f for (other, held), f in counts.items()
            if other == lang and len(held) == 3 > len(words) and f >= support and words in (held[:2], held[1:])
        ]
        if any(100 * f >= 50 * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(words), a, l, r, totals[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, seen = [], Counter()
    for row in out:
        seen[row[0]] += 1
        if seen[row[0]] <= top:
            ranked.append((row[0], seen[row[0]], *row[1:]))
    return ranked


def test_cutter_agrees_with_regular_expressions():
    random.seed(2)
    texts = ["".join(random.choice("aBc é.,\n\t :;!?\r\x0b\x0c漢") for _ in range(random.randint(0, 60))) for _ in range(300)]
    words = Cutter(hashes=2)(texts)
    found = [(t, words.raw[a:b].decode()) for t, a, b in zip(words.text.tolist(), words.starts, words.ends)]
    want, follows = [], []
    for i, text in enumerate(texts):
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            own = re.findall(r"[^\x20\x09]+", piece)
            want += [(i, w) for w in own]
            follows += [True] * (len(own) - 1) + [False] * bool(own)
    assert found == want
    assert words.follows.tolist() == follows[:-1]
    for hashes in words.hashes:
        by_word = {}
        for (_, w), h in zip(found, hashes.tolist()):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("shards", [1, 4, 8])
def test_small_texts_by_brute_force(spark, shards):
    random.seed(shards)
    vocabulary = ["the", "a", "New", "york", "city", "of", "x", "é", "漢", "don't", "...", "-"]
    rows = []
    for i in range(400):
        text = " ".join(random.choice(vocabulary) for _ in range(random.randint(0, 12)))
        if random.random() < 0.3:
            text += ". new YORK city, of the\tcity\n"
        rows.append((i, text, random.choice(["en", "de", None, "und"]), "p", "c"))
    rows += [(1, None, "en", None, None), (1, "", None, None, None), (None, "a a a a", "en", "p", "c")] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain([(r[1], r[2]) for r in rows], 10, 40)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r) for r in collocations.collocations(docs, top=40, shards=shards).select(*columns).collect())
    assert got == sorted(want) and len(want) > 25
    everything = collocations.collocations(docs, top=None, shards=shards).count()
    assert everything == len(plain([(r[1], r[2]) for r in rows], 10, 10**9))


def test_maps_that_fill_up_and_small_tallies_lose_nothing(spark, monkeypatch):
    """Tasks take these settings along with the functions they run."""
    random.seed(9)
    rows = [(i, " ".join(random.choice("abcdefgh") for _ in range(30)), "en", "", "") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in collocations.collocations(docs, top=None).collect())
    monkeypatch.setattr(collocations, "MAP_BITS", 8)
    monkeypatch.setattr(collocations, "_seen", lambda bits, codes: np.ones(len(codes), bool))
    monkeypatch.setattr(collocations, "_bit_map", lambda codes: bytes(32))
    monkeypatch.setattr(collocations, "CUT_CHARS", 200)
    assert sorted(tuple(r) for r in collocations.collocations(docs, top=None).collect()) == want
    assert len(want) > 20


def test_large_counts_are_exact(spark):
    """A count near 10^7 makes products beyond 64 bits."""
    counts = collocations.PhraseCounts(
        spark.createDataFrame(
            [("en", "p q", 2, 9_999_991), ("en", "p", 1, 9_999_999_967), ("en", "q", 1, 10_000_019)],
            "lang string, phrase string, words int, n bigint",
        ),
        spark.createDataFrame([("en", 10**12)], "lang string, n bigint"),
    )
    parts = spark.createDataFrame([("en", "p", 0), ("en", "q", 1)], "lang string, part string, side int")
    assert sorted(r.f for r in collocations._with_part_counts(parts, counts).collect()) == [10_000_019, 9_999_999_967]
    docs = spark.createDataFrame([(1, "", "en", "", "")], SCHEMA)
    original = collocations.count_phrases
    try:
        collocations.count_phrases = lambda *a, **k: counts
        row = collocations.collocations(docs).first()
    finally:
        collocations.count_phrases = original
    assert row.score == 1_000_000 * 9_999_991**2 // (9_999_999_967 * 10_000_019)


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " . ", "en", None, None)], SCHEMA)
    assert collocations.collocations(blank).count() == 0


def test_shards_are_bounded(spark):
    with pytest.raises(ValueError):
        collocations.count_phrases(spark.createDataFrame([], SCHEMA), shards=9)


def test_phrases_that_share_a_hash_are_counted_by_letters():
    cut = Cutter(hashes=2)
    words = cut(["one two  one\ttwo", "two one"])
    tally = collocations.PhraseTally()
    langs = np.array([0, 0])
    first = np.arange(len(words.starts))
    same = np.zeros(len(first), np.uint64)
    assert not tally.add(words, langs, 1, first, same, words.hashes[1])
    assert tally.add(words, langs, 1, first, words.hashes[0], words.hashes[1])
    assert not tally.add(words, langs, 1, first[:1], words.hashes[0][:1], words.hashes[1][:1] + np.uint64(1))
    tally.langs = {"en": 0}
    (batch,) = tally.take()
    assert sorted(zip(*(c.to_pylist() for c in batch.columns))) == [("en", "one", 1, 3), ("en", "two", 1, 3)]
    exact = collocations._by_letters(words, ["en", "en"], 2, np.array([0, 2, 4]))
    assert sorted(zip(*(c.to_pylist() for c in exact.columns))) == [("en", "one two", 2, 2), ("en", "two one", 2, 1)]
    assert collocations._spelled(words, np.array([0, 1, 2]), 2).to_pylist() == ["one two", "two one", "one two"]
