"""Merge replay against the vocabulary's own library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fathom.llm import merge_replay
from fathom.llm.merge_replay import ReplayEncoder, Vocabulary, replay

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def library(path=PATH):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_ids_of_odd_texts():
    random.seed(3)
    # The last characters are newer than Python's tables: letters to one pattern library only.
    letters = "aaab céñß\n\t  123.,!'s漢🙂‍\x1c\x85 ࢏꟎\U00011de0"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 50))) for _ in range(4000)]
    texts += ["", " ", "\n", "a" * 20_000, "ab" * 9_000, "é" * 5_001, "<|endoftext|>", "x\n\ny", " a", "a "]
    own, theirs = ReplayEncoder(PATH, PATTERN), library()
    assert own(texts) == [raw(theirs.encode_ordinary(t)) for t in texts]


def test_vocabularies_in_which_longer_tokens_are_older(tmp_path):
    """A merge then uncovers pairs of lower rank, which go first."""
    random.seed(5)
    path = str(tmp_path / "ranks.tiktoken")
    for trial in range(150):
        more = {bytes(random.choice(b"abc") for _ in range(random.randint(2, 6))) for _ in range(30)}
        order = [bytes([b]) for b in range(256)] + random.sample(sorted(more), len(more))
        if trial % 2:
            random.shuffle(order)
        with open(path, "wb") as file:
            for rank, token in enumerate(order):
                file.write(base64.b64encode(token) + b" %d\n" % rank)
        own, theirs = ReplayEncoder(path, PATTERN), library(path)
        texts = ["".join(random.choice("abc") for _ in range(random.randint(1, 40))) for _ in range(30)]
        assert own(texts) == [raw(theirs.encode_ordinary(t)) for t in texts], trial


def test_groups_of_words_do_not_change_the_ids(monkeypatch):
    words = [w.encode() for w in "antidisestablishmentarianism Donaudampfschifffahrt naïveté zzzzzz".split()]
    vocabulary = Vocabulary(PATH)
    assert replay(words, vocabulary) == [replay([w], vocabulary)[0] for w in words]
    assert replay([], vocabulary) == []
    texts = ["una frase più lunga", "noch ein längerer Satz", "and one more sentence"]
    want = ReplayEncoder(PATH, PATTERN)(texts)
    monkeypatch.setattr(merge_replay, "REPLAY_BYTES", 3)
    assert ReplayEncoder(PATH, PATTERN)(texts) == want


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    theirs = library()
    found = merge_replay.round_trip(docs, PATH, PATTERN).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_rows_of_any_kind(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", None), (2, None, "y"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumn("n_tokens", F.lit("clash"))
    found = merge_replay.round_trip(docs, PATH, PATTERN)
    nothing = hashlib.sha256(b"").hexdigest()
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in found.collect())
    spelled = hashlib.sha256(b"a b").hexdigest()
    assert got == [(0, 1, hashlib.sha256(b"c").hexdigest()), (1, 2, spelled), (1, 2, spelled), (2, 0, nothing), (3, 0, nothing)]
    assert merge_replay.round_trip(docs.limit(0), PATH, PATTERN).count() == 0


def test_an_unknown_id_is_an_error(spark):
    encoded = spark.createDataFrame([(1, bytearray(raw([10_000_000])))], "doc_id bigint, ids binary")
    with pytest.raises(Exception, match="IndexError"):
        merge_replay.decode(encoded, PATH).collect()
    none = spark.createDataFrame([(1, None)], "doc_id bigint, ids binary")
    assert merge_replay.decode(none, PATH).first().n_tokens == 0


def test_encode_and_decode_are_inverse(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, extra=["ids"])
    encoded = merge_replay.encode(docs, PATH, PATTERN)
    decoded = merge_replay.decode(encoded, PATH).collect()
    theirs = library()
    got = sorted((r.doc_id or 0, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in decoded)
    want = []
    for i, text, *_ in odd_rows:
        ids = theirs.encode_ordinary(text or "")
        want.append((i or 0, raw(ids), len(ids), (text or "").encode()))
    assert got == sorted(want)
    one = merge_replay.round_trip(docs, PATH, PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    two = merge_replay.decode(encoded, PATH).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
