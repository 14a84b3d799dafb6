"""Counts and stored ids equal the vocabulary's own library."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fathom.llm import token_counts, token_files
from fathom.llm.pretokens import Recent

ODD = [
    "", " ", "\n", "  a  b ", "a\n\nb", " x\ty ", "<|endoftext|>a<|endoftext|> b", "aaaaaaaaa" * 90,
    "1234567890" * 20, "''s 'll we're !!!???", "日本語のテキスト テスト", "\x1c a\x1db", "a\r\nb \n c", "é́  x　 y",
    "\0a \0 b\0", "x" * 3000 + " " + "y" * 300, "a​b ​ c", "$%&" * 500,
]


@pytest.fixture(scope="module")
def library(tokenizer_path):
    return Tokenizer.from_file(tokenizer_path)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_and_ids_of_odd_texts(library, tokenizer_path, small_documents):
    texts = ODD + [t for _, t, *_ in small_documents]
    wanted = [ids_of(library, t) for t in texts]
    assert token_counts.Counter(tokenizer_path)(texts) == [len(w) for w in wanted]
    raw = token_files.Encoder(tokenizer_path)(texts)
    assert [np.frombuffer(r, "<u2").tolist() for r in raw] == wanted


def test_memory_is_bounded_and_forgets_nothing_needed(library, tokenizer_path, small_documents):
    counter = token_counts.Counter(tokenizer_path)
    counter.units, counter.pieces = Recent(50), Recent(20)
    texts = [t for _, t, *_ in small_documents][:60]
    assert [counter([t])[0] for t in texts] == [len(ids_of(library, t)) for t in texts]
    assert len(counter.units) <= 50


def test_merges_are_exact_where_a_product_ranks_before_its_pair(tmp_path):
    """A vocabulary in which one token comes from two pairs, so that order between equal pairs matters."""
    import json

    letters = list("abcx")
    merges = [["b", "c"], ["a", "bc"], ["x", "abc"], ["a", "b"], ["ab", "c"], ["abc", "a"]]
    vocab = {t: i for i, t in enumerate([*letters, *dict.fromkeys("".join(m) for m in merges)])}
    path = tmp_path / "small.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}, "added_tokens": []}))
    table = token_counts.RankTable(str(path))

    def one_by_one(text):
        symbols = list(text)
        order = {tuple(m): i for i, m in enumerate(merges)}
        while True:
            ranked = [(order[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in order]
            if not ranked:
                return len(symbols)
            _, i = min(ranked)
            symbols[i : i + 2] = ["".join(symbols[i : i + 2])]

    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(400)]
    codes = np.array([ord(c) for c in "".join(texts)])
    got = token_counts.merged_lengths(table.letter[codes], np.array([len(t) for t in texts]), table)
    assert got.tolist() == [one_by_one(t) for t in texts]


def test_query_rows(make_docs, odd_rows, tokenizer_path, library):
    rows = token_counts.token_counts(make_docs(odd_rows, extra=["n_tokens", "n_bytes"]), tokenizer_path).collect()
    wanted = sorted(
        (r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(ids_of(library, r[1]))) for r in odd_rows
    )
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in rows) == wanted
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts.token_counts(make_docs([]), tokenizer_path).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    places = np.stack([np.arange(len(keys))] * 3, axis=1)
    index = token_files.build_index(keys, places)
    slots = token_files.find(index, keys)
    assert sorted(slots) == list(range(len(keys)))
    assert (index["places"][slots] == places).all()
    others = np.setdiff1d(rng.integers(0, 1 << 63, 5000).astype(np.uint64), keys)
    assert (token_files.find(index, others) == -1).mean() > 0.999
    empty = token_files.build_index(keys[:0], places[:0])
    assert (token_files.find(empty, keys) == -1).all()
    arrays, note = token_files._unpacked(b"".join(token_files._packed(index, {"null": None})))
    assert note == {"null": None} and (arrays["places"] == index["places"]).all()


def test_files_round_trip(spark, make_docs, odd_rows, tokenizer_path, library, small_documents):
    docs = odd_rows + [(r[0] + 100, *r[1:]) for r in small_documents[:50]]
    frame = make_docs(docs, extra=["start"])
    files = token_files.write_token_files(frame, tokenizer_path, shards=3)
    rows = files.rows(frame).collect()
    # Ascending id, null first, ties by text.
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, wanted = 0, []
    for doc_id, text, *_ in order:
        ids = ids_of(library, text) + [0]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.start, r) for r in rows) == [(w[1], w) for w in wanted]
    assert [x.tolist() for x in files.get(4)] == [ids_of(library, docs[4][1]) + [0]] * 2
    assert files.get(987654321) == []
    assert token_files.token_rows(make_docs([]), tokenizer_path).count() == 0
