import random

import corpus_pipeline
import numpy as np
import pytest

from fathom.llm import simhash, wide_simhash


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def likeness(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b)


def edited_pairs(rng, n):
    """Texts of 80 to 600 words with a copy in which random words are replaced."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    for _ in range(n):
        text = [word() for _ in range(rng.randint(80, 600))]
        copy = list(text)
        for i in rng.sample(range(len(text)), max(1, int(len(text) * rng.uniform(0.002, 0.04)))):
            copy[i] = word()
        yield " ".join(text), " ".join(copy)


def test_stage_keeps_one_of_texts_that_share_most_shingles(spark, sf_dir, make_docs):
    pairs = list(edited_pairs(random.Random(4), 400))
    rows = [(2 * n + side, pair[side]) for n, pair in enumerate(pairs) for side in (0, 1)]
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, make_docs(rows), sf_dir).collect()}
    alike = [likeness(*pair) >= 0.8 for pair in pairs]
    assert 100 < sum(alike) < 400
    assert all(2 * n in kept for n in range(400))
    assert all(2 * n + 1 in kept for n in range(400) if not alike[n])
    assert sum(2 * n + 1 not in kept for n in range(400) if alike[n]) >= 0.98 * sum(alike)


def test_odd_rows_large_groups_and_columns(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(wide_simhash, "BLOCK", 20)
    monkeypatch.setattr(wide_simhash, "GROUP_BLOCK", 20)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    group = []
    for n in range(70):
        copy = list(base)
        copy[rng.randrange(400)] = f"x{n}"
        group.append((1000 + n, " ".join(copy)))
    frame = make_docs(odd_rows + group, extra=["_x"])
    kept = wide_simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 6, 7, 8, 1000] and ids.count(None) == 1
    assert wide_simhash.deduplicate(make_docs([])).count() == 0


def test_rows_sorted_by_key_are_never_broken_off():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(3).integers(0, 40, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7]), pa.array(keys[i : i + 7] % 3)], ["k", "p"]) for i in range(0, 500, 7)]
    tables = list(wide_simhash._whole(iter(batches), 2))
    assert np.concatenate([t.column(0).to_numpy() for t in tables]).tolist() == keys.tolist()
    seen = [set(t.column(0).to_pylist()) for t in tables]
    assert sum(map(len, seen)) == len(set(keys.tolist()))


def test_an_index_for_fewer_bits_is_refused(make_docs):
    for call in (simhash.deduplicate, simhash.near_duplicates):
        with pytest.raises(ValueError, match="4 differing bits"):
            call(make_docs([(1, "a b c")]), bits=5)
    with pytest.raises(ValueError, match="0.8"):
        wide_simhash.deduplicate(make_docs([(1, "a")]), least=0.7)
