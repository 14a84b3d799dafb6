import random

import numpy as np
import pyarrow as pa
import xxhash

from fathom.llm import chunk_dedup as cd


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_rolling_hash_is_the_gear_hash():
    raw = np.frombuffer(bytes(cd.WINDOW) + words(random.Random(1), 40).encode(), np.uint8)
    table, value, cuts, last = cd.gear_table(), 0, [], -100
    for i, byte in enumerate(raw[:-1].tolist()):
        value = ((value << 1) + int(table[byte])) & 0xFFFFFFFF
        if byte and value < (1 << 32) // cd.CUT_RATE:
            if i + 1 - last > cd.CLOSE:
                cuts.append(i + 1)
            last = i + 1
    assert cd.cut_positions(raw).tolist() == cuts


def test_insertion_moves_near_cuts_only():
    rng = random.Random(2)
    text = words(rng, 400)
    joined, (a, b) = cd.chunk_bounds([text, text[:500] + "inserted " + text[500:]])
    chunks = [{joined[p:q] for p, q in zip(x, x[1:])} for x in (a, b)]
    assert len(chunks[0] - chunks[1]) <= 4
    assert b"".join(joined[p:q] for p, q in zip(b, b[1:])).decode() == text[:500] + "inserted " + text[500:]


def test_passages_are_found_exactly_where_windows_repeat(make_docs, odd_rows):
    rng = random.Random(3)
    passages = [words(rng, n) for n in (49, 50, 51, 60, 80, 120, 300)]
    line = words(rng, 20)
    docs = [(n, f"{words(rng, 60)} {line} {words(rng, 60)}") for n in range(30)]
    for n in range(210):
        docs.append((100 + n, f"{words(rng, rng.randint(0, 90))} {passages[n % 7]}\n{words(rng, rng.randint(0, 90))}"))
    docs += [(1000, "é ü " * 5 + words(rng, 70)), (1001, words(rng, 5) + " é " + words(rng, 200))]
    docs.append((1002, docs[-1][1]))
    docs.append((1002, docs[-1][1]))  # a repeated row
    docs += [(5000, None), (5001, ""), (5002, "x" * 30_000), (None, passages[5])]
    seen = {}
    for i, t in docs:
        w = (t or "").split()
        for p in range(len(w) - 49):
            seen.setdefault(" ".join(w[p : p + 50]), set()).add(i)
    wanted = {i for held in seen.values() if len(held - {None}) > 1 for i in held - {None}}
    rows = cd.repeated_passages(make_docs(docs, extra=["digest", "chunk"])).collect()
    assert {r.doc_id for r in rows} <= wanted
    assert len({r.doc_id for r in rows}) >= 0.98 * len(wanted)
    texts = dict(docs)
    for r in rows:
        assert len(texts[r.doc_id][r.start : r.stop].split()) >= 50
        assert r.removed == (r.first_doc_id < r.doc_id)
    assert [(r.doc_id, r.removed) for r in rows if r.doc_id in (1001, 1002)] in (
        [(1001, False), (1002, True)], [(1002, True), (1001, False)],
    )


def test_copies_are_cut_out_of_all_but_the_first(make_docs, spark):
    rng = random.Random(5)
    passage = words(rng, 200)
    docs = make_docs([(1, passage), (2, "head " + passage + " tail"), (3, words(rng, 80)), (4, None)])
    kept = {r.doc_id: r.text for r in cd.without_repeats(docs).collect()}
    assert kept[1] == passage and kept[4] is None and len(kept[3].split()) == 80
    assert len(kept[2]) < 0.2 * len(passage) and kept[2].startswith("head")
    assert cd.repeated_passages(make_docs([])).count() == 0


def sharing(docs, least=50):
    """Ids of the documents that share a window of words with another one."""
    seen = {}
    for i, t in docs:
        w = t.split()
        for p in range(len(w) - least + 1):
            seen.setdefault(" ".join(w[p : p + least]), set()).add(i)
    return {i for held in seen.values() if len(held) > 1 for i in held}


def test_frequent_lines_in_changing_order_are_no_passage(make_docs):
    rng = random.Random(11)
    lines = [words(rng, 15) for _ in range(20)]
    docs = [(n, "\n".join(rng.choice(lines) for _ in range(5))) for n in range(400)]
    found = cd.repeated_passages(make_docs(docs)).collect()
    assert {r.doc_id for r in found} == sharing(docs)
    assert len({r.doc_id for r in found}) < 200


def test_repeated_phrases_are_found_like_any_passage(make_docs):
    rng = random.Random(12)
    docs = []
    for n in range(200):
        phrase = words(rng, (1, 3, 5, 8, 10)[n % 5]).split()
        passage = " ".join((phrase * 60)[:60])
        docs += [(2 * n + i, f"{words(rng, 70)} {passage} {words(rng, 70)}") for i in (0, 1)]
    wanted = sharing(docs)
    assert len(wanted) == 400
    assert {r.doc_id for r in cd.repeated_passages(make_docs(docs)).collect()} == wanted


def test_texts_under_one_id_stay_apart(make_docs):
    rng = random.Random(13)
    passage = words(rng, 60)
    docs = [(1, f"{words(rng, rng.randint(5, 90))} {passage if n % 2 else ''}") for n in range(1500)]
    docs.append((2, passage))
    frame = make_docs(docs)
    assert cd._identified(frame).select("version").distinct().count() == len(docs)
    assert {r.doc_id for r in cd.repeated_passages(frame).collect()} == {1, 2}


def test_a_text_loses_its_own_passages_only(make_docs):
    rng = random.Random(14)
    shared, other = words(rng, 50), words(rng, 200)
    docs = make_docs(
        [(1, f"{shared} {words(rng, 20)}"), (2, f"{words(rng, 5)} {shared}"), (2, other), (2, None), (None, shared)],
        extra=["_spans", "_id", "_version", "version"],
    )
    kept = cd.without_repeats(docs)
    assert kept.columns == docs.columns
    texts = [(r.doc_id, r.text, r._version) for r in kept.collect()]
    assert (2, other, "own _version") in texts and (2, None, "own _version") in texts
    assert (None, shared, "own _version") in texts
    assert sorted(len(t.split()) for i, t, _ in texts if i == 2 and t) == [5, 200]


def test_what_earlier_documents_hold_is_cut_up_to_its_border(make_docs):
    """The second passage of document 2 is first seen there, and stays beside the cut."""
    rng = random.Random(15)
    old, new = words(rng, 60), words(rng, 60)
    docs = make_docs([(1, f"{old} {words(rng, 30)}"), (2, f"{old} {new}"), (3, f"{words(rng, 9)} {new}")])
    kept = {r.doc_id: r.text for r in cd.without_repeats(docs).collect()}
    # Whole chunks are cut; a few words at the ends of a passage may stay.
    assert kept[2].endswith(new) and len(kept[2].split()) < 60 + 20
    assert 9 <= len(kept[3].split()) < 9 + 20
    assert kept[1].startswith(old)


def test_hot_windows_give_the_same(make_docs, monkeypatch):
    rng = random.Random(16)
    passage = words(rng, 55)
    docs = [(n, f"{words(rng, 30)} {passage} {words(rng, 30)}") for n in range(40)]
    docs += [(100 + n, words(rng, 60)) for n in range(20)]
    want = sharing(docs)
    for hot in (1, 1000, 10**9):
        monkeypatch.setattr(cd, "HOT_WINDOWS", hot)
        assert {r.doc_id for r in cd.repeated_passages(make_docs(docs)).collect()} == want


def test_window_digests_depend_on_words_alone():
    a = np.frombuffer(b"\0one two  three four\nfive\0", np.uint8)
    b = np.frombuffer(b"\0zero one\ttwo three\0four five six\0", np.uint8)
    first, second = cd.window_digests(a, np.arange(3), 3), cd.window_digests(b, np.arange(5), 3)
    assert (first[0] == second[1]).all() and (first[2] == second[3]).all()
    assert len(np.unique(np.concatenate([first, second]), axis=0)) == 5


def test_sequences_of_a_run_do_not_reach_into_the_next_one():
    """All runs of a batch in two tables, one for each kind, whatever their number."""
    rng = random.Random(5)
    kind = pa.list_(pa.struct([("chunk", pa.int32()), ("digest", pa.int64()), ("size", pa.int32()), ("words", pa.int32())]))
    runs = [
        [{"chunk": 7 * n + i, "digest": rng.getrandbits(63) - 2**62, "size": rng.randint(1, 60), "words": rng.randint(0, 9)} for i in range(length)]
        for n, length in enumerate([1, 30, 2, 0, 17, 5])
    ]
    wanted = []
    for n, run in enumerate(runs):
        for i in range(len(run)):
            for whole, column, least in ((False, "size", cd.LEAST_RUN), (True, "words", 21)):
                j = next((j for j in range(i + 1, len(run) + 1) if sum(c[column] for c in run[i:j]) >= least), None)
                if j:
                    raw = np.array([(c["digest"], c["size"]) for c in run[i:j]], np.int64).tobytes()
                    digest = int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64))
                    wanted.append((n, -n, run[i]["chunk"], run[j - 1]["chunk"], whole, digest))
    ids = np.arange(-1, len(runs) + 1)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(-ids), pa.array([runs[1], *runs, runs[1]], kind)], names=["doc_id", "version", "chunks"]
    )
    found = list(cd._sequences(20)(iter([rows.slice(1, len(runs)), rows.slice(0, 0)])))
    assert len(found) == 2
    assert sorted(tuple(r.values()) for b in found for r in b.to_pylist()) == sorted(wanted)
