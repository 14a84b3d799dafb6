from itertools import combinations

import numpy as np
import xxhash

from fathom.llm import simhash
from fathom.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints):
    root = list(range(len(fingerprints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fingerprints)), 2):
        if bin(fingerprints[i] ^ fingerprints[j]).count("1") <= 4:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fingerprints))]


def test_triples_cover_every_four_positions():
    triples = [set(t) for t in simhash.covering_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_near_is_exact_for_signs_and_shared_bytes():
    rng = np.random.default_rng(2)
    a = rng.integers(-(1 << 63), 1 << 63, 2000, dtype=np.int64)
    chosen = [rng.choice(64, n, replace=False) for n in rng.integers(1, 8, 2000)]
    masks = np.array([sum(1 << int(b) for b in bits) for bits in chosen], np.uint64)
    b = (a.view(np.uint64) ^ masks).view(np.int64)
    wanted = [bin(int(m)).count("1") <= 4 for m in masks]
    assert simhash.near(a, b, 4).tolist() == wanted


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    edges += [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 340)] + [(7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: root[x] for x in joined}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rows_equal_brute_force(make_docs, odd_rows, small_documents):
    docs = odd_rows + [(r[0] + 100, r[1]) for r in small_documents]
    rows = simhash.near_duplicates(make_docs(docs, extra=["fingerprint", "root"])).collect()
    prints = [plain_fingerprint(r[1]) for r in docs]
    roots = plain_components(prints)
    ids = {}
    for r, root in zip(docs, roots):
        ids.setdefault(root, []).append(r[0])
    low = {root: min((i for i in held if i is not None), default=None) for root, held in ids.items()}
    wanted = sorted(((r[0], f"{p:016x}", low[root]) for r, p, root in zip(docs, prints, roots)), key=lambda t: str(t))
    assert sorted(map(tuple, rows), key=lambda t: str(t)) == wanted
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_long_lists_are_cut_into_blocks_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = np.random.default_rng(8)
    base = int(rng.integers(-(1 << 63), 1 << 63))
    chain = [base]
    for _ in range(250):
        flips = sum(1 << int(b) for b in rng.choice(63, 3, replace=False))
        chain.append(chain[-1] ^ flips if rng.random() < 0.5 else chain[0] ^ flips)
    prints = sorted(set(chain))
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    found = {r.fingerprint: r.root for r in simhash.fingerprint_components(frame).collect()}
    roots = plain_components([p % (1 << 64) for p in prints])
    groups = {}
    for p, root in zip(prints, roots):
        groups.setdefault(root, set()).add(p)
    mine = {}
    for p in prints:
        mine.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_deduplicate_keeps_one_row_of_a_group_with_all_columns(make_docs, odd_rows):
    frame = make_docs(odd_rows, extra=["fingerprint"])
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    roots = plain_components(prints)
    assert kept.count() == len(set(roots))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id in (4, 5)) == [4]
