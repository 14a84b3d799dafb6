"""The conversation trie against a plain one, with rounds in Spark and inside tasks."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from fathom.llm import prefix_trie
from fathom.llm.prefix_trie import conversation_trie, decompose

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, chunk string"


def plain(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = []
    rolled = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        below = [rolled[p] for p in children.get(path, [])]
        rolled[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
        ends = sorted(c for c in members[path] if len(rebuilt[c]) == len(path))
        out.append(
            (
                min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]),
                len(children.get(path, [])), *rolled[path],
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=lambda r: (r[0], r[1]))


def result(frame):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=lambda r: (r[0], r[1]))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def some_rows(seed):
    random.seed(seed)
    rows = []
    for c in [*range(0, 60), -7, -5, 1_000_003]:
        for t in range(random.randint(1, 9)):
            rows.append((c, t, random.choice(["user", "assistant", None]), random.choice(["hi", "é", "", None, "more words"])))
    rows += [(3, None, "user", "first"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 0, "user", "lost")]
    # One long conversation and many equal ones.
    rows += [(200, t, "user", f"turn {t}") for t in range(150)]
    rows += [(c, t, "user", "same") for c in range(300, 360) for t in range(3)]
    return rows


def test_plain_trie(spark):
    rows = some_rows(1)
    assert result(conversation_trie(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("most", [1, 40])
def test_rounds_in_spark_give_the_same(spark, most):
    """With small components nearly all centroids are taken by joins."""
    rows = some_rows(2) if most > 1 else some_rows(3)[:90] + [(400, t, "user", f"turn {t}") for t in range(40)]
    assert result(conversation_trie(frame(spark, rows), component_rows=most)) == plain(rows)


def test_small_batches_of_components(spark, monkeypatch):
    rows = some_rows(4)
    monkeypatch.setattr(prefix_trie, "BATCH_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert result(conversation_trie(frame(spark, rows), component_rows=60)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_turnless_conversations(spark):
    """17 loses all its turns (crc32 % 9 turns go, and 15 is absent) and ends at the root."""
    lost = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(lost, 0, "user", "a"), (lost, 1, "user", "b")]
    got = result(conversation_trie(frame(spark, rows)))
    assert got == plain(rows) and [r[1] for r in got] == [0]
    assert got[0][-1] == hashlib.sha256(str(lost).encode()).hexdigest()


def test_no_conversations(spark):
    assert conversation_trie(frame(spark, [])).count() == 0
    assert conversation_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_decomposition_by_brute_force():
    rng = np.random.default_rng(1)
    for shape in ("random", "path", "star", "forest"):
        n = 300
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        if shape == "path":
            parent = np.arange(-1, n - 1)
        elif shape == "star":
            parent = np.array([-1] + [0] * (n - 1))
        elif shape == "forest":
            parent[rng.random(n) < 0.1] = -1
        own = rng.integers(1, 5, n)
        value = rng.integers(0, 100, n)
        weight, total = own.copy(), value.copy()
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                weight[parent[i]] += weight[i]
                total[parent[i]] += total[i]
        assert (decompose(parent, weight, [value])[0] == total).all(), shape
