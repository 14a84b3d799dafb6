import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fathom.llm import sketches


def paragraphs(text):
    return set(re.findall(r"\A(?:[^ \n]+ ?){1,8}|(?:[^ \n]+ ?){1,16}", text))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, found):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [(r[0], r[1] or "") for r in order]
    wanted = []
    for i, (doc_id, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        mine = paragraphs(text)
        wanted.append(
            (str(doc_id), len(text), hashlib.sha256(new.encode()).hexdigest(),
             round(likeness(mine, paragraphs(new)), 9), round(likeness(mine, paragraphs(after)), 9))
        )
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert sorted(got) == sorted(wanted)


def test_rows_equal_brute_force(make_docs, odd_rows, small_documents):
    rows = odd_rows + [(r[0] * 3 + 50, r[1]) for r in small_documents[:80]] + [(9000, "one\n" * 5), (9001, "one\ntwo")]
    found = sketches.fingerprints(make_docs(rows, extra=["range", "copy", "r"])).collect()
    check(rows, found)
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1] or "", set()).add(str(r[0]))
    prints = {}
    for r in found:
        prints.setdefault(str(r.doc_id), set()).add(r.fingerprint)
    assert prints["4"] == prints["5"] and len(prints["4"]) == 1


def test_one_row_and_none(make_docs):
    check([(3, "a b c d")], sketches.fingerprints(make_docs([(3, "a b c d")])).collect())
    assert sketches.fingerprints(make_docs([])).count() == 0
    nulls = [(None, "b"), (None, "a"), (1, "c")]
    check(nulls, sketches.fingerprints(make_docs(nulls)).collect())


@pytest.mark.parametrize("sizes", [(0, 0), (3, 4), (20, 0), (150, 150), (900, 700)])
def test_peeling_counts_what_differs(spark, sizes):
    left, right = sizes
    frame = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(39 + left)), lambda i: F.xxhash64(i)).alias("a"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.xxhash64(i)),
            F.slice(F.transform(F.sequence(F.lit(10_000), F.lit(10_900)), lambda i: F.xxhash64(i)), 1, right),
        ).alias("b"),
    )
    frame = frame.select(*(F.expr(sketches.prepared(c)).alias(c) for c in "ab"))
    row = frame.select(
        F.expr(sketches.differing("a", "b", sketches.sketch("a"), sketches.sketch("b"))).alias("n"),
        F.expr(sketches.peeled(sketches.subtracted(sketches.sketch("a"), sketches.sketch("b")))).alias("small"),
        F.expr(sketches._dealt("a", "b", "1")).alias("dealt"),
    ).first()
    assert row.n == left + right
    assert row.small in (left + right, -1)
    assert row.dealt in (left + right, -1)


def test_differing_digests_are_recovered(spark, small_documents):
    """Small and large differences, by the first sketch and by dealt ones."""
    texts = [r[1] for r in small_documents[:12]]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:]))]
    rows += [(100, texts[0], texts[0]), (101, None, ""), (102, "a b c", None), (103, "x\n" * 3 + "y", "y\nz")]
    long_ = "\n".join(f"line {i}" for i in range(700))
    rows += [(104, long_, long_.replace("line 3", "lime 3")), (105, long_, long_ + "\nlast")]
    df = spark.createDataFrame(rows, "removed int, old string, new string")
    digest = lambda c: F.expr(sketches.digests(c))
    wanted = df.select(
        F.array_sort(F.array_except(digest("old"), digest("new"))).alias("removed"),
        F.array_sort(F.array_except(digest("new"), digest("old"))).alias("added"),
    )
    found = sketches.changed_paragraphs(df, "old", "new")
    assert found.columns == ["old", "new", "removed", "added"]
    pairs = list(zip(found.collect(), wanted.collect()))
    assert all((f.removed, f.added) == (w.removed, w.added) for f, w in pairs)
    assert max(len(f.removed) for f, _ in pairs) > 100


@pytest.mark.parametrize("growth", ["1", "4"])
def test_small_sketches_that_fail_are_dealt_alone(spark, growth):
    """Dealing ends with every digest told apart, whatever hides in one of the small sketches."""
    sizes = [(left, right) for left in (0, 5, 22, 45) for right in (1, 22, 30)] * 4 + [(300, 280)]
    rows = [(i, [1000 * i + x for x in range(a)], [1000 * i + 500 + x for x in range(b)]) for i, (a, b) in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    frame = frame.select("i", *(F.transform(c, lambda v: F.xxhash64(v)).alias(c) for c in "ab"))
    frame = frame.select("i", *(F.expr(sketches.prepared(c)).alias(c) for c in "ab"))
    found = frame.orderBy("i").select(
        F.expr(sketches._dealt("a", "b", growth)).alias("n"),
        F.expr(f"array_sort(transform({sketches._dealt('a', 'b', growth, True)}, c -> c.c))").alias("signs"),
    )
    found = [(r.n, r.signs) for r in found.collect()]
    assert found == [(a + b, [-1] * b + [1] * a) for a, b in sizes]
