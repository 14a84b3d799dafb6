import random

import pytest

from fathom.llm import decontaminate as dc


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def test_myers_equals_dynamic_programming():
    rng = random.Random(4)
    for _ in range(800):
        pattern = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 120)))
        assert dc.myers(pattern, text) == plain_distance(pattern, text)


def test_pieces_make_up_the_item():
    for size in (1, 5, 24, 100):
        for budget in (0, 1, 4, 9):
            item = "abcdefghij" * 10
            cut = dc.pieces(item[:size], budget)
            assert "".join(p for _, p in cut) == item[:size] and len(cut) == min(budget + 1, size)
    assert dc.pieces("", 3) == []


@pytest.fixture
def items(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "kmp" for b in "aeo" for c in ("ran", "lit", "dus", "vek")]
    texts = [" ".join(rng.choice(words) for _ in range(n)).capitalize() + "." for n in (4, 20, 50, 50)]
    return [(0, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[2]), (4, None), (5, " .. "), (None, texts[3])]


def edited(text, count, rng):
    letters = list(text)
    for _ in range(count):
        at = rng.randrange(len(letters))
        letters[at : at + 1] = rng.choice([[], ["z"], [letters[at], "z"]])
    return "".join(letters)


def test_every_pair_within_the_budget_is_found(spark, make_docs, items, odd_rows, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 200)  # several blocks
    rng = random.Random(9)
    docs = list(odd_rows)
    for n in range(40):
        _, text = items[n % 4]
        docs.append((100 + n, "Before it " + edited(text, n // 6, rng).upper().replace(" ", ",\n") + " and after"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = dc.contaminated(make_docs(docs, extra=["item_id"]), bench).collect()
    wanted = set()
    for doc_id, text, *_ in docs:
        if text is None:
            continue
        for item_id, item in items:
            pattern = dc.normalized(item or "")
            if item_id is None or not pattern:
                continue
            distance, end = plain_distance(pattern, dc.normalized(text)) if doc_id and doc_id >= 100 else (99, 0)
            if distance <= int(len(pattern) * dc.ERROR_RATE):
                wanted.add((doc_id, item_id, distance, end))
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted) and len(wanted) > 10
    kept = dc.decontaminate(make_docs(docs, extra=["_x"]), bench)
    hit = {w[0] for w in wanted}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in hit)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.contaminated(make_docs([(1, "a b")]), none).count() == 0
    assert dc.decontaminate(make_docs([(1, "a b")]), none).count() == 1
    assert dc.contaminated(make_docs([]), spark.createDataFrame([(1, "a b")], none.schema)).count() == 0


def test_a_short_item_is_no_part_of_a_longer_word(spark, make_docs):
    bench = spark.createDataFrame([(1, "cat"), (2, "Cat sat")], "item_id bigint, text string")
    docs = make_docs([(1, "concatenate"), (2, "The cat."), (3, "cat"), (4, "bobcat, cat sat"), (5, "a cat satin"), (6, "cats")])
    found = {(r.doc_id, r.item_id, r.distance) for r in dc.contaminated(docs, bench).collect()}
    assert found == {(2, 1, 0), (3, 1, 0), (4, 1, 0), (4, 2, 0), (5, 1, 0)}
    assert sorted(r.doc_id for r in dc.decontaminate(docs, bench).collect()) == [1, 6]


def test_blocks_take_turns(spark, make_docs, monkeypatch):
    """Three blocks, of which a task holds one at a time."""
    monkeypatch.setattr(dc, "BLOCK_CHARS", 8)
    bench = spark.createDataFrame([(i, f"item number {i}") for i in range(3)], "item_id bigint, text string")
    docs = make_docs([(i, f"here is item number {i}") for i in range(5)], extra=["_x"])
    kept = dc.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
