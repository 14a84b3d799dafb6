import pytest

from fathom.llm import mixing


def filled(sizes, weights, total, most):
    """Water-filling round by round, in plain Python."""
    target, free = {}, set(sizes)
    while free:
        left = total - sum(target.values())
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if most * sizes[s] < weights[s] * level}
        if not over:
            return target | {s: weights[s] * level for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_targets_and_taken(make_docs):
    rows = [(i, "w " * (1 + i % 7), None, f"s{i % 4}" if i % 9 else "tiny") for i in range(300)]
    rows += [(1000, "a b c", None, None), (1001, None, None, "s1"), (1002, "", None, "empty"), (None, "x y", None, "s2")]
    rows += [(5, "five times the same", None, "s1")] * 3
    found = mixing.mix(make_docs(rows, extra=["size", "target"])).collect()
    assert len(found) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    wanted = filled(sizes, weights, sum(sizes.values()), 3)
    of = {r[0]: r[3] for r in rows}
    taken = {s: 0 for s in sizes}
    for row in found:
        source = of[row.doc_id]
        assert row.source_size == sizes[source]
        assert row.target == pytest.approx(wanted[source])
        assert 0 <= row.taken <= 3 * row.size
        taken[source] += row.taken
    assert all(abs(taken[s] - wanted[s]) <= 0.5 + 1e-9 for s in sizes)
    again = mixing.mix(make_docs(rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_one_source_is_capped_and_empty_tables_give_nothing(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    rows = mixing.mix(make_docs([(1, "a b c", None, "s")])).collect()
    assert [(r.target, r.taken) for r in rows] == [(3.0, 3)]
    assert mixing.mixed_documents(make_docs([])).count() == 0


def test_mixed_documents_hold_what_the_plan_takes(make_docs):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1 + i % 11)) + "\n", "en", f"s{i % 3}") for i in range(90)]
    docs = make_docs(rows, extra=["_time", "taken"])
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    texts = dict((r[0], r[1]) for r in rows)
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert words == {k: v for k, v in taken.items() if v}
