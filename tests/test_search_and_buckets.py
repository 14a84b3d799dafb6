"""Successive halving, merges over bucketed tables, scores without a time."""

import uuid

import pytest

from fathom.operators import applications as apps
from fathom.operators import modeling, splitting
from fathom.sources import writers


def test_halving_finds_the_winner_of_the_full_grid(loans):
    plan = modeling.grade_tree(7)
    settings = modeling.grid(maxDepth=[1, 2, 3, 5])
    frame, best = modeling.successive_halving(loans, plan, 7, 3, settings, parallelism=3)
    _, whole = modeling.cross_validate(loans, plan, 7, 3, settings, parallelism=3)
    assert best == whole
    tried = {(r.rung, r.setting) for r in frame.collect()}
    assert [len({s for rung, s in tried if rung == i}) for i in range(3)] == [4, 2, 1]
    assert {(r.rung, r.fraction) for r in frame.collect()} == {(0, 0.25), (1, 0.5), (2, 1.0)}
    # The last rung is the plain cross-validation of its setting.
    last = {r.fold: r.metric for r in frame.filter("rung = 2").collect()}
    plain, _ = modeling.cross_validate(loans, plan, 7, 3, [best], parallelism=3)
    assert last == {r.fold: r.metric for r in plain.collect()}


def test_halving_of_one_setting_and_bad_keep(loans):
    frame, best = modeling.successive_halving(loans, modeling.grade_tree(7, depth=2), 7, 2, [{}])
    assert best == {} and {r.fraction for r in frame.collect()} == {1.0}
    with pytest.raises(ValueError):
        modeling.successive_halving(loans, modeling.grade_tree(7), 7, 2, [{}], keep=1)


def test_rungs_are_nested(loans):
    slot = splitting.key_slot("id", 7 + 7919, 1 << 20)
    few = loans.filter(slot < (1 << 18)).select("id")
    more = loans.filter(slot < (1 << 19)).select("id")
    assert few.exceptAll(more).count() == 0 and 0 < few.count() < more.count() < loans.count()


def test_bucketed_merge_has_no_exchange(spark, scored, tmp_path):
    base = scored.select("id", "username", "status", "loan_grade")
    scores = scored.filter("status = '-'").selectExpr("id", "'ACCEPTED' AS status", "'B' AS loan_grade", "1 AS batch")
    older = scores.selectExpr("id", "'REJECTED' AS status", "'C' AS loan_grade", "0 AS batch")
    names = [f"t{uuid.uuid4().hex}" for _ in range(2)]
    left = writers.write_bucketed(base, names[0], str(tmp_path / "a"), "id", 8)
    right = writers.write_bucketed(scores.union(older), names[1], str(tmp_path / "s"), "id", 8)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = apps.merge_scores(left, right, order_by="batch")
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        plain = apps.merge_scores(base, scores.union(older), order_by="batch")
        assert merged.exceptAll(plain).count() == 0 and merged.count() == base.count()
        assert merged.filter("loan_grade = 'B' AND status = 'ACCEPTED'").count() >= scores.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in names:
            spark.sql(f"DROP TABLE {name}")


def test_scores_without_a_time(spark):
    base = spark.createDataFrame([(1, "-"), (2, "-"), (3, "-")], "id int, status string")
    scores = spark.createDataFrame(
        [(1, "ACCEPTED", None), (1, "ACCEPTED", None), (2, "REJECTED", None), (2, "ACCEPTED", 4)],
        "id int, status string, batch int",
    )
    got = {r.id: r.status for r in apps.merge_scores(base, scores, order_by="batch").collect()}
    assert got == {1: "ACCEPTED", 2: "ACCEPTED", 3: "-"}
    different = spark.createDataFrame([(1, "ACCEPTED", None), (1, "REJECTED", None)], scores.schema)
    with pytest.raises(Exception, match="several scores of id 1"):
        apps.merge_scores(base, different, order_by="batch").collect()
