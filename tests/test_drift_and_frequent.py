"""Drift against plain distances, frequent values against full counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathom.operators import drift, frequent


def plain_distance(a, b):
    best = (0.0, None)
    for x in sorted({*a, *b}):
        gap = abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b))
        if gap > best[0] + 1e-15:
            best = (gap, x)
    return best


def test_distances_of_several_columns(spark):
    random.seed(3)
    a = [(random.gauss(0, 1), random.randint(0, 5), None) for _ in range(200)] + [(None, 1, 2.0)]
    b = [(random.gauss(0.8, 1), random.randint(0, 5), 1.0) for _ in range(150)] + [(float("nan"), None, 3.0)]
    schema = "x double, y int, z double"
    frames = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = {r.feature: r for r in drift.numeric_drift(*frames, ["x", "y", "z"]).collect()}
    for place, name in enumerate("xyz"):
        left, right = ([r[place] for r in rows if r[place] is not None and r[place] == r[place]] for rows in (a, b))
        gap, at = plain_distance(left, right)
        assert got[name].distance == pytest.approx(gap, abs=1e-12) and got[name].at_value == at
        assert (got[name].n_reference, got[name].n_current) == (len(left), len(right))
    assert got["x"].drifted and not got["y"].drifted


def test_columns_without_values_and_the_same_rows(spark, loans):
    same = {r.feature: r for r in drift.numeric_drift(loans, loans, ["loan_amnt", "loan_int_rate"]).collect()}
    assert all(r.distance == 0 and not r.drifted for r in same.values()) and len(same) == 2
    empty = drift.numeric_drift(loans, loans.limit(0), ["loan_amnt"]).first()
    assert empty.distance is None and empty.drifted is None and empty.n_current == 0
    assert drift.numeric_drift(loans.limit(0), loans.limit(0), ["loan_amnt"]).count() == 0


def test_no_window_holds_a_whole_column(spark, loans):
    plan = drift.numeric_drift(loans, loans, ["loan_amnt"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(feature" not in plan


def test_text_drift_counts_unseen_values(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    right = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "t string")
    row = drift.text_drift(left, right, ["t"]).first()
    assert (row.n_reference, row.n_current, row.n_unseen) == (4, 4, 2)
    assert row.distance == pytest.approx((0.25 + 0.25 + 0.5 + 0) / 2)


def top(values, k):
    counts = Counter(str(v) for v in values if v is not None)
    return [(i, v, n) for i, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k], 1)]


@pytest.mark.parametrize("counters", [None, 9, 30])
def test_first_values_with_ties(spark, counters):
    random.seed(5)
    values = [int(random.paretovariate(0.7)) for _ in range(3000)] + [None] * 500
    random.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(5)
    for k in (1, 8):
        got = [tuple(r) for r in frequent.frequent_values(df, "v", k, counters).collect()]
        assert got == top(values, k)


def test_values_that_are_all_as_frequent(spark):
    """Nothing can be proven from bounded counters, so all are counted."""
    df = spark.range(5000).select(F.col("id").alias("v"))
    bounds, error = frequent.frequent_bounds(df, "v", 20)
    assert bounds.count() <= 20 * df.rdd.getNumPartitions() and error > 0
    got = [tuple(r) for r in frequent.frequent_values(df, "v", 4, 20).collect()]
    assert got == top(range(5000), 4)


def test_bounds_hold_and_counters_are_few():
    random.seed(6)
    counters, true = frequent.Counters(10), Counter()
    for _ in range(50):
        part = Counter(random.choice("aaaabbbcc" + "".join(map(chr, range(200, 260)))) for _ in range(100))
        true.update(part)
        counters.add(list(part), list(part.values()))
        assert len(counters.counts) <= 10
    for value, n in true.items():
        held = counters.counts.get(value, 0)
        assert held <= n <= held + counters.error


def test_few_or_no_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in frequent.frequent_values(df, "v", 5).collect()] == [(1, "a", 2), (2, "b", 1)]
    assert frequent.frequent_values(df.filter("v IS NULL"), "v", 5).count() == 0
    with pytest.raises(ValueError):
        frequent.frequent_values(df, "v", 0)
    named = frequent.with_frequent_or_other(df, "v", frequent.frequent_values(df, "v", 1))
    assert sorted((r.v or "") for r in named.collect()) == ["", "OTHER VALUE", "a", "a"]
