"""Exact quantiles against sorting in Python, on awkward data and narrow limits."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.operators import quantiles
from fathom.operators.ordering import running_totals
from fathom.operators.quantiles import approx_quantiles, exact_quantiles

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def nearest_rank(values, p):
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    if not known:
        return None
    return known[max(1, math.ceil(Fraction(str(p)) * len(known))) - 1]


def found(frame, *keys):
    return {tuple(r[k] for k in (*keys, "column_name", "p")): r["value"] for r in frame.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e9, 1e9)), min_size=1, max_size=60))
def test_small_lists(spark, values):
    values = [None if v is None else float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    result = found(exact_quantiles(df, ["x"], PROBABILITIES, accuracy=10, max_candidates=3))
    assert result == {("x", p): nearest_rank(values, p) for p in PROBABILITIES}


def skewed(n):
    """A third of the rows share one value; the rest spread over many magnitudes."""
    rng = random.Random(5)
    return [7.0 if i % 3 == 0 else rng.lognormvariate(0, 6) * rng.choice([-1, 1]) for i in range(n)]


@pytest.mark.parametrize("accuracy, max_candidates", [(10_000, 1_000_000), (50, 20), (20, 1)])
def test_skewed_values_with_and_without_narrowing(spark, accuracy, max_candidates):
    values = skewed(5000)
    df = spark.createDataFrame([(v, int(v) % 4 if abs(v) < 1e9 else 0) for v in values], "x double, k int")
    result = found(exact_quantiles(df, ["x", "k"], PROBABILITIES, None, accuracy, max_candidates))
    for p in PROBABILITIES:
        assert result[("x", p)] == nearest_rank(values, p)
        assert result[("k", p)] == nearest_rank([float(int(v) % 4 if abs(v) < 1e9 else 0) for v in values], p)


@pytest.mark.parametrize("max_groups", [10_000, 2])
def test_groups_with_null_key_and_empty_column(spark, monkeypatch, max_groups):
    """With more groups than the limit the full sort takes over; both give the same."""
    monkeypatch.setattr(quantiles, "MAX_GROUPS", max_groups)
    values = skewed(900)
    rows = [(["a", "b", None, "hot", "hot", "hot"][i % 6], v, None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    result = found(exact_quantiles(df, ["x", "y"], [0.25, 0.5], "g", accuracy=30, max_candidates=10), "g")
    for group in ("a", "b", None, "hot"):
        mine = [v for g, v, _ in rows if g == group]
        for p in (0.25, 0.5):
            assert result[(group, "x", p)] == nearest_rank(mine, p)
            assert result[(group, "y", p)] is None


def test_nan_and_null_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert found(exact_quantiles(df, ["x"], [1.0])) == {("x", 1.0): 3.0}


def test_agrees_with_spark_exact_quantiles(spark, loans):
    columns = ["person_income", "loan_percent_income", "person_age"]
    theirs = loans.approxQuantile(columns, [0.25, 0.75], 0.0)
    ours = found(exact_quantiles(loans, columns, [0.25, 0.75]))
    for column, (low, high) in zip(columns, theirs):
        assert (ours[(column, 0.25)], ours[(column, 0.75)]) == (low, high)


def test_approx_is_close(spark, loans):
    exact = found(exact_quantiles(loans, ["person_income"], [0.5]))[("person_income", 0.5)]
    close = found(approx_quantiles(loans, ["person_income"], [0.5]))[("person_income", 0.5)]
    assert abs(exact - close) <= 0.01 * exact


def test_running_totals(spark):
    rows = [(i % 7, i, 1 + i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, n int").repartition(5)
    result = running_totals(df, [F.col("a").desc(), "b"], {"reached": F.col("n"), "place": F.lit(1)})
    expected, total = {}, 0
    for place, (a, b, n) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += n
        expected[b] = (total, place)
    assert {r["b"]: (r["reached"], r["place"]) for r in result.collect()} == expected
    assert result.columns == ["a", "b", "n", "reached", "place"]
