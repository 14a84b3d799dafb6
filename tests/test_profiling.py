"""Profiles on literal rows and on tables that are not loans."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.operators import correlation, outliers, profiling
from fathom.functions.buckets import age_bucket
from fathom.sources import derived_tables, readers, writers


def test_class_balance(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (None,)], "loan_status int")
    row = profiling.class_balance(df).first()
    assert tuple(row) == (4, 2, 1, pytest.approx(1 / 3))


def test_class_balance_of_nothing(spark):
    assert tuple(profiling.class_balance(spark.createDataFrame([], "loan_status int")).first()) == (0, 0, 0, None)


def test_describe_agrees_with_spark(loans):
    ours = {r["column_name"]: r for r in profiling.describe_numeric(loans, ["loan_amnt"]).collect()}["loan_amnt"]
    theirs = {r["summary"]: r["loan_amnt"] for r in loans.describe("loan_amnt").collect()}
    assert ours["n"] == int(theirs["count"])
    assert ours["mean"] == pytest.approx(float(theirs["mean"]))
    assert ours["stddev"] == pytest.approx(float(theirs["stddev"]))
    assert (ours["min"], ours["max"]) == (float(theirs["min"]), float(theirs["max"]))


def test_describe_text_is_text(loans):
    rows = profiling.describe_text(loans, ["loan_amnt", "loan_intent"]).collect()
    assert [r["summary"] for r in rows] == ["count", "mean", "stddev", "min", "max"]
    parsed = [json.loads(r["json"]) for r in writers.as_json(profiling.describe_text(loans, ["loan_amnt"])).collect()]
    assert {p["summary"] for p in parsed} == {"count", "mean", "stddev", "min", "max"}


def test_histogram_counts_every_known_value(spark):
    df = spark.createDataFrame([(float(v), 4, None) for v in range(11)] + [(None, 4, None), (float("nan"), 4, None)], "x double, c int, e double")
    rows = profiling.histogram(df, ["x", "c", "e"], bins=5).collect()
    by_bin = {r["bin"]: r["n"] for r in rows if r["column_name"] == "x"}
    assert by_bin == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert [(r["bin"], r["n"]) for r in rows if r["column_name"] == "c"] == [(0, 13)]
    assert not [r for r in rows if r["column_name"] == "e"]


def test_histogram_leaves_infinite_values_out_and_counts_them(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("inf"),), (float("-inf"),)], "x double")
    rows = profiling.histogram(df, ["x"], bins=2).collect()
    assert sum(r["n"] for r in rows) == 3 and {r["n_infinite"] for r in rows} == {2}
    assert {(r["bin_start"], r["bin_end"]) for r in rows} == {(1.0, 2.0), (2.0, 3.0)}


def test_generic_tables(spark, sf_dir):
    events = derived_tables.driver_table(spark, sf_dir, "events")
    assert outliers.outlier_counts(events, ["value"]).first()["n_outliers"] == 31
    parts = derived_tables.driver_table(spark, sf_dir, "part")
    shares = profiling.share_within(parts, ["p_brand"], "p_type").groupBy("p_brand").agg(F.sum("percentage").alias("s"))
    assert all(r["s"] == pytest.approx(100.0) for r in shares.collect())
    customers = derived_tables.driver_table(spark, sf_dir, "customer")
    rates = profiling.mean_by(customers, F.col("c_mktsegment"), "segment", "c_acctbal", "mean_balance").collect()
    assert [r["segment"] for r in rates] == sorted(r["segment"] for r in rates)
    names = profiling.numeric_columns(parts, exclude=["p_partkey"])
    assert correlation.correlation_with(parts, "p_retailprice", names).count() == len(names) - 1


def test_outlier_fixture_counts(loans):
    counts = {r[0]: r[1] for r in outliers.outlier_counts(loans, ["person_income", "loan_percent_income"]).collect()}
    assert counts == {"person_income": 0, "loan_percent_income": 150}


def test_impute_by_age_median(spark):
    rows = [(20, 1.0), (21, 3.0), (22, 5.0), (24, None), (40, 10.0), (41, 12.0), (42, None), (None, None), (70, None)]
    df = spark.createDataFrame(rows, "person_age int, x double")
    fixed = outliers.impute_group_median(df, ["x"], age_bucket(), "bucket", repair_outliers=False)
    values = {r["person_age"]: r["x"] for r in fixed.collect()}
    assert values == {20: 1.0, 21: 3.0, 22: 5.0, 24: 3.0, 40: 10.0, 41: 12.0, 42: 10.0, None: None, 70: None}
    spread = spark.createDataFrame([(30, float(v)) for v in range(20)] + [(30, 5000.0)], "person_age int, x double")
    repaired = outliers.impute_group_median(spread, ["x"], age_bucket())
    assert repaired.agg(F.max("x")).first()[0] == 19.0 and repaired.filter("x = 10").count() == 2


def test_approximate_quartiles_have_the_same_shape(loans):
    exact = outliers.iqr_bounds(loans, ["loan_amnt"]).first()
    close = outliers.iqr_bounds(loans, ["loan_amnt"], exact=False).first()
    assert exact["column_name"] == close["column_name"]
    assert exact["upper_bound"] == pytest.approx(close["upper_bound"], rel=0.05)


def test_schema_and_preview(loans):
    shape = readers.table_shape(loans).collect()
    assert {(r["n_rows"], r["n_columns"]) for r in shape} == {(1500, 13)}
    assert [r["column_name"] for r in readers.schema_frame(loans).orderBy("position").collect()] == loans.columns
    assert [r["id"] for r in readers.preview(loans, 3, F.col("id").desc()).collect()] == [1499, 1498, 1497]


def test_correlations_come_from_aggregates_without_fanning_out(spark, loans):
    """Rows are aggregated as they are; only the one row of sums is dealt out to the pairs."""
    plan = correlation.correlation_matrix(loans)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") :]
    assert "Generate" not in below and plan.count("Generate") == 1
