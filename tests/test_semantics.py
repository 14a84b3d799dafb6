"""Where behaviour is easy to get wrong: nulls, zero divisors, overflow, label meaning."""

import math

import pytest
from pyspark.sql import functions as F

from fathom import domain
from fathom.functions import codes
from fathom.functions.buckets import age_bucket, bucketize, income_bracket, income_bucket
from fathom.functions.numeric import fixed, round_half_up
from fathom.operators import correlation, encoding, features, outliers, profiling
from fathom.operators.splitting import key_slot, split


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_empty_history_is_zero_or_null(loan_row):
    row = loan_row(cb_person_cred_hist_length=0)
    zero = only(features.status_features(row, "zero"))
    assert (zero["age_to_history_length_ratio"], zero["credit_risk"]) == (0.0, 0.0)
    null = only(features.status_features(row, "null"))
    assert (null["age_to_history_length_ratio"], null["credit_risk"]) == (None, None)
    with pytest.raises(ValueError):
        features.status_features(row, "skip")


@pytest.mark.parametrize("value, code", [("N", 0), ("Y", 1), ("0", 0), ("1", 1), ("false", 0), ("true", 1)])
def test_default_flag_code(loan_row, value, code):
    row = features.grade_features_ordinal(loan_row(cb_person_default_on_file=value))
    assert only(row)["default_on_file_num"] == code


def test_default_flag_code_of_numbers(loan_row):
    for value, code in ((0, 0), (1, 1)):
        row = loan_row().withColumn("cb_person_default_on_file", F.lit(value))
        assert only(features.grade_features_ordinal(row))["default_on_file_num"] == code


def test_null_stays_null_in_buckets(spark):
    row = only(
        spark.range(1).select(
            age_bucket(F.lit(None).cast("int")).alias("a"),
            income_bucket(F.lit(None).cast("int")).alias("i"),
            income_bracket(F.lit(None).cast("int")).alias("c"),
        )
    )
    assert tuple(row) == (None, None, None)


def test_bucket_edges_are_left_closed(spark):
    ages = spark.createDataFrame([(a,) for a in (24, 25, 34, 35, 64, 65, 120)], "person_age int")
    labels = [r[0] for r in ages.select(age_bucket()).collect()]
    assert labels == ["Under 25", "25-34", "25-34", "35-44", "55-64", "65+", "65+"]
    incomes = spark.createDataFrame([(29999,), (30000,), (149999,), (150000,)], "person_income int")
    assert [r[0] for r in incomes.select(income_bracket()).collect()] == [1, 2, 5, 6]
    with pytest.raises(ValueError):
        bucketize("x", [1, 2], ["a", "b"])
    with pytest.raises(ValueError):
        bucketize("x", [2, 1], ["a", "b", "c"])


def test_large_income_does_not_overflow(loan_row):
    row = features.status_features(loan_row(person_income=2_000_000_000, person_age=20))
    assert only(row)["remaining_income_to_receive"] == 120_000_000_000


def test_log_of_impossible_history_is_null(loan_row):
    assert only(features.grade_features(loan_row(person_age=5, cb_person_cred_hist_length=6)))["age_minus_history"] is None
    fine = only(features.grade_features(loan_row(person_age=25, cb_person_cred_hist_length=5)))
    assert fine["age_minus_history"] == pytest.approx(math.log(21))


def test_null_flags_are_zero(loan_row):
    assert only(features.status_features(loan_row(cb_person_default_on_file=None)))["cb_person_default_on_file_binary"] == 0
    assert only(features.grade_features(loan_row(person_emp_length=None)))["employment_stability"] == 0


def test_null_is_no_outlier(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)] + [(1000.0,), (None,)], "x double")
    flagged = {r["x"]: r["x_outlier"] for r in outliers.flag_outliers(df, ["x"]).collect()}
    assert [v for v, flag in flagged.items() if flag] == [1000.0]
    assert flagged[None] is False


def test_index_is_fitted_once(spark, train_rows, test_rows):
    index = encoding.category_index(train_rows, "loan_intent")
    numbers = {r["loan_intent"]: r["index"] for r in index.collect()}
    assert sorted(numbers, key=numbers.get) == sorted(numbers)  # all once, so by name
    found = encoding.with_index(test_rows, index, "loan_intent").collect()
    assert {r["loan_intent"]: r["loan_intent_index"] for r in found} == {
        r["loan_intent"]: numbers[r["loan_intent"]] for r in found
    }


def test_unseen_category_is_an_error_or_kept(spark, train_rows, loan_row):
    unseen, index = loan_row(loan_intent="VENTURE"), encoding.category_index(train_rows, "loan_intent")
    with pytest.raises(Exception, match="Unseen label"):
        encoding.with_index(unseen, index, "loan_intent").collect()
    kept = encoding.with_index(unseen, index, "loan_intent", unseen="keep")
    assert only(encoding.onehot_by_index(kept, "loan_intent", 2))["loan_intent_onehot_0"] == 0


def test_correlation_ignores_values_that_are_no_numbers(spark):
    rows = [(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (4.0, 8.0), (float("nan"), 1.0), (float("inf"), 1.0)]
    found = correlation.correlation_matrix(spark.createDataFrame(rows, "a double, b double"), digits=2).collect()
    assert [tuple(r) for r in found] == [("a", "b", 1.0)]  # shown rounded, decided unrounded


def test_frequency_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "x string")
    assert [(r["x"], r["n"], r["index"]) for r in encoding.category_index(df, "x").orderBy("index").collect()] == [
        ("c", 2, 0.0),
        ("a", 1, 1.0),
        ("b", 1, 2.0),
    ]


def test_fixed_onehot_leaves_the_last_category_out(loan_row):
    row = only(encoding.onehot_loans(loan_row(person_home_ownership="OTHER", loan_intent="HOMEIMPROVEMENT")))
    assert [row[s] for s in domain.OWNERSHIP_SLOTS + domain.INTENT_SLOTS] == [0] * 8
    row = only(encoding.onehot_loans(loan_row(person_home_ownership="OWN", loan_intent=None)))
    assert [row[s] for s in domain.OWNERSHIP_SLOTS + domain.INTENT_SLOTS] == [0, 0, 1] + [0] * 5


def test_correlation_skips_null_pairs_and_constants(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, None, 5.0), (4.0, 7.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    pairs = {(r[0], r[1]): r[2] for r in correlation.correlation_matrix(df).collect()}
    known = [(1, 2), (2, 4.5), (4, 7)]
    mean_a, mean_b = sum(a for a, _ in known) / 3, sum(b for _, b in known) / 3
    up = sum((a - mean_a) * (b - mean_b) for a, b in known)
    down = math.sqrt(sum((a - mean_a) ** 2 for a, _ in known) * sum((b - mean_b) ** 2 for _, b in known))
    assert pairs.keys() == {("a", "b")}
    assert pairs[("a", "b")] == pytest.approx(up / down)


def test_perfect_correlation_is_dropped(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i)) for i in range(1, 9)], "a double, b double, c double")
    assert [tuple(r)[:2] for r in correlation.correlation_matrix(df, digits=9).collect()] == [("a", "c"), ("b", "c")]


def test_null_group_is_kept_or_dropped(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), (None, 1), (None, 1), (None, 0)], "g string, t int")
    for method in ("window", "join"):
        kept = {(r["g"], r["t"]): r["percentage"] for r in profiling.share_within(df, ["g"], "t", method=method).collect()}
        assert kept == {("x", 0): 50.0, ("x", 1): 50.0, (None, 0): 1 / 3 * 100, (None, 1): 2 / 3 * 100}
        dropped = profiling.share_within(df, ["g"], "t", drop_null_groups=True, method=method)
        assert {r["g"] for r in dropped.collect()} == {"x"}


def test_count_in_shares_ignores_null_targets(spark):
    df = spark.createDataFrame([("x", 1), ("x", None)], "g string, t int")
    counts = {r["t"]: (r["count"], r["total_count"]) for r in profiling.share_within(df, ["g"], "t").collect()}
    assert counts == {1: (1, 1), None: (0, 1)}


def test_grade_codes_round_trip(spark):
    df = spark.createDataFrame([(g,) for g in domain.GRADES] + [("X",), (None,)], "g string")
    back = [r[0] for r in df.select(codes.decode_grade(codes.encode_grade("g"))).collect()]
    assert back == [*domain.GRADES, None, None]
    out = spark.createDataFrame([(7.0,), (-1.0,), (0.5,)], "p double").select(codes.decode_grade("p")).collect()
    assert [r[0] for r in out] == [None] * 3


def test_invalid_rows_are_skipped_kept_or_an_error(null_rows, train_rows):
    rows = null_rows.unionByName(train_rows)
    assert features.assemble(rows, "status", "skip").count() == 3
    assert features.assemble(rows, "status", "keep").count() == 5
    with pytest.raises(Exception, match="null"):
        features.assemble(rows, "status", "error").collect()
    assert tuple(only(features.assembled_counts(rows, "status"))) == (5, 3, 2)


def test_split_depends_on_key_and_seed_only(loans):
    train, validation = split(loans, seed=3)
    assert train.count() + validation.count() == loans.count()
    assert 0.7 < train.count() / loans.count() < 0.9
    again, _ = split(loans.repartition(7), seed=3)
    assert {r["id"] for r in train.select("id").collect()} == {r["id"] for r in again.select("id").collect()}
    other, _ = split(loans, seed=4)
    assert other.exceptAll(train).count() > 0
    assert loans.select(key_slot("id", 1, 5).alias("s")).distinct().count() == 5


def test_one_means_approved(spark):
    decisions = spark.createDataFrame([(1.0,), (0.0,), (None,)], "p double").select(codes.decode_status("p"))
    assert [r[0] for r in decisions.collect()] == ["ACCEPTED", "REJECTED", None]


def test_rounding_and_fixed_text(spark):
    row = only(
        spark.range(1).select(
            round_half_up(F.lit(2.5)), round_half_up(F.lit(-2.5)), fixed(F.lit(8.35), 1, "%%"), fixed(F.lit(None), 2)
        )
    )
    assert tuple(row) == (3, -2, "8.4%", None)


def test_percent_income_of_no_income_is_null(loan_row):
    assert only(features.percent_income(loan_row(person_income=0)))["loan_percent_income"] is None


def test_layouts_have_the_declared_slots(train_rows):
    widths = {layout: len(features.layout_columns(train_rows, layout).columns) for layout in ("status", "grade", "grade_ordinal")}
    assert widths == {"status": 20, "grade": 19, "grade_ordinal": 13}
