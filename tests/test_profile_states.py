"""Profiles that follow the files: the same as one pass over what is there."""

import pytest
from pyspark.sql import functions as F

from fathom.operators import correlation, profile_states, profiling


def write(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)
    return folder


def close(frame, key):
    return {tuple(r[k] for k in key): [r[c] for c in frame.columns if c not in key] for r in frame.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12), k


def test_three_arrivals_and_a_removal_equal_one_pass(spark, loans, tmp_path):
    dirty = loans.drop("loan_grade").withColumn("loan_amnt", F.when(F.col("id") % 7 > 0, F.col("loan_amnt")))
    parts = [dirty.filter(F.col("id") % 3 == i) for i in range(3)]
    folders = [str(tmp_path / f"part {i}") for i in range(3)]
    state = None
    for i in range(3):
        write(parts[i], folders[i])
        state = profile_states.refresh(spark, folders[: i + 1], state)
    columns = ["column_name", "n", "mean", "stddev", "min_value", "max_value"]
    whole = profiling.describe_numeric(dirty)
    whole = whole.select(*(c for c in columns if c in whole.columns))
    described = profile_states.described(state)
    same(close(described.select(*whole.columns), ["column_name"]), close(whole, ["column_name"]))
    pairs = correlation.correlation_matrix(dirty)
    same(close(profile_states.correlations(state), ["column1", "column2"]), close(pairs, ["column1", "column2"]))
    # The second folder goes, and a file is added to the third.
    write(parts[0].limit(50), folders[2])
    state = profile_states.refresh(spark, [folders[0], folders[2]], state)
    left = parts[0].union(parts[2]).union(spark.read.parquet(folders[2]).filter(F.col("id") % 3 == 0))
    whole = profiling.describe_numeric(left).select(*whole.columns)
    same(close(profile_states.described(state).select(*whole.columns), ["column_name"]), close(whole, ["column_name"]))


def test_only_new_files_are_read(spark, loans, tmp_path, monkeypatch):
    folder = write(loans.select("loan_amnt", "loan_int_rate"), str(tmp_path / "a"))
    state = profile_states.refresh(spark, [folder])
    read = []
    original = profile_states.file_states
    monkeypatch.setattr(profile_states, "file_states", lambda rows, columns: read.append(len(rows.inputFiles())) or original(rows, columns))
    again = profile_states.refresh(spark, [folder], state)
    assert not read and again.count() == state.count()
    write(loans.select("loan_amnt", "loan_int_rate").limit(10), folder)
    more = profile_states.refresh(spark, [folder], again)
    assert read == [1] and more.count() == 2 * state.count()


def test_sketched_quantiles_are_near(spark, loans, tmp_path):
    folders = [write(loans.filter(F.col("id") % 2 == i), str(tmp_path / str(i))) for i in range(2)]
    state = profile_states.refresh(spark, folders, columns=["loan_int_rate"])
    n = loans.count()
    for r in profile_states.quantiles(state, [0.1, 0.5, 0.9]).collect():
        rank = loans.filter(F.col("loan_int_rate") <= r.value).count() / n
        assert abs(rank - r.share) < 0.03


def test_columns_of_one_value_and_without_values(spark, tmp_path):
    rows = [(1, 2.0, None), (1, float("nan"), None), (1, 4.0, None)]
    folder = write(spark.createDataFrame(rows, "a int, b double, c double"), str(tmp_path / "x"))
    state = profile_states.refresh(spark, [folder])
    got = {r.column_name: (r.n, r.n_missing, r.mean, r.stddev) for r in profile_states.described(state).collect()}
    assert got["a"] == (3, 0, 1.0, 0.0) and got["c"] == (0, 3, None, None)
    assert got["b"] == (2, 1, 3.0, pytest.approx(2**0.5))
    assert profile_states.correlations(state).count() == 0
