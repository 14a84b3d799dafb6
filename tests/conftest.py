from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from fathom import domain  # noqa: E402
from fathom.session import local_session  # noqa: E402
from fathom.sources import derived_tables  # noqa: E402
from fathom.sources.readers import loans_from_rows  # noqa: E402
from loan_rows import NULL_ROWS, TEST_ROWS, TRAIN_ROWS  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def loans(spark):
    return derived_tables.loan_applications(spark, SF_DIR).persist()


@pytest.fixture(scope="session")
def scored(spark):
    return derived_tables.loan_scored(spark, SF_DIR).persist()


@pytest.fixture(scope="session")
def train_rows(spark):
    return loans_from_rows(spark, TRAIN_ROWS)


@pytest.fixture(scope="session")
def test_rows(spark):
    return loans_from_rows(spark, TEST_ROWS).drop("loan_grade", "loan_status")


@pytest.fixture(scope="session")
def null_rows(spark):
    return loans_from_rows(spark, NULL_ROWS)


@pytest.fixture
def loan_row(spark):
    """A loan table of one row with some fields replaced."""

    def make(**changes):
        values = dict(zip(domain.LOAN_SCHEMA.names, TRAIN_ROWS[0])) | changes
        return loans_from_rows(spark, [tuple(values[n] for n in domain.LOAN_SCHEMA.names)])

    return make
