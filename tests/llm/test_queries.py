"""Registration, and every oracle on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle_check import compare  # noqa: E402

from fathom.llm.queries import ORACLES, QUERIES  # noqa: E402


def test_one_query_for_each_operator_and_the_pipeline():
    import __spark_entry__ as entry_module

    names = set(entry_module.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(QUERIES) <= names and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(spark, sf_dir, name):
    assert compare(spark, sf_dir, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op1_fingerprints", "op6_license_scan"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
