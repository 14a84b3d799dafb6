"""Every query with an oracle gives the oracle's rows, names and types."""

import pytest
from oracle_check import compare

from fathom.plans.oracles import ORACLES
from fathom.plans.queries import QUERIES


# 300 rounds of boosting take minutes; the learner is tested with fewer in test_models.
SLOW = {"score_status_gbt"}


@pytest.mark.parametrize("name", sorted(ORACLES.keys() - SLOW))
def test_same_as_oracle(spark, sf_dir, name):
    assert compare(spark, sf_dir, QUERIES[name], ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry_module

    assert entry_module.entry(spark).count() == 6
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLES.items() <= entry_module.oracle_sql().items()
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()
