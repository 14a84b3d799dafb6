"""Interval buckets as plain expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom import domain


def bucketize(value: Column | str, edges: Sequence[float], labels: Sequence) -> Column:
    """Label of the left-closed interval that holds ``value``; null stays null.

    ``edges`` ascend and split the line into ``len(edges) + 1`` intervals.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError(f"{len(edges)} edges need {len(edges) + 1} labels, got {len(labels)}")
    if list(edges) != sorted(set(edges)):
        raise ValueError("edges must be strictly ascending")
    value = F.col(value) if isinstance(value, str) else value
    chain = F.when(value.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        chain = chain.when(value < F.lit(edge), F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def age_bucket(value: Column | str = "person_age") -> Column:
    return bucketize(value, domain.AGE_EDGES, domain.AGE_LABELS)


def income_bucket(value: Column | str = "person_income") -> Column:
    return bucketize(value, domain.INCOME_EDGES, domain.INCOME_LABELS)


def income_bracket(value: Column | str = "person_income") -> Column:
    """Income bucket as a code from 1 to 6."""
    return bucketize(value, domain.INCOME_EDGES, domain.INCOME_CODES)
