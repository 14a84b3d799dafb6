"""A tree of rules over the loan table, whose counts and rates follow from the rows."""

from __future__ import annotations


def _leaf_or(column: str, up_to: float, low: dict | None = None, high: dict | None = None) -> dict:
    return {"column": column, "up_to": up_to, "low": low, "high": high}


# The amount's share of income decides, then interest and income; the share comes twice on one path.
APPROVAL_RULES = _leaf_or(
    "loan_percent_income",
    0.31,
    low=_leaf_or("loan_int_rate", 14.0, high=_leaf_or("loan_percent_income", 0.15)),
    high=_leaf_or("person_income", 50_000, high=_leaf_or("loan_int_rate", 10.0)),
)
RESPONSE_GRID = [0.05, 0.15, 0.2, 0.31, 0.4, 2.0]
