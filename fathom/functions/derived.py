"""Derived model features as SQL expressions.

They are text, so that the same definition serves a ``withColumns`` projection and a
``SQLTransformer`` stage inside a saved pipeline.
"""

from __future__ import annotations

from fathom import domain

ZERO_HISTORY_RULES = ("zero", "null")


def _over_history(numerator: str, zero_history: str) -> str:
    history = "cb_person_cred_hist_length"
    if zero_history == "zero":
        return f"CASE WHEN {history} = 0 THEN 0e0 ELSE {numerator} / {history} END"
    if zero_history == "null":
        return f"try_divide({numerator}, {history})"
    raise ValueError(f"zero_history must be one of {ZERO_HISTORY_RULES}, got {zero_history!r}")


def _code_case(column: str, codes: dict, default) -> str:
    arms = " ".join(f"WHEN '{value}' THEN {code}" for value, code in codes.items())
    return f"CASE {column} {arms} ELSE {default} END"


def _bracket_case(column: str, edges: list, codes: list) -> str:
    arms = " ".join(f"WHEN {column} < {edge} THEN {code}" for edge, code in zip(edges, codes))
    return f"CASE WHEN {column} IS NULL THEN NULL {arms} ELSE {codes[-1]} END"


def _onehot(column: str, categories: list, slots: list) -> dict[str, str]:
    return {s: f"CASE WHEN {column} = '{c}' THEN 1 ELSE 0 END" for s, c in zip(slots, categories)}


def status_expressions(zero_history: str = "zero") -> dict[str, str]:
    """Default flag, remaining income and working years, history ratios, income bracket."""
    return {
        "cb_person_default_on_file_binary": "CASE WHEN cb_person_default_on_file = 'Y' THEN 1 ELSE 0 END",
        "remaining_income_to_receive": "CAST(person_income AS BIGINT) * (80 - person_age)",
        "remaining_employment_length": "65 - person_age",
        "age_to_history_length_ratio": _over_history("person_age", zero_history),
        "income_bracket": _bracket_case("person_income", domain.INCOME_EDGES, domain.INCOME_CODES),
        "credit_risk": _over_history("(loan_amnt * loan_int_rate)", zero_history),
    }


def grade_expressions() -> dict[str, str]:
    """Age at first credit (log), interest amount, short employment."""
    return {
        "age_minus_history": "log1p(person_age - cb_person_cred_hist_length)",
        "actual_loan_interest": "loan_amnt * loan_int_rate",
        "employment_stability": "CASE WHEN person_emp_length < 2 THEN 1 ELSE 0 END",
    }


def onehot_expressions() -> dict[str, str]:
    return {
        **_onehot("person_home_ownership", domain.OWNERSHIP_ONEHOT, domain.OWNERSHIP_SLOTS),
        **_onehot("loan_intent", domain.INTENT_ONEHOT, domain.INTENT_SLOTS),
    }


def no_default_expression() -> dict[str, str]:
    return {"no_default_on_file": "CASE WHEN cb_person_default_on_file = 'N' THEN 1 ELSE 0 END"}


def ordinal_expressions() -> dict[str, str]:
    """Categories as codes. The default flag may arrive as Y/N, 1/0 or true/false."""
    text = "lower(CAST(cb_person_default_on_file AS STRING))"
    return {
        "home_ownership_num": _code_case(
            "person_home_ownership", domain.OWNERSHIP_CODES, domain.OWNERSHIP_OTHER_CODE
        ),
        "loan_intent_num": _code_case("loan_intent", domain.INTENT_CODES, domain.INTENT_OTHER_CODE),
        "default_on_file_num": f"CASE WHEN {text} IN ('n', '0', 'false') THEN 0 ELSE 1 END",
    }


def layout_expressions(layout: str, zero_history: str = "zero") -> tuple[list[str], dict[str, str]]:
    """Ordered feature columns of a layout and the expressions that derive the missing ones."""
    if layout == "status":
        return domain.STATUS_LAYOUT, {**status_expressions(zero_history), **onehot_expressions()}
    if layout == "grade":
        derived = {**grade_expressions(), **onehot_expressions(), **no_default_expression()}
        return domain.GRADE_LAYOUT, derived
    if layout == "grade_ordinal":
        return domain.GRADE_ORDINAL_LAYOUT, {**grade_expressions(), **ordinal_expressions()}
    raise ValueError(f"unknown layout {layout!r}")
