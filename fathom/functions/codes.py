"""Value-to-code maps, decoding and fixed-list one-hot columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom import domain


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def code_map(value: Column | str, codes: Mapping, default) -> Column:
    """Map each listed value to its code, anything else (null too) to ``default``."""
    value = _col(value)
    chain = None
    for key, code in codes.items():
        arm = (value == F.lit(key), F.lit(code))
        chain = F.when(*arm) if chain is None else chain.when(*arm)
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def onehot_fixed(value: Column | str, categories: Sequence, prefix: str) -> dict[str, Column]:
    """``<prefix>_<i>`` int columns in list order; unlisted values and nulls are all zero."""
    value = _col(value)
    return {f"{prefix}_{i}": flag(value == F.lit(c)) for i, c in enumerate(categories)}


def decode_grade(code: Column | str) -> Column:
    """Model class to grade letter; a code outside the seven classes is null."""
    return code_map(code, {float(i): g for i, g in enumerate(domain.GRADES)}, None)


def encode_grade(grade: Column | str) -> Column:
    return code_map(grade, {g: float(i) for i, g in enumerate(domain.GRADES)}, None)


def decode_status(prediction: Column | str) -> Column:
    prediction = _col(prediction)
    return (
        F.when(prediction.isNull(), F.lit(None))
        .when(prediction == 0, F.lit(domain.REJECTED))
        .otherwise(F.lit(domain.ACCEPTED))
    )
