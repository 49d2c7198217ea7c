"""Column rules: pure expressions, so they stay inside whole-stage codegen.

Missing values are NULL everywhere. A comparison with a missing value counts
as false, and a division by zero gives NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder for "not employed", tolerance on amounts, stand-in
# for a missing delay.
EMPLOYED_PLACEHOLDER = 365243
AMOUNT_EPS = 1e-9
NO_DELAY = -999999

# Contract status -> group.
PREVIOUS_STATUS = {
    "Approved": "approved",
    "Refused": "rejected",
    "Active": "active",
    "Unused offer": "unused_offer",
    "Canceled": "canceled",
}

# Bureau month status -> group.
BUREAU_STATUS = {
    "0": "current",
    "1": "dpd_1_30",
    "2": "dpd_31_60",
    "3": "dpd_61_90",
    "4": "dpd_91_120",
    "5": "dpd_120_plus",
    "C": "closed",
    "X": "unknown_or_no_loan",
}
DPD_GROUPS = ["dpd_1_30", "dpd_31_60", "dpd_61_90", "dpd_91_120", "dpd_120_plus"]
DPD30_GROUPS = DPD_GROUPS[1:]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag(condition: Column) -> Column:
    """0/1 with an unknown condition counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def sentinel_to_null(col: Column | str, sentinel: int = EMPLOYED_PLACEHOLDER) -> Column:
    return F.nullif(_c(col), F.lit(sentinel))


def offset_to_years(col: Column | str, digits: int = 2) -> Column:
    return F.bround(-_c(col) / F.lit(365.25), digits)


def safe_ratio(top: Column | str, bottom: Column | str) -> Column:
    return _c(top) / F.nullif(_c(bottom), F.lit(0))


def or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def mapped(col: Column | str, table: dict[str, str], unknown: str, missing: str) -> Column:
    """Look a code up in a fixed table."""
    col = _c(col)
    chain = F.when(col.isNull(), F.lit(missing))
    for code, group in table.items():
        chain = chain.when(col == code, F.lit(group))
    return chain.otherwise(F.lit(unknown))


def previous_status_group(col: Column | str) -> Column:
    return mapped(col, PREVIOUS_STATUS, unknown="other", missing="missing")


def bureau_status_group(col: Column | str) -> Column:
    return mapped(col, BUREAU_STATUS, unknown="other", missing="other")


def is_value(col: Column | str, value: str) -> Column:
    return flag(_c(col) == value)


def is_one_of(col: Column | str, values: Iterable[str]) -> Column:
    return flag(_c(col).isin(list(values)))


def missing_payment(day: Column | str, paid: Column | str) -> Column:
    return flag(_c(day).isNull() | _c(paid).isNull() | (_c(paid) <= 0))


def underpaid(paid: Column | str, due: Column | str) -> Column:
    return flag(or_zero(_c(paid)) + F.lit(AMOUNT_EPS) < or_zero(_c(due)))


def partial_payment(paid: Column | str, due: Column | str) -> Column:
    return flag((or_zero(_c(paid)) > 0) & (or_zero(_c(paid)) + F.lit(AMOUNT_EPS) < or_zero(_c(due))))


def is_late(delay: Column | str) -> Column:
    return flag(F.coalesce(_c(delay), F.lit(NO_DELAY)) > 0)


def positive(col: Column | str) -> Column:
    return flag(_c(col) > 0)


def month_of_day(day: Column | str) -> Column:
    return F.floor(_c(day) / F.lit(30.0)).cast("int")


def day_of_month(month: Column | str) -> Column:
    return _c(month) * F.lit(30)


def snapshot_id(entity: Column | str, ordinal: Column | str) -> Column:
    return F.concat_ws("_", _c(entity).cast("bigint").cast("string"), _c(ordinal).cast("string"))


def instalment_dpd30(delay: Column | str) -> Column:
    return flag(F.coalesce(_c(delay), F.lit(NO_DELAY)) >= 30)


def pos_dpd30(dpd: Column | str, dpd_def: Column | str) -> Column:
    return flag((F.coalesce(_c(dpd), F.lit(0)) >= 30) | (F.coalesce(_c(dpd_def), F.lit(0)) >= 30))


def apply_threshold(score: Column | str, threshold: Column | float) -> Column:
    return (_c(score) >= (F.lit(threshold) if isinstance(threshold, float) else threshold)).cast("int")


def strip_prefix(name: Column | str) -> Column:
    """Drop everything up to the first double underscore."""
    return F.regexp_replace(_c(name), "^.*?__", "")
