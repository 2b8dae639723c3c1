"""Whole numbers in texts, and exact rounding of their ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(text: Column) -> Column:
    """The number a text holds; NULL if it is none.

    A cast that fails raises and catches an error, some 20 microseconds for
    each row, so a text without a digit, as the many empty ones, is not cast.
    """
    return F.when(text.rlike("[0-9]"), text.try_cast("bigint"))


def round_ratio(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` of non-negative whole numbers, rounded half-up, as a double.

    The rounding is done on whole numbers, so it does not depend on the order
    in which partial sums were added. NULL when ``den`` is zero or NULL.
    """
    scale = 10**digits
    wide = num.cast("decimal(28,0)") * F.lit(2 * scale) + den.cast("decimal(28,0)")
    safe_den = F.when(den != 0, den).cast("decimal(28,0)") * F.lit(2)
    return F.call_function("div", wide, safe_den).cast("double") / F.lit(float(scale))


def ceil_div(num: Column, den: int) -> Column:
    return F.call_function("div", num + F.lit(den - 1), F.lit(den)).cast("bigint")
