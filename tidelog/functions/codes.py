"""Database error codes and the severity / category rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import ERROR_DESCRIPTIONS

# Patterns of an error code, the first that matches counts.
ERROR_CODE_PATTERNS = (
    r"(?i)native=(\d+)",
    r"(?i)Error[:\s]+(\d+)",
    r"(?i)SQLState[=:]?(\d{5})",
)
# Thresholds of the classification rules.
SLOW_MS = 1000
VERY_SLOW_MS = 5000


# Whether any of them can match: one pass over the many texts without a code.
ANY_ERROR_CODE = r"(?i)native=\d|Error[:\s]+\d|SQLState[=:]?\d{5}"


def error_code_digits(text: Column) -> Column:
    """The digits of the first matching pattern in one text; NULL if none."""
    native, error, state = [F.regexp_extract(text, p, 1) for p in ERROR_CODE_PATTERNS]
    return F.when(
        text.rlike(ANY_ERROR_CODE),
        F.when(text.rlike(ERROR_CODE_PATTERNS[0]), native)
        .when(text.rlike(ERROR_CODE_PATTERNS[1]), error)
        .otherwise(state),
    )


def error_code(*texts: Column) -> Column:
    """The first non-zero code over the texts in order.

    A code beyond the range comes back as some number beyond it, which the
    loader rejects.
    """

    def one(text: Column) -> Column:
        # A zero code is empty without its leading zeros; more than 18 digits
        # may not fit BIGINT and are far beyond the range anyway.
        digits = F.ltrim(error_code_digits(text), F.lit("0"))
        return F.when(F.length(digits) > 18, F.lit(10**18)).otherwise(digits.try_cast("bigint"))

    return F.coalesce(*[one(t) for t in texts])


def describe_error(code: Column, default: str) -> Column:
    """Description of a code from the fixed ten-entry table."""
    pairs = [c for key, text in ERROR_DESCRIPTIONS.items() for c in (F.lit(key).cast("bigint"), F.lit(text))]
    table = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(table, code.cast("bigint")), F.lit(default))


def category(event_name: Column, locks: Column, has_error: Column, ms: Column) -> Column:
    name = F.upper(event_name)
    return (
        F.when(name.contains("DBMSSQL") | name.contains("SDBL"), "database")
        .when(name.contains("LOCK") | (locks != ""), "lock")
        .when(name.contains("ERROR") | has_error, "error")
        .when(ms > SLOW_MS, "performance")
        .otherwise("info")
    )


def severity(level: Column, has_error: Column, ms: Column) -> Column:
    return (
        F.when(has_error | (level >= 4), "critical")
        .when((ms > VERY_SLOW_MS) | (level >= 3), "high")
        .when((ms > SLOW_MS) | (level >= 2), "medium")
        .otherwise("low")
    )


def classified(df: DataFrame, rules: str = "rules") -> DataFrame:
    """Add ``severity`` and ``category``: by the rules, or the two constants."""
    if rules == "constant":
        return df.withColumns({"severity": F.lit("info"), "category": F.lit("other")})
    if rules != "rules":
        raise ValueError("rules must be 'rules' or 'constant'")
    ms = F.col("duration_ms")
    has_error = (F.col("exception") != "") | F.coalesce(F.col("mssql_error_code") > 0, F.lit(False))
    return df.withColumns(
        {
            "severity": severity(F.col("level"), has_error, ms),
            "category": category(F.col("event_name"), F.col("locks"), has_error, ms),
        }
    )
