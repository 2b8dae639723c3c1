"""CSV export of a filtered event list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import with_previews
from tidelog.functions.times import iso_text
from tidelog.operators.paging import event_order
from tidelog.schema import EXPORT_HEADERS

# Rows of an export and characters of its long texts.
EXPORT_ROWS = 10_000
EXPORT_TEXT = 1000
CUT_COLUMNS = ("context", "sql", "exception", "planSQLText", "sdbl")


def export_rows(events: DataFrame, headers: bool = False) -> DataFrame:
    """The newest rows with missing values as empty text and long texts cut."""

    def cell(name: str):
        c = F.col(name)
        if name == "timestamp":
            out = iso_text(c)
        elif name == "duration_ms":
            return F.coalesce(c, F.lit(0.0))
        elif name in CUT_COLUMNS:
            out = c
        else:
            out = c.cast("string")
        return F.coalesce(out, F.lit(""))

    newest = with_previews(events, CUT_COLUMNS, EXPORT_TEXT).orderBy(*event_order("timestamp", "desc")).limit(EXPORT_ROWS)
    return newest.select(
        *[cell(name).alias(header if headers else name) for name, header in EXPORT_HEADERS.items()]
    )


def write_csv(events: DataFrame, path: str) -> None:
    """One CSV file with localized headers; every field is quoted."""
    (
        export_rows(events, headers=True)
        .coalesce(1)  # at most EXPORT_ROWS rows
        .write.option("sep", ";")
        .option("header", "true")
        .option("quoteAll", "true")
        .option("escape", '"')
        .csv(path)
    )
