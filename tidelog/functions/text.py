"""Text helpers: decoding, previews, and the property list of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text in quotes; a doubled quote stands for itself.
_IN_DOUBLE, _IN_SINGLE = r'"(?:[^"]++|"")*+"', r"'(?:[^']++|'')*+'"
# One property: a key at the start of the text or after a comma, then its value
# up to the next comma outside quotes. Quoted parts may stand anywhere in a
# value; a quote that is never closed is a plain character. All repetitions are
# possessive and a match can only start at a comma, so the scan is linear even
# on texts of many megabytes.
PROPERTY = rf"""(?:^|,)\s*+([^=,\s][^=,]*+)=\s*+((?:[^,"']++|{_IN_DOUBLE}|{_IN_SINGLE}|["'])*+)"""


def preview(column: str | Column, length: int) -> Column:
    """The first ``length`` characters; NULL for an empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != "", F.substring(c, 1, length))


def with_previews(df: DataFrame, columns: tuple[str, ...], length: int) -> DataFrame:
    """The long texts cut for display. Done ahead of a sort, so that a top-k
    holds only what is shown of each row."""
    return df.withColumns({name: preview(name, length) for name in columns})


def single_byte_text(raw: Column, codepage: str) -> Column:
    """Decode bytes of a single-byte code page without leaving the JVM.

    ISO-8859-1 maps byte n to character n; the upper half is then translated
    to the code page's characters. Undefined bytes become U+FFFD.
    """
    upper = [bytes([n]).decode(codepage, "replace") for n in range(128, 256)]
    latin = "".join(chr(n) for n in range(128, 256))
    return F.translate(F.decode(raw.cast("binary"), "ISO-8859-1"), latin, "".join(upper))


def single_byte_bytes(text: Column, codepage: str) -> Column:
    """The bytes of a text in a single-byte code page: the inverse of ``single_byte_text``."""
    upper = {n: bytes([n]).decode(codepage, "replace") for n in range(128, 256)}
    known = {n: c for n, c in upper.items() if c != "\ufffd"}
    return F.encode(F.translate(text, "".join(known.values()), "".join(map(chr, known))), "ISO-8859-1")


def property_arrays(text: Column) -> tuple[Column, Column]:
    """Keys and unquoted values of a property list, last occurrence first."""
    keys = F.reverse(F.regexp_extract_all(text, F.lit(PROPERTY), F.lit(1)))
    values = F.reverse(F.regexp_extract_all(text, F.lit(PROPERTY), F.lit(2)))
    return F.transform(keys, trim_all), F.transform(F.transform(values, trim_all), unquote)


def property_values(keys: Column, values: Column, wanted: list[str]) -> Column:
    """The last value given for each wanted key, as an array; NULL when absent.

    The one-element outer array binds the two lists to a variable, so they are
    computed once per row and not once per wanted key.
    """
    return listed_values(F.array(F.struct(keys.alias("keys"), values.alias("values"))), wanted)


def listed_values(lists: Column, wanted: list[str]) -> Column:
    """``property_values`` of an array with one struct of ``keys`` and ``values``."""
    names = F.array(*[F.lit(key) for key in wanted])

    def look_up(pair: Column) -> Column:
        return F.transform(
            names, lambda key: F.get(pair["values"], F.array_position(pair["keys"], key).cast("int") - 1)
        )

    return F.get(F.transform(lists, look_up), F.lit(0))


def unquote(raw: Column) -> Column:
    """Drop quotes that enclose the whole value and undouble them inside."""
    body = F.substr(raw, F.lit(2), F.length(raw) - 2)
    return (
        F.when(raw.rlike(rf"^{_IN_SINGLE}$"), F.replace(body, F.lit("''"), F.lit("'")))
        .when(raw.rlike(rf"^{_IN_DOUBLE}$"), F.replace(body, F.lit('""'), F.lit('"')))
        .otherwise(raw)
    )


def trim_all(c: Column) -> Column:
    """Trim blanks, tabs and line breaks on both sides."""
    return F.trim(c, F.lit(" \t\r\n\f\u000b"))
