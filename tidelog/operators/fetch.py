"""Rows of a stored table found by their address, so that a first pass need not carry wide texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Half of an address is a hash of the file, the other half the row in it.
HALF = 32


def _file() -> Column:
    return F.xxhash64("_metadata.file_path").bitwiseAND(F.lit((1 << HALF - 1) - 1))


def address() -> Column:
    """Where a row is stored, as one number; two files may share half of it, so what is fetched must be checked."""
    return F.shiftleft(_file(), HALF).bitwiseOR(F.col("_metadata.row_index"))


def has_addresses(events: DataFrame) -> bool:
    """Whether the rows come from Parquet files unchanged."""
    try:
        events.select(address())
    except AnalysisException:
        return False
    return True


def at_addresses(events: DataFrame, addresses: list[int]) -> DataFrame:
    """The rows at a few addresses (and hardly ever one more); only their files are read."""
    files = sorted({a >> HALF for a in addresses})
    return events.where(_file().isin(files)).where(address().isin(addresses))
