"""Journal files as lines, with the facts that their paths carry."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.numbers import whole_number

# Fixed value: hour files are named YYMMDDHH.log.
HOUR_FILE = r"^(\d{2})(\d{2})(\d{2})(\d{2})\.log$"


def local_path(uri: Column) -> Column:
    """``_metadata.file_path`` without percent escapes; most paths have none."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.when(uri.contains("%"), decoded).otherwise(uri)


@dataclass(frozen=True)
class Layout:
    """How directory, file and part order are read from a path.

    Files lie at ``<root>/<directory>/.../<YYMMDDHH>.log``; other names are not
    read. With ``parts`` an hour too large for one writer may go on in
    ``<YYMMDDHH>.log.<n>`` files, in order of n.
    """

    root: str
    parts: bool = False

    def glob(self, stems: list[str] | None = None) -> str:
        """File-name glob of the given name starts (default: all)."""
        ends = [".log", ".log.[0-9]*"] if self.parts else [".log"]
        return "{" + ",".join(stem + end for stem in (stems or ["*"]) for end in ends) + "}"

    def file_key(self, path: Column) -> Column:
        """The path of the hour file a line belongs to."""
        if not self.parts:
            return path
        return F.when(path.endswith(".log"), path).otherwise(F.regexp_replace(path, r"\.log\.\d+$", ".log"))

    def part(self, path: Column) -> Column:
        if not self.parts:
            return F.lit(0).cast("bigint")
        number = F.coalesce(whole_number(F.regexp_extract(path, r"\.log\.(\d+)$", 1)), F.lit(0))
        return F.when(path.endswith(".log"), F.lit(0).cast("bigint")).otherwise(number)

    def source_file(self, file_key: Column) -> Column:
        return F.element_at(F.split(file_key, "/"), -1)

    def directory_name(self, file_key: Column) -> Column:
        """First path part under the root, ``root`` for files right under it.

        A file outside the root (a link) takes the name of its parent folder.
        """
        below = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", self.root).rstrip("/")
        # A Java-quoted literal, so any character of the root stands for itself.
        inside = r"^(?:[A-Za-z][\w+.-]*:)?(?://[^/]*)?\Q" + below + r"\E/+(.+)$"
        relative = F.regexp_extract(file_key, inside, 1)
        parts = F.split(relative, "/+")
        parent = F.get(F.split(file_key, "/"), F.size(F.split(file_key, "/")) - 2)
        return (
            F.when(relative == "", parent)
            .when(F.size(parts) > 1, F.get(parts, F.lit(0)))
            .otherwise("root")
        )


def base_hour(source_file: Column) -> Column:
    """``20YY-MM-DD HH`` of an hour-file name; NULL for any other name."""
    text = F.regexp_replace(source_file, HOUR_FILE, r"20$1-$2-$3 $4")
    ok = source_file.rlike(HOUR_FILE) & F.concat(text, F.lit(":00:00")).try_cast("timestamp_ntz").isNotNull()
    return F.when(ok, text)


def hour_stems(start: datetime, end: datetime) -> list[str]:
    """Name starts of the files of all hours in ``[start, end]``, at most one term per day.

    Days that are only partly inside are still matched by their hours.
    """
    hour = start.replace(minute=0, second=0, microsecond=0)
    by_day: dict[str, list[str]] = {}
    while hour <= end:
        by_day.setdefault(hour.strftime("%y%m%d"), []).append(hour.strftime("%H"))
        hour += timedelta(hours=1)
    terms = []
    for day, hours in by_day.items():
        terms += [f"{day}*"] if len(hours) == 24 else [f"{day}{h}*" for h in hours]
    return terms


def date_stems(start: datetime, end: datetime) -> list[str]:
    """Name starts of all hour files whose date is in ``[start, end]``."""
    first = start.replace(hour=0, minute=0, second=0, microsecond=0)
    last = end.replace(hour=23, minute=0, second=0, microsecond=0)
    return hour_stems(first, last)


def list_files(spark: SparkSession, layout: Layout, stems: list[str] | None = None) -> DataFrame:
    """One row per hour file: its facts and size, without reading content.

    A scan skips files of zero bytes, so the names come from the file index
    that Spark keeps on the driver and only the sizes from a scan.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", layout.glob(stems))
        .load(layout.root)
    )
    names = spark.createDataFrame([(uri,) for uri in listing.inputFiles()], "uri string")
    sizes = listing.select(local_path(F.col("_metadata.file_path")).alias("path"), "length")
    found = names.select(short_scheme(local_path(F.col("uri"))).alias("path")).join(
        sizes.withColumn("path", short_scheme(F.col("path"))), "path", "left"
    )
    key = layout.file_key(F.col("path"))
    return (
        found.groupBy(key.alias("file_path"))
        .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("file_size"))
        .withColumn("file_id", F.xxhash64("file_path"))
        .withColumn("directory_name", layout.directory_name(F.col("file_path")))
        .withColumn("source_file", layout.source_file(F.col("file_path")))
    )


def short_scheme(path: Column) -> Column:
    """``file:/x`` for ``file:///x``: both forms name one local file."""
    return F.regexp_replace(path, r"^file:/+", "file:/")


def as_lines(text: DataFrame, layout: Layout) -> DataFrame:
    """Lines keyed by file and split, from ``value, uri, block_start`` rows."""
    path = local_path(F.col("uri"))
    return text.select(
        F.xxhash64(layout.file_key(path)).alias("file_id"),
        layout.part(path).alias("part"),
        "block_start",
        layout.file_key(path).alias("file_path"),
        "value",
    )


def line_columns() -> list[Column]:
    return [
        F.col("value"),
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block_start"),
    ]


def read_lines(spark: SparkSession, layout: Layout, stems: list[str] | None = None) -> DataFrame:
    """All lines of the matching files. Files deleted meanwhile are skipped.

    Only a line feed ends a line, so a lone carriage return stays in the text.
    """
    text = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", layout.glob(stems))
        .option("ignoreMissingFiles", "true")
        .option("lineSep", "\n")
        .text(layout.root)
    )
    return as_lines(text.select(*line_columns()), layout)
