"""Row numbers within large groups without giving a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, group: list[str], cell: Column, order: list[str], name: str) -> DataFrame:
    """``row_number() over (partition by group order by order)``, cell by cell.

    ``cell`` is a coarse, non-decreasing function of the leading order column.
    Rows are ranked inside their cell only; the counts of the earlier cells of
    the group, a small aggregate, give the start value.
    """
    keyed = df.withColumn("_cell", cell)
    counts = keyed.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *group, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*group, "_cell").orderBy(*order)
    return (
        keyed.join(starts, [*group, "_cell"])
        .withColumn(name, (F.col("_start") + F.row_number().over(inside)).cast("bigint"))
        .drop("_cell", "_start")
    )
