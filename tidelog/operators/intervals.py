"""Find, for each requested interval, the first interval it overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.times import start_of


def first_overlap(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """``requests`` plus ``overlap_id`` / ``overlap_start`` (NULL when free).

    ``requests`` has ``start_date, end_date``; ``intervals`` has ``id,
    start_date, end_date``. Both ends are inclusive. No pairs are formed: among
    the intervals that end at or after a request's start, the one that starts
    first (then the smallest id) overlaps the request unless it starts after
    the request's end, and then no other one can overlap either. So one running
    minimum in falling time order answers every request. It is taken in two
    levels, by hour and inside the hour.
    """
    ends = intervals.groupBy(F.col("end_date").alias("t")).agg(
        F.min(F.struct("start_date", "id")).alias("best")
    )
    starts = requests.select(F.col("start_date").alias("t")).distinct()
    points = (
        ends.withColumn("is_end", F.lit(True))
        .unionByName(
            starts.withColumn("is_end", F.lit(False)), allowMissingColumns=True
        )
        .withColumn("hour", start_of(F.col("t"), "hour"))
    )
    later_hours = Window.orderBy(F.col("hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    by_hour = points.groupBy("hour").agg(F.min("best").alias("hour_best"))
    later = by_hour.select("hour", F.min("hour_best").over(later_hours).alias("later_best"))
    # Within an hour; an interval ending exactly at a request's start counts.
    inside = (
        Window.partitionBy("hour")
        .orderBy(F.col("t").desc(), F.col("is_end").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = (
        points.join(later, "hour")
        .withColumn("inside_best", F.min("best").over(inside))
        .where(~F.col("is_end"))
        .select(F.col("t").alias("start_date"), "inside_best", "later_best")
    )
    best = (
        F.when(F.col("inside_best").isNull(), F.col("later_best"))
        .when(F.col("later_best").isNull(), F.col("inside_best"))
        .otherwise(F.array_min(F.array("inside_best", "later_best")))
    )
    answered = answered.select("start_date", best.alias("best"))
    hit = F.col("best.start_date") <= F.col("end_date")
    return requests.join(answered, "start_date", "left").select(
        *[F.col(c) for c in requests.columns],
        F.when(hit, F.col("best.id")).alias("overlap_id"),
        F.when(hit, F.col("best.start_date")).alias("overlap_start"),
    )
