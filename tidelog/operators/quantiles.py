"""Exact quantiles of whole numbers, per group, for groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here equal
values are counted first, the counts are summed by coarse bucket to find the
buckets that hold the wanted ranks, and only those are looked into by finer
buckets, down to single values. A task orders some 10 000 buckets of a group.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Widths of the buckets, from coarse to single values. Each level has at most
# 10 000 buckets inside one of the level above.
WIDTHS = (100_000_000, 10_000, 1)


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: dict[str, Fraction],
    group: list[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per group with each quantile, linearly interpolated, as a double.

    ``value`` is a BIGINT column; ``quantiles`` maps output names to fractions.
    With ``weight`` the rows are counts already: a value, and how often it is there.
    """
    if not group:
        one = df.withColumn("_all", F.lit(1))
        return exact_quantiles(one, value, quantiles, ["_all"], weight).drop("_all")

    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    )
    # Rank r = q * (n - 1) as a whole part and a rest over the denominator.
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.expr(f"({f.numerator}L * (_n - 1)) div {f.denominator}L").alias("low"),
                F.expr(f"({f.numerator}L * (_n - 1)) % {f.denominator}L").alias("rest"),
                F.lit(f.denominator).cast("bigint").alias("den"),
            )
            for name, f in quantiles.items()
        ]
    )
    rank = F.least(F.col("low") + F.col("_side"), F.col("_n") - 1)
    about_rank = ["name", "_side", "rest", "den", "_rank"]
    found = None
    for width in WIDTHS:
        bucket = F.floor(F.col("_v") / F.lit(width)) if width > 1 else F.col("_v")
        if found is None:
            # The sum over all of a group's buckets gives the wanted ranks.
            sums = counts.groupBy(*group, bucket.alias("_b")).agg(F.sum("_c").alias("_bn"))
            whole = Window.partitionBy(*group)
            upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            placed = sums.withColumns({"_upto": F.sum("_bn").over(upto), "_n": F.sum("_bn").over(whole)})
            found = (
                placed.withColumn("_w", F.explode(wanted))
                .select(*group, "_b", "_bn", "_upto", "_n", "_w.*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"))
                .withColumn("_rank", rank)
            )
        else:
            # Only the hit buckets are looked into, once per rank that falls into them.
            inside = counts.withColumn("_up", F.floor(F.col("_v") / F.lit(above)))
            hit = inside.join(found.withColumnRenamed("_b", "_up"), [*group, "_up"])
            sums = hit.groupBy(*group, *about_rank, bucket.alias("_b")).agg(F.sum("_c").alias("_bn"))
            upto = Window.partitionBy(*group, *about_rank).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            found = sums.withColumn("_upto", F.sum("_bn").over(upto))
        above = width
        reached = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_bn"))
        # From here on a rank counts from the start of its bucket.
        found = found.where(reached).withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_bn")).select(*group, "_b", *about_rank)
    found = found.withColumnRenamed("_b", "_v")
    share = F.when(F.col("_side") == 0, F.col("den") - F.col("rest")).otherwise(F.col("rest"))
    return found.groupBy(*group).agg(
        *[
            (
                F.sum(F.when(F.col("name") == name, F.col("_v") * share)).cast("double")
                / F.lit(float(f.denominator))
            ).alias(name)
            for name, f in quantiles.items()
        ]
    )
