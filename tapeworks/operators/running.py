"""Running sums over long groups without a window that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], part: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out, the sum of value over the rows of its group up to its own, by (part, order).

    part cuts each group into ordered slices: slices are summed, the few sums are run over, and rows add up inside a slice.
    """
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("__slice"))
    sums = sums.select(*keys, part, F.coalesce(F.sum("__slice").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = df.withColumn("__inside", F.sum(value).over(inside))
    return own.join(sums, [*keys, part]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside")
