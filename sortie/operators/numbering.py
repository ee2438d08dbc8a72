"""Dense numbers for the distinct values of a column, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def dense_numbers(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the distinct non-null values, numbered from 0 in their own order.

    Values are dealt out in ranges; a number is the place in its range plus the
    sizes of the ranges before. Values that sort side by side, such as names
    with a common beginning, get numbers side by side.
    """
    ranged = (
        df.select(column).where(F.col(column).isNotNull()).distinct()
        .repartitionByRange(column).sortWithinPartitions(column)
    )
    # the generated id holds the range above bit 33 and the place in it below; the written table fixes both
    dealt = stage(ranged.select(column, F.monotonically_increasing_id().alias("_id")), "ranges").select(
        column, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    )
    # as many rows as ranges
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("_range").agg(F.max("_at").alias("_last")).select(
        "_range", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_first")
    )
    return dealt.join(firsts, "_range").select(column, (F.col("_first") + F.col("_at")).alias(name))
