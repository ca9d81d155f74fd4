"""Joins that SQL engines have and Spark lacks a physical operator for, as compositions of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before its time (null if none).

    One union and one window: rows of both sides meet sorted by time, so nothing is multiplied.
    """
    names = left.columns
    carried = F.struct(*(F.col(f"`{v}`") for v in values))
    rows = left.select(*names, F.lit(1).alias("_side"), F.lit(None).cast(right.select(carried.alias("c")).schema["c"].dataType).alias("_seen"))
    other = right.select(*(F.col(f"`{n}`") if n in (*keys, time) else F.lit(None).cast(left.schema[n].dataType).alias(n) for n in names), F.lit(0).alias("_side"), carried.alias("_seen"))
    order = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.union(other).withColumn("_seen", F.last("_seen", ignorenulls=True).over(order))
    return both.where("_side = 1").select(*names, *(F.col(f"_seen.`{v}`").alias(v) for v in values))


def interval(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high: intervals go to every bin of ``width`` that they touch, points to one, and bins are joined."""
    binned = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    points = left.withColumn("_bin", F.floor(F.col(point) / width))
    return points.join(binned, "_bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")
