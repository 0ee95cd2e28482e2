"""Running sums over all rows, or all rows of a group, without putting them in one task.

Rows are dealt to ranges of their order; range totals are added up first, then each range adds up its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_range(df: DataFrame, order: Column, name: str = "__range", width: float = 4096) -> DataFrame:
    """Ranges of a number: its whole multiples of width."""
    return df.withColumn(name, F.floor(order / F.lit(width)))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], group: list[str] | None = None, range_col: str | None = None) -> DataFrame:
    """df with the inclusive running sum of each column of `sums` under its new name; equal keys in `order` add up one by one."""
    group = group or []
    ranged = df.withColumn("__range", F.col(range_col)) if range_col else with_range(df, F.col(order))
    totals = ranged.groupBy(*group, "__range").agg(*(F.sum(c).alias(c) for c in sums))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "__range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in sums))
    inside = Window.partitionBy(*group, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(starts, [*group, "__range"])
    out = joined.select("*", *((F.col(f"__before_{c}") + F.sum(c).over(inside)).alias(name) for c, name in sums.items()))
    return out.drop("__range", *(f"__before_{c}" for c in sums))


def spread_number(df: DataFrame, group: list[str], key: str, name: str) -> DataFrame:
    """df with a row's number (from 0) among its group's in the order of a hex hash column."""
    one = df.withColumns({"__one": F.lit(1).cast("bigint"), "__first": F.substring(key, 1, 3)})
    return running_sums(one, key, {"__one": name}, group, "__first").withColumn(name, F.col(name) - 1).drop("__one", "__first")
