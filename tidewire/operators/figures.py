"""Operators over numbers of several sources, and apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold(median: Column, percent_unit: bool = False) -> Column:
    """Two values agree within 8 % of the median (at least one point for percentages)."""
    t = F.abs(median) * 0.08
    return F.greatest(t, F.lit(1.0)) if percent_unit else t


def verdict(a: Column, b: Column, t: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap <= t, "agree").when(gap <= 2 * t, "compatible").otherwise("contradict")


def largest_remainder(df: DataFrame, weight: str, seats: int, key: str, name: str = "seats") -> DataFrame:
    """Seats in proportion to weights: whole quotas first, then one each to the largest remainders (ties to the lesser key)."""
    every = Window.partitionBy()
    q = df.withColumn("_all", F.sum(weight).over(every)).withColumn("_base", F.expr(f"({weight} * {seats}) div _all")).withColumn("_rest", F.expr(f"({weight} * {seats}) % _all"))
    left = F.lit(seats) - F.sum("_base").over(every)
    return q.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_rest"), key))).withColumn(name, (F.col("_base") + F.when(F.col("_r") <= left, 1).otherwise(0)).cast("long")).drop("_all", "_base", "_rest", "_r")
