"""Analytic operators: recency, ranks, streaks, series, spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.graphs import shared_folder


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first k rows of each group; Spark keeps k a task before the shuffle (window group limit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def latest(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key, as one aggregate without a sort."""
    return df.groupBy(*by).agg(F.max(F.struct(*order, *values)).alias("_l")).select(*by, *(F.col(f"_l.{c}").alias(c) for c in order + values))


def numbered(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """The rows with their number (from 1) in one order of all: rows are dealt out by ranges of the order, numbered within each range,
    and each range is moved by what stands before it. The ranges are written once, so that numbers stay when a task is repeated."""
    shared_folder(df.sparkSession)
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_own", own).join(before, "_p").withColumn(name, F.col("_before") + F.col("_own")).drop("_p", "_own", "_before")


def quantile_class(df: DataFrame, order: list[Column], k: int, name: str = "class") -> DataFrame:
    """floor((row - 1) * k / n) over one order of all rows."""
    n = F.lit(df.count())
    return numbered(df, order, "_r").withColumn(name, F.floor((F.col("_r") - 1) * k / n).cast("int")).drop("_r")


def streaks(df: DataFrame, by: list[str], order: list[str], bad: Column) -> DataFrame:
    """Runs of consecutive rows where `bad` holds: key, start and length (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("_bad", bad).withColumn("_island", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return flagged.filter("_bad").groupBy(*by, "_island").agg(F.min(order[0]).alias("since"), F.count(F.lit(1)).alias("length")).drop("_island")


def dense_days(df: DataFrame, by: list[str], day: str, value: str = "n") -> DataFrame:
    """Counts for every key and every day between the first and the last of all, zero where there is no row."""
    bounds = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    if bounds.lo is None:
        return df.groupBy(*by, day).agg(F.count(F.lit(1)).alias(value))
    days = df.select(*by).distinct().withColumn(day, F.explode(F.sequence(F.lit(bounds.lo), F.lit(bounds.hi))))
    counts = df.groupBy(*by, day).agg(F.count(F.lit(1)).alias(value))
    return days.join(counts, [*by, day], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def spikes(daily: DataFrame, by: list[str], day: str, n: str, ratio: float = 2.5, floor: float = 0.3, least: int = 4) -> DataFrame:
    """Days whose 3-day count is at least `least` and whose 3-day rate is `ratio` times the mean of the 14 days before."""
    at = F.datediff(F.col(day), F.lit("2000-01-01").cast("date"))
    w = Window.partitionBy(*by).orderBy(at)
    short = F.sum(n).over(w.rangeBetween(-2, 0))
    long = F.coalesce(F.sum(n).over(w.rangeBetween(-16, -3)), F.lit(0))
    out = daily.withColumn("n3", short).withColumn("n14", long)
    return out.filter((F.col("n3") >= least) & (F.col("n3") / 3.0 >= ratio * F.greatest(F.col("n14") / 14.0, F.lit(floor))))
