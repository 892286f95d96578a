"""Safe sinks: a result is published whole or not at all, only where it changed, and never in place of a fuller one."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Outcome:
    """What publish() did: written, same or kept (the old result, as the new one has too few rows), and both numbers of rows."""

    state: str
    rows: int
    before: int


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def replace(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Writes beside the target and renames: readers see the old folder or the new one. What a crash leaves is a folder of another
    name. The old folder goes last, under a name that no reader asks for."""
    spark = df.sparkSession
    fresh, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(fresh)
    fs, target = _fs(spark, path)
    had = fs.exists(target)
    if had and not fs.rename(target, _fs(spark, old)[1]):
        raise OSError(f"{path} could not be moved away")
    if not fs.rename(_fs(spark, fresh)[1], target):
        if had:
            fs.rename(_fs(spark, old)[1], target)
        raise OSError(f"{path} could not be put in place")
    if had:
        fs.delete(_fs(spark, old)[1], True)


def _digest(df: DataFrame, ignore: tuple[str, ...]):
    """Rows and an order-free digest of them: two sums over the rows' hashes, in one pass that Spark aggregates before it shuffles."""
    names = sorted(c for c in df.columns if c not in ignore)
    one = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names))
    two = F.hash(*(F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in reversed(names)))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("a"), F.sum(two.cast("decimal(38,0)")).alias("b")).first()
    return r.n, (names, r.a, r.b)


def publish(df: DataFrame, path: str, kind: str = "parquet", ignore: tuple[str, ...] = (), least: float = 0.0, **options) -> Outcome:
    """Replaces the result at `path` unless nothing but `ignore` (a time of writing, say) differs, or the new result has less than
    `least` of the old one's rows (1.0: never a smaller one). An empty old result is always replaced. Results are compared as text
    by column name."""
    spark = df.sparkSession
    n, now = _digest(df, ignore)
    fs, target = _fs(spark, path)
    before = 0
    if fs.exists(target):
        old = spark.read.format(kind).options(**options)
        old = (old if kind == "parquet" else old.schema(df.schema)).load(path)
        before, was = _digest(old, ignore)
        if was == now and before == n:
            return Outcome("same", n, before)
        if n < least * before:
            return Outcome("kept", n, before)
    replace(df, path, kind, **options)
    return Outcome("written", n, before)


def to_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written, in place of what is there."""
    replace(df, path, "json", ignoreNullFields="false")


def to_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and quoted text, so that line breaks, quotes and empty texts come back as they were; null is \\N."""
    replace(df, path, "csv", header="true", quoteAll="true", escape='"', nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


def from_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(header="true", multiLine="true", escape='"', nullValue="\\N", emptyValue="").csv(path)
