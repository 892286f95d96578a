"""Structured Streaming over the events table: windows, sessions, de-duplication, late rows and monotonic upserts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.graphs import work_folder


def read(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream of one file. Event time becomes a TIMESTAMP, which watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a file source wants a folder; a table may be a folder of parts or one file in the data folder
    source = spark.readStream.schema(schema)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(fs_path).isDirectory():
        stream = source.parquet(path)
    else:
        stream = source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result table: complete and append results from a memory-free Parquet sink
    in the shared folder."""
    spark = stream.sparkSession
    base = work_folder(spark, "stream")
    out = f"{base}/out"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def arrivals(df: DataFrame, time: str = "ts", slices: int = 4) -> list[DataFrame]:
    """A table as it would arrive: slices of its time span in order, then a closing row of nulls ten days after the last."""
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
    if ends.a is None:
        return []
    step = (ends.b - ends.a) / slices
    cuts = [ends.a + k * step for k in range(1, slices)]
    late = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    of = sum((F.when(F.col(time) >= c, 1).otherwise(0) for c in late), F.lit(0))
    closing = df.sparkSession.createDataFrame([tuple(ends.b + timedelta(days=10) if f.name == time else None for f in df.schema)], df.schema)
    return [*(df.filter(of == k) for k in range(slices)), closing]


def replay(spark: SparkSession, parts: list[DataFrame], build, time: str = "ts") -> DataFrame:
    """What a stream in append mode gives as the parts arrive one after the other: each is added to its source folder and the query,
    build(stream), is run on from its checkpoint until nothing is left, as after a restart."""
    base = work_folder(spark, "stream")
    schema, stream = parts[0].schema, None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{base}/in").withColumn(time, F.col(time).cast("timestamp")))
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def watch(stream: DataFrame, key: str, days: int, time: str = "ts") -> DataFrame:
    """key, kind and at: "opened" where a key is seen for the first time or after more than `days` of silence, and "stalled" where such
    a silence begins. State is a key's last time; a timer at the end of the silence raises the alarm, once, and drops the state.

    The stream needs a watermark on `time`; rows later than that are left out.
    """
    limit = days * 86_400_000

    def run(name, frames, state):
        import pandas as pd

        last, out = (state.get[0] if state.exists else None), []
        if pd.isna(name[0]):  # dropped here: a filter would be pushed below the watermark, which such rows move too
            pass
        elif state.hasTimedOut:
            state.remove()
            out.append(("stalled", last))
        else:
            for t in sorted(int(x.value // 1_000_000) for f in frames for x in f[time]):
                if last is None or t - last > limit:
                    out += ([("stalled", last)] if last is not None else []) + [("opened", t)]
                last = t if last is None else max(t, last)
            state.update((last,))
            state.setTimeoutTimestamp(max(last + limit, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({key: [name[0]] * len(out), "kind": [k for k, _ in out], "at": pd.to_datetime([t for _, t in out], unit="ms", utc=True).astype("datetime64[ns, UTC]")})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, time).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, kind string, at timestamp", "last long", "append", "EventTimeTimeout")


def naive(df: DataFrame, *names: str) -> DataFrame:
    """Times without a zone again, as the tables have them."""
    for n in names:
        df = df.withColumn(n, F.col(n).cast("timestamp_ntz"))
    return df
