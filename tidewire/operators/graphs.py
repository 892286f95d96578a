"""Graph operators over edge tables (a, b)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def undirected(edges: DataFrame, weight: str = "w") -> DataFrame:
    return edges.select("a", "b", weight).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), weight))


def pairs_within(df: DataFrame, key: str, item: str) -> DataFrame:
    """Pairs of items that share a key, with the number of keys; items of a key are joined on the key."""
    d = df.select(key, item).distinct()
    other = d.select(F.col(key), F.col(item).alias("b"))
    return d.withColumnRenamed(item, "a").join(other, key).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir, which is set as its checkpoint folder.

    Only a local session without one gets a temporary folder.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"file://{tempfile.mkdtemp()}"
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder, deleted when the driver's JVM ends (after spark.stop(), too)."""
    sc = spark.sparkContext
    root = f"{shared_folder(spark).rstrip('/')}/tidewire-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{root}/{name}"


def components(edges: DataFrame) -> DataFrame:
    """v and root, the least vertex reachable, by propagating minima; lineage is cut by a reliable checkpoint each round."""
    shared_folder(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    root = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "v").checkpoint()
    while True:
        near = both.join(root, F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("near"))
        new = root.join(near, F.col("v") == F.col("a")).select("v", F.least("root", "near").alias("root"))
        jump = new.select(F.col("v").alias("r2"), F.col("root").alias("up"))
        new = new.join(jump, F.col("root") == F.col("r2"), "left").select("v", F.least("root", F.coalesce("up", "root")).alias("root")).checkpoint()
        if new.join(root.withColumnRenamed("root", "was"), "v").filter("root <> was").isEmpty():
            return new
        root = new


def propagate(edges: DataFrame, rounds: int = 14) -> DataFrame:
    """Label propagation by weight: each vertex takes the label of the largest weight around it, ties to the least; all vertices at
    once, so results don't hang on an order of visits. Returns v and label."""
    shared_folder(edges.sparkSession)
    both = undirected(edges).checkpoint()  # read again in every round
    label = both.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v"))
    for _ in range(rounds):
        votes = both.join(label, F.col("b") == F.col("v")).groupBy("a", "label").agg(F.sum("w").alias("w"))
        label = votes.groupBy("a").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")).withColumnRenamed("a", "v").checkpoint()
    return label


def paths(edges: DataFrame, start: int, end: int, most: int = 4) -> DataFrame:
    """Simple paths of at most `most` edges between two vertices: path, steps and the weakest weight."""
    step = undirected(edges).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("w").alias("ew"))
    front = step.filter(F.col("x") == start).select(F.array("x", "y").alias("path"), F.col("y").alias("at"), F.col("ew").alias("weakest"))
    done = []
    for k in range(1, most + 1):
        done.append(front.filter(F.col("at") == end).select("path", F.lit(k).alias("steps"), "weakest"))
        front = front.filter(F.col("at") != end).join(step, F.col("at") == F.col("x")).filter(~F.array_contains("path", F.col("y"))).select(F.concat("path", F.array("y")).alias("path"), F.col("y").alias("at"), F.least("weakest", "ew").alias("weakest"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
