"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import keep


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """v and root, the least vertex reachable, of every vertex of edges (a, b) whose root is another one.

    Each round links every vertex to the least of its neighbours, in both directions by turns; the number of rounds grows with the
    logarithm of the graph's width. A vertex with very many neighbours is pre-aggregated to their minimum and joined to its edges,
    a join whose large partitions Spark splits. Each round is written to the shared folder, so lineage stays short.
    """
    e = keep(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).filter("v <> root").distinct(), name)
    seen = None
    while True:
        # large star: larger neighbours of u to the least one around u
        both = e.select(F.col("v").alias("u"), F.col("root").alias("w")).unionByName(e.select(F.col("root").alias("u"), F.col("v").alias("w")))
        low = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = both.filter("w > u").join(low, "u").select(F.col("w").alias("v"), F.col("m").alias("root")).filter("v <> root").distinct()
        # small star: smaller neighbours of v, and v, to the least one
        low = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("root")), F.struct(F.col("root").alias("v"), F.col("m").alias("root")))).alias("x")).select("x.*").filter("v <> root").distinct()
        e = keep(small, name)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if now == seen:
            return e
        seen = now
