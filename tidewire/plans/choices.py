"""Quotas, diverse editions, messages, geometry and centrality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import geometry, text
from tidewire.operators import centrality, selection
from tidewire.plans.registry import query
from tidewire.session import table


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS b,
 CASE WHEN o_custkey % 4 > 0 THEN row_number() OVER (PARTITION BY CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 END ORDER BY o_totalprice DESC, o_orderkey) END AS c FROM orders) SELECT o_orderkey FROM r WHERE a <= 12 OR b <= 8 OR c <= 5""")
def quota_selection(spark, sf):
    """The most covered stories of every topic, scope and body, so that none is empty."""
    o = table(spark, sf, "orders").withColumn("body", F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 4))
    return selection.quota(o, {"o_orderpriority": 12, "o_orderstatus": 8, "body": 5}, [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey")


@query()
def diverse_edition(spark, sf):
    """Ten headlines of each scope, each unlike those before."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n"), text.tokens(F.col("text")).alias("w"))
    return selection.diverse(d, "lang", [F.desc("n"), F.col("doc_id")], "doc_id", "w", 10)


@query()
def message_packing(spark, sf):
    """Rows of each day packed into messages of at most six rows and 300 units, in order."""
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_id", F.ceil(F.abs("value")).alias("size"))
    return selection.pack(e, "day", ["event_id"], "size", 300, 6)


#: An L-shaped and a triangular area on a plane of 0..10 by 0..10.
AREAS = {"corner": ((0.0, 0.0), (6.0, 0.0), (6.0, 3.0), (3.0, 3.0), (3.0, 7.0), (0.0, 7.0)), "wedge": ((4.0, 4.0), (9.5, 4.5), (7.0, 9.5))}
SIDES = ", ".join(f"('{n}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for n, r in AREAS.items() for a, b in zip(r, r[1:] + r[:1], strict=True))


def _areas(spark):
    return spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in r]) for n, r in AREAS.items()], f"area string, ring {geometry.RING}")


@query(f"""WITH s(area, ax, ay, bx, b_y) AS (VALUES {SIDES}), p AS (SELECT c_custkey AS id, (c_custkey * 37 % 1000) / 100.0 AS x, (c_custkey * 91 % 1000) / 100.0 AS y FROM customer)
SELECT id, area FROM p, s WHERE (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax GROUP BY id, area HAVING count(*) % 2 = 1""")
def points_in_areas(spark, sf):
    """The areas that hold each point: a fixed set of rings rides along as one literal array, so points are only scanned."""
    rings = F.array(*(F.struct(F.lit(n).alias("area"), F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in r)).alias("ring")) for n, r in AREAS.items()))
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 1000 / 100.0).alias("x"), (k * 91 % 1000 / 100.0).alias("y"))
    inside = F.filter(rings, lambda a: geometry.contains(a["ring"], F.col("x"), F.col("y")))
    return p.select("id", F.explode(F.transform(inside, lambda a: a["area"])).alias("area"))


@query(f"""WITH s(area, ax, ay, bx, b_y) AS (VALUES {SIDES}), a AS (SELECT area, sum(ax * b_y - bx * ay)::DOUBLE / 2 AS size, sum((ax + bx) * (ax * b_y - bx * ay))::DOUBLE AS mx, sum((ay + b_y) * (ax * b_y - bx * ay))::DOUBLE AS my, min(ax)::DOUBLE AS x0, max(ay)::DOUBLE AS y1 FROM s GROUP BY area)
SELECT area, round(size, 4) AS size, round(mx / (6 * size), 4) AS cx, round(my / (6 * size), 4) AS cy, x0, y1 FROM a""")
def area_shapes(spark, sf):
    """Surface, centre and corners of each area."""
    a = _areas(spark).select("area", F.round(geometry.signed_area(F.col("ring")), 4).alias("size"), geometry.centroid(F.col("ring")).alias("c"), geometry.box(F.col("ring")).alias("b"))
    return a.select("area", "size", F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"), "b.x0", "b.y1")


@query()
def simplified_lines(spark, sf):
    """Each person's curve of values by day, without the points that a tolerance of 40 spares. A person has one point a day."""
    e = table(spark, sf, "events").groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double").alias("x")).agg(F.round(F.max("value"), 2).alias("y"))
    lines = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("line"))
    return lines.select("user_id", F.size("line").alias("points"), F.size(geometry.simplified(F.col("line"), 40.0)).alias("kept"))


@query()
def brokers(spark, sf):
    """Betweenness of nations within each region's graph of the links that are stronger than its mean; a region has few nations."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("a"))
    s = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("s_nationkey").alias("b"))
    pairs = o.join(s, "o_orderkey").groupBy("a", "b").agg(F.count("*").alias("w"))
    inner = pairs.join(n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("region")), "a").join(n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("r2")), "b").filter("region = r2 AND a <> b").withColumn("mean", F.avg("w").over(Window.partitionBy("region"))).filter("w > mean")
    return centrality.central(inner.select("region", "a", "b"), "region").withColumn("betweenness", F.round("betweenness", 6))
