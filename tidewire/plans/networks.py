"""Similarity, story and graph queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import graphs
from tidewire.plans.registry import query
from tidewire.plans.texts import FOLD, STOPS
from tidewire.session import table

#: Documents of one day: blocks of ids stand in for days.
DAY = 100


def _day_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / DAY).cast("long").alias("day"), text.tokens(F.col("text"), 5).alias("t"))
    graphs.shared_folder(spark)
    return d.withColumn("size", F.size("t")).checkpoint()  # every step reads these words, which are dear to make


#: Shared words that a pair needs at least, and their share of the smaller set in percent.
LEAST, OVERLAP = 3, 55
#: Words that a pair shares among the rarest before it is confirmed; any number gives the same pairs.
SEEN = 16


def overlapping(d, gap: int):
    """Pairs (day, a, b, shared) of documents `gap` days apart, a the earlier one (of one day: the smaller id), with LEAST shared
    words or more and OVERLAP percent of the smaller set. d: doc_id, day, t (distinct words) and size.

    A pair shares so many words that SEEN of them (all that it must share, if fewer) are among the rarest of the smaller set: only
    those look for the words of others, so frequent words of long texts meet nothing. Pairs that share SEEN are confirmed on whole sets.
    """
    words = text.each(d, F.col("t"), "w", "doc_id", "day", "size")
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    rare = words.join(df, "w").groupBy("doc_id", "day", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("t"))
    need = F.greatest(F.lit(LEAST), F.ceil(F.col("size") * OVERLAP / 100).cast("int"))
    seen = F.least(need, F.lit(SEEN))
    first = F.slice("t", 1, F.col("size") - need + seen)
    x = rare.filter(F.col("size") >= need).select("day", F.col("doc_id").alias("x"), F.col("size").alias("size_x"), seen.alias("seen"), F.explode(first).alias("w"))
    y = words.select(F.col("day").alias("day_y"), F.col("doc_id").alias("y"), F.col("size").alias("size_y"), F.col("w").alias("w_y"))
    # the side that looks is the smaller set; it may be of the earlier or of the later day
    met = [x.join(y, (F.col("w") == F.col("w_y")) & (F.col("day_y") == F.col("day") + by)).filter(F.struct("size_x", "x") < F.struct("size_y", "y")) for by in {gap, -gap}]
    met = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    earlier = F.col("x") < F.col("y") if gap == 0 else F.col("day") < F.col("day_y")
    a, b = F.when(earlier, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(earlier, F.col("y")).otherwise(F.col("x")).alias("b")
    met = met.groupBy(a, b, "seen").agg(F.count("*").alias("n")).filter("n >= seen").select("a", "b")
    one, two = (d.select(F.col("doc_id").alias(i), F.col("t").alias(f"t_{i}"), F.col("size").alias(f"size_{i}"), *(["day"] if i == "b" else [])) for i in "ab")
    p = met.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("t_a", "t_b")).cast("long"))
    return p.filter((F.col("shared") >= LEAST) & (F.col("shared") * 100 >= OVERLAP * F.least("size_a", "size_b"))).select("day", "a", "b", "shared")


def similar_pairs(spark, sf):
    """Pairs of one day with three shared words or more and an overlap of 0.55 of the smaller set; only texts of the same day meet,
    so a pair list is as long as a day is busy, not as the corpus is."""
    return overlapping(_day_tokens(spark, sf), 0)


PAIRS = f"""d AS (SELECT doc_id, doc_id // {DAY} AS day, list_filter(list_distinct(regexp_extract_all({FOLD}, '[a-z]{{5,}}')), lambda w: w NOT IN ({STOPS})) AS t FROM documents),
t AS (SELECT day, doc_id, len(t) AS size, unnest(t) AS w FROM d), p AS (SELECT a.day, a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.size) AS sa, any_value(b.size) AS sb FROM t a JOIN t b ON a.day = b.day AND a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2, 3),
pairs AS (SELECT day, a, b, shared FROM p WHERE shared >= 3 AND shared * 100 >= 55 * least(sa, sb))"""


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def near_dup_pairs(spark, sf):
    return similar_pairs(spark, sf)


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(v, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v)
SELECT root, count(*) AS notes, count(DISTINCT source) AS outlets, max(length(text))::INTEGER AS longest FROM (SELECT v, min(root) AS root FROM r GROUP BY v) JOIN documents ON doc_id = v GROUP BY root""")
def stories(spark, sf):
    c = graphs.components(similar_pairs(spark, sf).select("a", "b"))
    d = table(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return c.join(d, c.v == d.doc_id).groupBy("root").agg(F.count("*").alias("notes"), F.countDistinct("source").alias("outlets"), F.max("n").alias("longest"))


@query(f"""WITH {PAIRS}, x AS (SELECT DISTINCT b.doc_id FROM t a JOIN t b ON a.day + 1 = b.day AND a.w = b.w GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 3 AND count(*) * 100 >= 55 * least(any_value(a.size), any_value(b.size)))
SELECT day, count(*) AS n, count(x.doc_id) AS continued FROM d LEFT JOIN x USING (doc_id) GROUP BY day""")
def continuity(spark, sf):
    d = _day_tokens(spark, sf)
    x = overlapping(d, 1).select(F.col("b").alias("x")).distinct()
    return d.join(x, d.doc_id == x.x, "left").groupBy("day").agg(F.count("*").alias("n"), F.count("x").alias("continued"))


def _edges(spark, sf):
    """Suppliers that deliver to the same order, with the number of orders: people named in the same story."""
    return graphs.pairs_within(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey").filter("w >= 2")


EDGES = """i AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem), e AS (SELECT x.v AS a, y.v AS b, count(*) AS w FROM i x JOIN i y ON x.k = y.k AND x.v < y.v GROUP BY 1, 2 HAVING count(*) >= 2),
u AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e)"""


@query(f"WITH {EDGES} SELECT a, b, w FROM e ORDER BY w DESC, a, b LIMIT 20")
def comention_pairs(spark, sf):
    return _edges(spark, sf).orderBy(F.desc("w"), "a", "b").limit(20)


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v, l_shipdate::DATE AS d FROM lineitem), e AS (SELECT x.v AS a, y.v AS b, count(DISTINCT x.k) AS w, count(DISTINCT x.d) AS days, min(x.d) AS since, max(x.d) AS last FROM i x JOIN i y ON x.k = y.k AND x.v < y.v GROUP BY 1, 2)
SELECT *, CASE WHEN w >= 8 AND days >= 8 THEN 'high' WHEN w >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM e""")
def edges_conf(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("a"), F.to_date("l_shipdate").alias("d")).distinct()
    e = i.join(i.select("k", F.col("a").alias("b")), "k").filter("a < b").groupBy("a", "b").agg(F.countDistinct("k").alias("w"), F.countDistinct("d").alias("days"), F.min("d").alias("since"), F.max("d").alias("last"))
    return e.withColumn("confidence", F.when((F.col("w") >= 8) & (F.col("days") >= 8), "high").when(F.col("w") >= 3, "medium").otherwise("low"))


@query(f"WITH {EDGES}, n AS (SELECT a AS v, count(*) FILTER (b <= 30) AS nn, count(*) FILTER (b > 30) AS ns FROM u GROUP BY 1) SELECT v, nn, ns, round(2.0 * least(nn, ns) + 0.1::DOUBLE * (nn + ns), 4)::DOUBLE AS score, (nn >= 4 AND ns = 0) OR (ns >= 4 AND nn = 0) AS one_sided FROM n")
def bridges(spark, sf):
    n = graphs.undirected(_edges(spark, sf)).groupBy(F.col("a").alias("v")).agg(F.count_if(F.col("b") <= 30).alias("nn"), F.count_if(F.col("b") > 30).alias("ns"))
    score = 2.0 * F.least("nn", "ns") + F.lit(0.1) * (F.col("nn") + F.col("ns"))
    return n.select("v", "nn", "ns", F.round(score, 4).alias("score"), (((F.col("nn") >= 4) & (F.col("ns") == 0)) | ((F.col("ns") >= 4) & (F.col("nn") == 0))).alias("one_sided"))


@query(f"WITH {EDGES} SELECT a AS v, count(*) AS degree, sum(w)::BIGINT AS weight FROM u GROUP BY a")
def degree(spark, sf):
    return graphs.undirected(_edges(spark, sf)).groupBy(F.col("a").alias("v")).agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))


@query(f"WITH {EDGES}, n1 AS (SELECT b AS v FROM u WHERE a = 1), n2 AS (SELECT DISTINCT b AS v FROM u WHERE a IN (SELECT v FROM n1)) SELECT v, min(r)::INTEGER AS radius FROM (SELECT 1 AS v, 0 AS r UNION ALL SELECT v, 1 FROM n1 UNION ALL SELECT v, 2 FROM n2) GROUP BY v")
def ego2(spark, sf):
    u = graphs.undirected(_edges(spark, sf))
    one = u.filter("a = 1").select(F.col("b").alias("v"))
    two = u.join(one, u.a == one.v).select(F.col("b").alias("v"))
    seed = spark.range(1, 2).select(F.col("id").alias("v"), F.lit(0).alias("r"))
    return seed.unionByName(one.withColumn("r", F.lit(1))).unionByName(two.withColumn("r", F.lit(2))).groupBy("v").agg(F.min("r").alias("radius"))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem), e AS (SELECT x.v AS a, y.v AS b, count(*) AS w FROM i x JOIN i y ON x.k = y.k AND x.v < y.v GROUP BY 1, 2 HAVING count(*) >= 12),
u AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), p1 AS (SELECT [a, b] AS path, b AS tip, w FROM u WHERE a = 1), p2 AS (SELECT list_append(path, b) AS path, b AS tip, least(p1.w, u.w) AS w FROM p1 JOIN u ON u.a = p1.tip WHERE p1.tip <> 2 AND NOT list_contains(path, b)),
p3 AS (SELECT list_append(path, b) AS path, b AS tip, least(p2.w, u.w) AS w FROM p2 JOIN u ON u.a = p2.tip WHERE p2.tip <> 2 AND NOT list_contains(path, b)) SELECT array_to_string(path, '>') AS path, len(path)::INTEGER - 1 AS steps, w AS weakest FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) WHERE tip = 2""")
def paths(spark, sf):
    e = _edges(spark, sf).filter("w >= 12")
    return graphs.paths(e, 1, 2, 3).select(F.array_join("path", ">").alias("path"), "steps", "weakest")


@query(f"""WITH RECURSIVE {EDGES}, s AS (SELECT a, b FROM u WHERE w >= 14), r(v, root) AS (SELECT a, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.v) SELECT v, min(root) AS root FROM r GROUP BY v""")
def components(spark, sf):
    return graphs.components(_edges(spark, sf).filter("w >= 14").select("a", "b"))


@query(f"WITH {EDGES} SELECT a AS v, b AS near, w, r FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b)::INTEGER AS r FROM u) WHERE r <= 5")
def top_neighbours(spark, sf):
    u = graphs.undirected(_edges(spark, sf))
    r = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))
    return u.withColumn("r", r).filter("r <= 5").select(F.col("a").alias("v"), F.col("b").alias("near"), "w", "r")


@query()
def label_propagation(spark, sf):
    return graphs.propagate(_edges(spark, sf), 6)


@query("SELECT c_nationkey AS nation, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 10")
def homonyms(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n")).filter("n > 10")
