"""Join queries: dictionaries, aliases, rosters, as-of, intervals, edit distance."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.plans.registry import query
from tidewire.plans.texts import FOLD, NORM
from tidewire.session import table


@query(f"SELECT item_id, doc_id FROM (SELECT item_id, {NORM} AS phrase FROM benchmark) JOIN (SELECT doc_id, ' ' || {NORM} || ' ' AS x FROM documents) ON contains(x, ' ' || phrase || ' ') WHERE phrase <> ''")
def dict_join(spark, sf):
    """Phrases of a dictionary and the documents that hold them, anywhere and in all their words: the first three words of a phrase
    (or as many as it has) find candidates by equality, and these alone are compared whole."""
    b = table(spark, sf, "benchmark").select("item_id", text.norm(F.col("text")).alias("phrase")).filter("phrase <> ''").withColumn("n", F.least(F.size(F.split("phrase", " ")), F.lit(3))).withColumn("gram", F.array_join(F.slice(F.split("phrase", " "), 1, 3), " "))
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(text.norm(F.col("text")))).alias("x"))
    after = lambda k: F.slice("w", F.lit(k + 1), F.size("w") - k).alias(f"w{k}")
    # only as many words as the dictionary's phrases begin with: three, but for shorter ones
    kinds = {
        1: F.col("w"),
        2: F.transform(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("w0"), after(1)), lambda x: F.concat_ws(" ", x["w0"], x["w1"])),
        3: F.transform(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 2).alias("w0"), F.slice("w", F.lit(2), F.size("w") - 2).alias("w1"), after(2)), lambda x: F.concat_ws(" ", x["w0"], x["w1"], x["w2"])),
    }
    used = sorted(r.n for r in b.select("n").distinct().collect())  # three rows at most
    some = [F.when(F.size("w") >= n, kinds[n]).otherwise(F.array().cast("array<string>")) for n in used] or [F.array().cast("array<string>")]
    grams = d.select("doc_id", F.split("x", " ").alias("w")).select("doc_id", F.explode(F.array_distinct(F.concat(*some))).alias("gram"))
    met = grams.join(b.select("item_id", "phrase", "gram"), "gram").select("item_id", "phrase", "doc_id").distinct()
    padded = F.concat(F.lit(" "), "x", F.lit(" "))
    return met.join(d, "doc_id").filter(padded.contains(F.concat(F.lit(" "), "phrase", F.lit(" ")))).select("item_id", "doc_id")


@query("SELECT alias, min(p_partkey) AS p_partkey FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS alias FROM part) GROUP BY alias HAVING count(DISTINCT p_partkey) = 1")
def unique_alias(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("alias"))
    return a.groupBy("alias").agg(F.countDistinct("p_partkey").alias("n"), F.min("p_partkey").alias("p_partkey")).filter("n = 1").drop("n")


@query("""WITH a AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 5000 THEN 'small' ELSE 'large' END AS was FROM customer WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT o_custkey AS id, CASE WHEN sum(o_totalprice::DECIMAL(18,2)) < 1000000 THEN 'small' ELSE 'large' END AS now FROM orders GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, was, now, coalesce(now, was) AS kept, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'expire' WHEN was = now THEN 'keep' ELSE 'update' END AS action FROM a FULL JOIN b ON a.id = b.id""")
def roster_merge(spark, sf):
    """An old roster and what a source says now, person by person: who is new, gone, changed or the same."""
    a = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 5000, "small").otherwise("large").alias("was"), F.lit(True).alias("old"))
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.sum(F.col("o_totalprice").cast("decimal(18,2)")) < 1000000, "small").otherwise("large").alias("now"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("now").isNull(), "expire").when(F.col("was") == F.col("now"), "keep").otherwise("update")
    return a.join(b, "id", "full").select("id", "was", "now", F.coalesce("now", "was").alias("kept"), action.alias("action"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_new(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_watch(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("""WITH e AS (SELECT user_id, ts, event_id, value FROM events WHERE event_id % 2 = 0), q AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 2 = 1)
SELECT q.event_id, e.event_id AS seen_id, e.value FROM q ASOF LEFT JOIN e ON q.user_id = e.user_id AND q.ts >= e.ts""")
def asof_latest(spark, sf):
    """The last even event of the user at or before each odd one: both sides in one sorted stream, last value carried forward."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value", (F.col("event_id") % 2).alias("odd"))
    w = Window.partitionBy("user_id").orderBy("ts", "odd").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("odd") == 0, F.struct("event_id", "value")), ignorenulls=True).over(w)
    return e.withColumn("s", seen).filter("odd = 1").select("event_id", F.col("s.event_id").alias("seen_id"), F.col("s.value").alias("value"))


@query("""WITH e AS (SELECT l_suppkey, l_partkey % 50 AS item, l_shipdate FROM lineitem), g AS (SELECT *, CASE WHEN l_shipdate - lag(l_shipdate) OVER w <= INTERVAL 7 DAYS THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY l_suppkey, item ORDER BY l_shipdate)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY l_suppkey, item ORDER BY l_shipdate) AS k FROM g) SELECT l_suppkey, item, min(l_shipdate) AS since, max(l_shipdate) AS upto, count(*) AS n FROM s GROUP BY l_suppkey, item, k""")
def interval_merge(spark, sf):
    e = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("item"), "l_shipdate")
    w = Window.partitionBy("l_suppkey", "item").orderBy("l_shipdate")
    opens = F.when(F.col("l_shipdate") - F.lag("l_shipdate").over(w) <= F.expr("INTERVAL 7 DAYS"), 0).otherwise(1)
    s = e.withColumn("opens", opens).withColumn("k", F.sum("opens").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("l_suppkey", "item", "k").agg(F.min("l_shipdate").alias("since"), F.max("l_shipdate").alias("upto"), F.count("*").alias("n")).drop("k")


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w)::INTEGER AS d FROM v a JOIN v b ON a.w < b.w WHERE levenshtein(a.w, b.w) <= 2""")
def fuzzy_names(spark, sf):
    """Words within two edits. Two words of which one is within two edits of the other have close lengths, and cut into three
    pieces at least one piece of the shorter one is whole in the longer: candidates meet on (piece, length)."""
    v = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().withColumn("n", F.length("w"))
    cut = lambda n, k: F.floor(n * k / 3).cast("int")
    own = F.array(*(F.struct(F.lit(k).alias("k"), F.expr(f"substring(w, int(floor(n * {k} / 3)) + 1, int(floor(n * {k + 1} / 3)) - int(floor(n * {k} / 3)))").alias("piece")) for k in range(3)))
    left = v.select("w", "n", F.explode(own).alias("p")).select(F.col("w").alias("x"), F.col("n").alias("m"), "p.k", "p.piece")
    # the longer word gives all its substrings of the lengths that pieces of a word of length m can have
    right = v.select("w", "n", F.explode(F.sequence(F.greatest(F.col("n") - 2, F.lit(1)), F.col("n"))).alias("m")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    right = right.withColumn("len", cut(F.col("m"), F.col("k") + 1) - cut(F.col("m"), F.col("k"))).withColumn("at", cut(F.col("m"), F.col("k")))
    right = right.withColumn("s", F.explode(F.sequence(F.greatest(F.col("at") - 1, F.lit(1)), F.col("at") + 3))).select(F.col("w").alias("y"), "m", "k", F.expr("substring(w, s, len)").alias("piece")).distinct()
    pairs = left.join(right, ["m", "k", "piece"]).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("d", F.levenshtein("a", "b", 2)).filter("d >= 0")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS p FROM lineitem) SELECT x.a AS a, y.a AS b, count(*) AS common FROM e x JOIN e y ON x.p = y.p AND x.a < y.a GROUP BY 1, 2""")
def common_neighbours(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), "l_partkey").distinct()
    return e.join(e.withColumnRenamed("a", "b"), "l_partkey").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))


@query("""SELECT c_custkey, c_name, n_name, r_name, coalesce(n, 0) AS orders, total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def enrich(spark, sf):
    c, n, r, o = (table(spark, sf, t) for t in ("customer", "nation", "region", "orders"))
    o = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("orders"), "total")


@query("SELECT id, max(kind) AS kind, count(*) AS seen FROM (SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT o_custkey, 'buyer' FROM orders) GROUP BY id")
def union_first_wins(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit("buyer").alias("kind"))
    return c.unionByName(o).groupBy("id").agg(F.max("kind").alias("kind"), F.count("*").alias("seen"))


@query(f"SELECT source, key, min(doc_id) AS doc_id FROM (SELECT doc_id, source, sha256({FOLD}) AS key FROM documents) GROUP BY source, key")
def dedup_by_key(spark, sf):
    k = F.sha2(text.fold(F.col("text")), 256)
    return table(spark, sf, "documents").groupBy("source", k.alias("key")).agg(F.min("doc_id").alias("doc_id"))


@query("(SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL (SELECT n_nationkey FROM nation INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def set_operations(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    s = table(spark, sf, "supplier").filter("s_acctbal > 5000").select("s_nationkey")
    c = table(spark, sf, "customer").filter("c_acctbal > 9000").select("c_nationkey")
    return n.subtract(s).unionAll(n.intersect(c))
