"""Queries that keep tables of records: capped scans, fallbacks, archives, upserts, conflicts and entity dictionaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators import windows
from tidewire.operators.graphs import shared_folder
from tidewire.plans.registry import query
from tidewire.session import table


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 40")
def capped_scan(spark, sf):
    """The newest rows of each source, at most forty."""
    return windows.top_k(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 40).select("user_id", "event_id")


@query("SELECT s_suppkey, ntile(7) OVER (ORDER BY s_suppkey)::INTEGER AS lot FROM supplier")
def lots(spark, sf):
    """Sources in even lots, larger ones first. The roster of sources is small by nature."""
    return table(spark, sf, "supplier").select("s_suppkey", F.ntile(7).over(Window.orderBy("s_suppkey")).alias("lot"))


@query("SELECT event_id, (date_diff('day', DATE '1970-01-01', ts::DATE) * 144 + (hour(ts) * 60 + minute(ts)) // 10) * 3 % 5 AS area FROM events")
def rotation(spark, sf):
    """The area whose turn it is in an event's slot of ten minutes."""
    slot = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 144 + F.floor((F.hour("ts") * 60 + F.minute("ts")) / 10)
    return table(spark, sf, "events").select("event_id", F.pmod(slot * 3, F.lit(5)).alias("area"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity IS NOT NULL AND l_shipdate <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAYS QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) <= 3")
def series_tail(spark, sf):
    """The last three values of each series up to its declared end."""
    li = table(spark, sf, "lineitem")
    end = F.lit(li.agg(F.max("l_shipdate")).first()[0]).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
    return windows.top_k(li.filter(F.col("l_quantity").isNotNull() & (F.col("l_shipdate") <= end)), ["l_suppkey"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""WITH x AS (SELECT l_partkey AS k, l_suppkey % 2 AS s, floor(l_extendedprice / l_quantity)::BIGINT AS v FROM lineitem), a AS (SELECT k, min(v) AS v FROM x WHERE s = 0 GROUP BY k), b AS (SELECT k, min(v) AS v FROM x WHERE s = 1 GROUP BY k)
SELECT k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM a FULL JOIN b USING (k) WHERE coalesce(a.v, b.v) BETWEEN 100 AND 1500""")
def fallback_source(spark, sf):
    """The first source's figure, else the second's, within its physical range: one aggregation instead of a full join."""
    odd, v = F.col("l_suppkey") % 2 == 1, F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("long")
    x = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min(F.when(~odd, v)).alias("a"), F.min(F.when(odd, v)).alias("b"))
    return x.select("k", F.coalesce("a", "b").alias("v"), F.when(F.col("a").isNotNull(), "first").otherwise("second").alias("origin")).filter(F.col("v").between(100, 1500))


@query("""WITH p AS (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS step FROM events), m AS (SELECT user_id, min(step) AS step FROM p GROUP BY 1)
SELECT user_id, step, count(*) AS n FROM p JOIN m USING (user_id, step) GROUP BY 1, 2""")
def cascade(spark, sf):
    """Rows of the first feed of each source that has any: a fallback of three steps."""
    step = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    x = table(spark, sf, "events").groupBy("user_id", step.alias("step")).agg(F.count("*").alias("n"))
    return x.groupBy("user_id").agg(F.min_by(F.struct("step", "n"), "step").alias("m")).select("user_id", "m.step", "m.n")


def append_month(rows: DataFrame, path: str, key: str, time: str) -> None:
    """Appends rows to a month-partitioned archive, but for keys that it holds already; a missing archive is begun.

    Only months that occur in `rows` are read of the archive (their names go to the driver, a few a year). A month that holds most rows
    is written by several tasks: the rebalance is split by size where it is skewed.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("month", F.date_format(time, "yyyy-MM"))
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        months = [r.month for r in rows.select("month").distinct().collect()]
        old = spark.read.schema(rows.schema).parquet(path).filter(F.col("month").isin(months)).select("month", key)
        rows = rows.join(old, ["month", key], "left_anti")
    rows.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM orders GROUP BY 1")
def month_archive(spark, sf):
    """The count index of an archive that got two overlapping halves of the rows."""
    shared_folder(spark)
    path = spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/archive-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    append_month(o.filter("o_orderkey % 3 < 2"), path, "o_orderkey", "o_orderdate")
    append_month(o.filter("o_orderkey % 3 > 0"), path, "o_orderkey", "o_orderdate")
    return spark.read.schema("o_orderkey long, o_orderdate timestamp_ntz, month string").parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("ids"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) SELECT o_orderpriority, k <= 100 AS active, count(*) AS n, min(o_orderdate) AS since FROM r GROUP BY 1, 2")
def compaction(spark, sf):
    """Rows of each kind that stay in the live table and rows that go to the archive; none is lost."""
    r = table(spark, sf, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")))
    return r.groupBy("o_orderpriority", (F.col("k") <= 100).alias("active")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("since"))


@query("SELECT user_id, day, n FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 5")
def bounded_history(spark, sf):
    """The last five days of each source's history."""
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return windows.top_k(d, ["user_id"], [F.desc("day")], 5).select("user_id", "day", "n")


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus <> 'P') AS q FROM orders GROUP BY 1)
SELECT k, CASE least(abs(n - 10), abs(f - 10), abs(q - 10)) WHEN abs(n - 10) THEN 'all' WHEN abs(f - 10) THEN 'final' ELSE 'settled' END AS base FROM c""")
def percent_base(spark, sf):
    """Which of three totals a reported number was counted on: the nearest, the first of equals."""
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") != "P").alias("q"))
    near = F.array_min(F.array(*(F.struct(F.abs(F.col(v) - 10).alias("gap"), F.lit(i).alias("i"), F.lit(b).alias("base")) for i, (v, b) in enumerate((("n", "all"), ("f", "final"), ("q", "settled"))))))
    return c.select("k", near["base"].alias("base"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS tag, min(event_id) AS first_id FROM events GROUP BY 1")
def upsert_tags(spark, sf):
    """A repeated hit only adds a tag where none was: the first that is not missing."""
    tag = F.when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by(tag, F.when(tag.isNotNull(), F.struct("ts", "event_id"))).alias("tag"), F.min("event_id").alias("first_id"))


@query("""SELECT c_custkey AS id, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'OTHER') AS chamber FROM customer WHERE c_custkey % 2 = 0 UNION ALL
SELECT o_custkey, 'OTHER' FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def seed_insert(spark, sf):
    """Seeds are inserted where the roster lacks them; missing fields get the default."""
    roster = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.coalesce(F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")), F.lit("OTHER")).alias("chamber"))
    seeds = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct().join(roster, "id", "left_anti").select("id", F.lit("OTHER").alias("chamber"))
    return roster.unionByName(seeds)


@query("""WITH o AS (SELECT s_suppkey AS id, s_nationkey AS src, round(s_acctbal)::BIGINT AS v, DATE '2024-01-01' AS since FROM supplier),
n AS (SELECT id, src, CASE WHEN id % 3 = 0 THEN v + 1 ELSE v END AS v FROM o WHERE src < 5 AND id % 7 <> 0)
SELECT id, src, v, since FROM o WHERE src >= 5 UNION ALL SELECT n.id, n.src, n.v, CASE WHEN o.v = n.v THEN o.since ELSE DATE '2024-02-01' END FROM n LEFT JOIN o USING (id)""")
def slice_replace(spark, sf):
    """One origin's slice is replaced whole; a record that did not change keeps its date."""
    o = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("src"), F.round("s_acctbal").cast("long").alias("v"), F.lit("2024-01-01").cast("date").alias("since"))
    n = o.filter("src < 5 AND id % 7 <> 0").select("id", "src", F.when(F.col("id") % 3 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    was = o.select("id", F.col("v").alias("old"), "since")
    return o.filter("src >= 5").unionByName(n.join(was, "id", "left").select("id", "src", "v", F.when(F.col("old") == F.col("v"), F.col("since")).otherwise(F.lit("2024-02-01").cast("date")).alias("since")))


@query("""WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS v FROM customer WHERE c_custkey % 5 < 4), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 5 > 0)
SELECT id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unknown' WHEN a.v IS NULL THEN 'new' WHEN a.v = b.v THEN 'equal' ELSE 'conflict' END AS state, CASE WHEN a.id IS NOT NULL THEN coalesce(a.v, b.v) END AS v FROM a FULL JOIN b USING (id)""")
def field_load(spark, sf):
    """A loaded field fills an empty one; a different one stays as it is and is reported."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    a = c.filter("id % 5 < 4").select("id", F.when(F.col("id") % 4 > 0, F.col("c_nationkey")).alias("x"), F.lit(1).alias("in_a"))
    b = c.filter("id % 5 > 0").select("id", F.when(F.col("id") % 6 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("y"), F.lit(1).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unknown").when(F.col("x").isNull(), "new").when(F.col("x") == F.col("y"), "equal").otherwise("conflict")
    return a.join(b, "id", "full").select("id", state.alias("state"), F.when(F.col("in_a").isNotNull(), F.coalesce("x", "y")).alias("v"))


@query("""WITH e AS (SELECT c_nationkey AS k, 1 AS p, 'customer' AS origin FROM customer WHERE c_nationkey % 3 = 0 UNION ALL SELECT s_nationkey, 2, 'supplier' FROM supplier WHERE s_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 3, 'nation' FROM nation)
SELECT k, arg_min(origin, p) AS origin, count(DISTINCT origin) AS origins FROM e GROUP BY k""")
def entity_dictionary(spark, sf):
    """One dictionary of several rosters: the first roster's attributes win."""
    part = lambda t, c, p: table(spark, sf, t).select(F.col(c).alias("k"), F.lit(p).alias("p"), F.lit(t).alias("origin"))
    e = part("customer", "c_nationkey", 1).filter("k % 3 = 0").unionByName(part("supplier", "s_nationkey", 2).filter("k % 2 = 0")).unionByName(part("nation", "n_nationkey", 3))
    return e.groupBy("k").agg(F.min_by("origin", "p").alias("origin"), F.countDistinct("origin").alias("origins"))


@query("""WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand || '-' || p_size AS n FROM part), v AS (SELECT p_partkey, unnest([split_part(n, ' ', 1) || ' ' || split_part(n, ' ', 2), split_part(n, ' ', 1) || ' ' || split_part(n, ' ', -1)]) AS name FROM p)
SELECT name, min(p_partkey) AS p_partkey FROM v WHERE length(name) >= 9 GROUP BY name HAVING count(DISTINCT p_partkey) = 1""")
def name_variants(spark, sf):
    """First and second, or first and last word of a name, where just one entity has it."""
    w = F.split(F.concat_ws(" ", "p_name", F.concat_ws("-", "p_brand", "p_size")), " ")
    two = F.concat_ws(" ", w[0], F.coalesce(F.get(w, F.lit(1)), F.lit("")))
    ends = F.concat_ws(" ", w[0], F.element_at(w, -1))
    v = table(spark, sf, "part").select("p_partkey", F.explode(F.array(two, ends)).alias("name")).filter(F.length("name") >= 9)
    return v.groupBy("name").agg(F.min("p_partkey").alias("p_partkey"), F.max("p_partkey").alias("m")).filter("p_partkey = m").drop("m")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier), c AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 50 = 0)
SELECT s_suppkey AS id, 'kept' AS state FROM s WHERE s_nationkey IN (FROM c) UNION ALL SELECT s_suppkey, 'expired' FROM s WHERE s_nationkey NOT IN (FROM c) UNION ALL SELECT c_nationkey, 'reported' FROM c WHERE c_nationkey NOT IN (SELECT s_nationkey FROM s)""")
def verify_roster(spark, sf):
    """A page's names against the roster: matched rows stay, others expire, and unknown names are only reported."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    c = table(spark, sf, "customer").filter("c_custkey % 50 = 0").select(F.col("c_nationkey").alias("k")).distinct().withColumn("seen", F.lit(True))
    state = F.when(F.col("s_suppkey").isNull(), "reported").when(F.col("seen"), "kept").otherwise("expired")
    return s.join(c, "k", "full").select(F.coalesce("s_suppkey", F.col("k").cast("long")).alias("id"), state.alias("state"))


@query("WITH c AS (SELECT s_nationkey AS k, count(*) AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1) SELECT n_nationkey, CASE WHEN n = 1 THEN s END AS id, coalesce(n, 0) AS n FROM nation LEFT JOIN c ON k = n_nationkey")
def resolve_unique(spark, sf):
    """An endpoint's entity where just one fits; null where none or several do."""
    c = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("s"))
    return table(spark, sf, "nation").select("n_nationkey").join(c, "n_nationkey", "left").select("n_nationkey", F.when(F.col("n") == 1, F.col("s")).alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH a AS (SELECT c_mktsegment AS alias, min(c_custkey) AS id FROM customer GROUP BY 1 UNION ALL SELECT 'extra ' || n_name, n_nationkey FROM nation WHERE n_nationkey < 5),
b AS (SELECT n_name AS alias, 1000 + n_nationkey AS id FROM nation UNION ALL SELECT 'extra ' || n_name, 2000 + n_nationkey FROM nation)
SELECT alias, id FROM a UNION ALL SELECT alias, id FROM b WHERE alias NOT IN (SELECT alias FROM a)""")
def registry_merge(spark, sf):
    """A second registry is added without the aliases that the first one has."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"))
    extra = F.concat(F.lit("extra "), "name").alias("alias")
    a = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("alias")).agg(F.min("c_custkey").alias("id")).unionByName(n.filter("k < 5").select(extra, F.col("k").alias("id")))
    b = n.select(F.col("name").alias("alias"), (F.col("k") + 1000).alias("id")).unionByName(n.select(extra, (F.col("k") + 2000).alias("id")))
    return a.unionByName(b.join(a, "alias", "left_anti"))
