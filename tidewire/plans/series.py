"""Window queries over events: recency, streaks, dense series, spikes, periods."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.operators import windows
from tidewire.plans.registry import query
from tidewire.session import table


def _daily(spark, sf):
    return table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))


@query("SELECT user_id, event_id, ts, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INTEGER AS rn FROM events) WHERE rn <= 15")
def topk_recent(spark, sf):
    return windows.top_k(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 15).select("user_id", "event_id", "ts", "rn")


@query("SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf):
    return windows.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query("SELECT user_id, n, rank() OVER (ORDER BY n DESC)::INTEGER AS place, n::DOUBLE / sum(n) OVER () AS share, n::DOUBLE / max(n) OVER () AS of_max FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def rank_share(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return c.select("user_id", "n", F.rank().over(Window.orderBy(F.desc("n"))).alias("place"), (F.col("n") / F.sum("n").over(every)).alias("share"), (F.col("n") / F.max("n").over(every)).alias("of_max"))


@query("SELECT c_custkey, floor((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) * 5 / count(*) OVER ())::INTEGER AS class FROM customer")
def quintiles(spark, sf):
    return windows.quantile_class(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")], 5).select("c_custkey", "class")


@query("""WITH f AS (SELECT user_id, ts, event_id, value < 30 AS bad, sum(CASE WHEN value < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, min(ts) AS since, count(*) AS length FROM f WHERE bad GROUP BY user_id, g""")
def streaks(spark, sf):
    return windows.streaks(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], F.col("value") < 30)


@query("SELECT user_id, day, n, n - lag(n) OVER (PARTITION BY user_id ORDER BY day) AS delta FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def lag_deltas(spark, sf):
    d = _daily(spark, sf).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return d.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("user_id").orderBy("day")))


DENSE = """WITH c AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
k AS (SELECT user_id, unnest(generate_series((SELECT min(ts::DATE) FROM events), (SELECT max(ts::DATE) FROM events), INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT user_id FROM events)),
d AS (SELECT user_id, day, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (user_id, day))"""


@query(DENSE + " SELECT * FROM d")
def dense_series(spark, sf):
    return windows.dense_days(_daily(spark, sf), ["user_id"], "day").select("user_id", "day", "n")


@query(DENSE + """, s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW)::BIGINT AS n3,
 coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 16 DAYS PRECEDING AND INTERVAL 3 DAYS PRECEDING), 0)::BIGINT AS n14 FROM d)
SELECT user_id, day, n, n3, n14 FROM s WHERE n3 >= 4 AND n3 / 3.0 >= 2.5 * greatest(n14 / 14.0, 0.3)""")
def spikes(spark, sf):
    return windows.spikes(windows.dense_days(_daily(spark, sf), ["user_id"], "day"), ["user_id"], "day", "n").select("user_id", "day", "n", "n3", "n14")


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, max(ts) AS last_seen, count(*) FILTER (ts > now - INTERVAL 7 DAYS) AS week, count(*) FILTER (ts <= now - INTERVAL 7 DAYS AND ts > now - INTERVAL 14 DAYS) AS before,
 max(ts) < any_value(now) - INTERVAL 1 DAY AS silent FROM events, m GROUP BY user_id""")
def silence_surge(spark, sf):
    e = table(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    ago = lambda n: now - F.expr(f"INTERVAL {n} DAYS")
    return e.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count_if(F.col("ts") > ago(7)).alias("week"), F.count_if((F.col("ts") <= ago(7)) & (F.col("ts") > ago(14))).alias("before"), (F.max("ts") < ago(1)).alias("silent"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), c AS (SELECT event_type, count(*) FILTER (ts > now - INTERVAL 10 DAYS) AS cur, count(*) FILTER (ts <= now - INTERVAL 10 DAYS AND ts > now - INTERVAL 20 DAYS) AS prev FROM events, m GROUP BY 1)
SELECT event_type, cur, prev, CASE WHEN prev * 2 >= cur THEN round((cur - prev) * 100.0 / prev, 1) END AS delta_pct FROM c""")
def period_compare(spark, sf):
    e = table(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    ago = lambda n: now - F.expr(f"INTERVAL {n} DAYS")
    c = e.groupBy("event_type").agg(F.count_if(F.col("ts") > ago(10)).alias("cur"), F.count_if((F.col("ts") <= ago(10)) & (F.col("ts") > ago(20))).alias("prev"))
    return c.withColumn("delta_pct", F.when(F.col("prev") * 2 >= F.col("cur"), F.round((F.col("cur") - F.col("prev")) * 100.0 / F.col("prev"), 1).cast("double")))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 900 SECONDS PRECEDING AND CURRENT ROW) AS n15 FROM events")
def trailing_rate(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy(at).rangeBetween(-900_000_000, 0)).alias("n15"))


@query("SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def weekly(spark, sf):
    return table(spark, sf, "events").groupBy(dates.week(F.col("ts")).alias("week"), "event_type").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS k FROM c)
SELECT day, max(event_type) FILTER (k = 1) AS leader, max(n) FILTER (k = 1) - coalesce(max(n) FILTER (k = 2), 0) AS margin FROM r GROUP BY day""")
def top2_margin(spark, sf):
    c = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    r = windows.top_k(c, ["day"], [F.desc("n"), F.col("event_type")], 2)
    return r.groupBy("day").agg(F.max(F.when(F.col("rn") == 1, F.col("event_type"))).alias("leader"), (F.max(F.when(F.col("rn") == 1, F.col("n"))) - F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("n"))), F.lit(0))).alias("margin"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    e = table(spark, sf, "events").withColumn("opens", F.when(before.isNull() | (F.col("ts") - before > F.expr("INTERVAL 12 HOURS")), 1).otherwise(0))
    return e.withColumn("k", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "k").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("k")


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role <> prev) AS changes, count(*) FILTER (text LIKE '%?%') AS questions FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY conv_id")
def threads(spark, sf):
    c = table(spark, sf, "conversations").withColumn("prev", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") != F.col("prev")).alias("changes"), F.count_if(F.col("text").contains("?")).alias("questions"))
