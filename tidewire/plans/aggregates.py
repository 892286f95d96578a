"""Aggregate queries: totals, tone, roll-ups, crosstabs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import dates, text
from tidewire.plans.registry import query
from tidewire.session import table

POSITIVE, NEGATIVE = ("good", "best", "ment", "able"), ("bad", "pathetic", "worthless", "ing")


def _money(c):
    return F.col(c).cast("decimal(18,2)")


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (value > 50) AS pos, count(*) FILTER (value < 20) AS neg,
  count(*) FILTER (value BETWEEN 20 AND 50) AS neu, sum(value::DECIMAL(18,2))::DOUBLE AS score FROM events GROUP BY user_id""")
def by_person(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(v > 50).alias("pos"), F.count_if(v < 20).alias("neg"), F.count_if(v.between(20, 50)).alias("neu"), F.sum(_money("value")).cast("double").alias("score"))


@query("SELECT user_id, ts::DATE AS day, count(*) AS total, count(*) FILTER (value > 50) AS pos, sum(value::DECIMAL(18,2))::DOUBLE AS score FROM events GROUP BY 1, 2")
def by_person_day(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("pos"), F.sum(_money("value")).cast("double").alias("score"))


def _tone_sql():
    count = lambda w: f"((length(x) - length(replace(x, '{w}', ''))) // {len(w)})"
    s = " + ".join(map(count, POSITIVE)) + "".join(f" - {count(w)}" for w in NEGATIVE)
    return f"SELECT source, count(*) FILTER (s > 0) AS pos, count(*) FILTER (s < 0) AS neg, count(*) FILTER (s = 0) AS neu, sum(s)::BIGINT AS score FROM (SELECT source, {s} AS s FROM (SELECT source, lower(text) AS x FROM documents)) GROUP BY source"


@query(_tone_sql())
def tone_counts(spark, sf):
    d = table(spark, sf, "documents").select("source", text.tone(F.col("text"), POSITIVE, NEGATIVE).alias("s"))
    return d.groupBy("source").agg(F.count_if(F.col("s") > 0).alias("pos"), F.count_if(F.col("s") < 0).alias("neg"), F.count_if(F.col("s") == 0).alias("neu"), F.sum("s").alias("score"))


@query("SELECT source, count(*) AS notes, count(*) FILTER (lang = 'en') AS home, count(DISTINCT lang) AS langs, max(n_chars) AS longest FROM documents GROUP BY source")
def outlet_totals(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("notes"), F.count_if(F.col("lang") == "en").alias("home"), F.countDistinct("lang").alias("langs"), F.max("n_chars").alias("longest"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def lang_source_rollup(spark, sf):
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de FROM documents GROUP BY source")
def crosstab_pivot(spark, sf):
    return table(spark, sf, "documents").groupBy("source").pivot("lang", ["en", "es", "fr", "de"]).count().na.fill(0)


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, l_suppkey) AS r FROM c)
SELECT CASE WHEN r <= 10 THEN l_suppkey::VARCHAR ELSE 'others' END AS label, sum(n)::BIGINT AS n, count(*) AS members FROM r GROUP BY 1""")
def topn_others(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "l_suppkey").limit(10).select("l_suppkey", F.lit(True).alias("top"))
    d = c.join(F.broadcast(top), "l_suppkey", "left")  # ten rows
    return d.groupBy(F.when(F.col("top"), F.col("l_suppkey").cast("string")).otherwise("others").alias("label")).agg(F.sum("n").alias("n"), F.count("*").alias("members"))


@query("SELECT (isodow(ts) - 1)::INTEGER AS dow, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def dow_hist(spark, sf):
    return table(spark, sf, "events").groupBy(dates.weekday(F.col("ts")).alias("dow"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n, CASE WHEN count(*) = 0 THEN 'none' WHEN max(n_chars) < 5000 THEN 'short' WHEN count(*) < 40 THEN 'few' ELSE 'active' END AS state FROM documents GROUP BY source""")
def health_sources(spark, sf):
    n = F.count("*")
    return table(spark, sf, "documents").groupBy("source").agg(n.alias("n"), F.when(n == 0, "none").when(F.max("n_chars") < 5000, "short").when(n < 40, "few").otherwise("active").alias("state"))


@query("""SELECT user_id, event_type, n, n::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def share_by_type(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))


@query("""SELECT hour(ts)::INTEGER AS hour, CASE WHEN hour(ts) * 60 + minute(ts) < 720 THEN 'morning' WHEN hour(ts) * 60 + minute(ts) < 1140 THEN 'afternoon' ELSE 'night' END AS band, count(*) AS n FROM events GROUP BY 1, 2""")
def time_bands(spark, sf):
    return table(spark, sf, "events").groupBy(F.hour("ts").alias("hour"), dates.band(F.col("ts")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT (ts - INTERVAL 3 HOURS)::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS people FROM events GROUP BY 1")
def local_days(spark, sf):
    return table(spark, sf, "events").groupBy(dates.local_day(F.col("ts"), -3).alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("people"))


@query("SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_keys(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT user_id, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, last_seen, n, date_diff('day', last_seen::DATE, now::DATE)::INTEGER AS quiet_days,
 (SELECT count(*) FROM events e WHERE e.user_id = t.user_id AND e.ts > now - INTERVAL 7 DAYS) AS n7 FROM t, m""")
def freshness(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts")).first()[0]
    return e.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n"), F.count_if(F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")).alias("n7")).withColumn("quiet_days", F.datediff(F.lit(now).cast("date"), F.to_date("last_seen")))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, day) AS k FROM d)
SELECT user_id, count(*) AS days, sum(n)::BIGINT AS total, max(n) AS most, min(day) FILTER (k = 1) AS busiest FROM r GROUP BY 1""")
def dossier(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.groupBy("user_id").agg(F.count("*").alias("days"), F.sum("n").alias("total"), F.max("n").alias("most"), F.min_by("day", F.struct(-F.col("n"), F.col("day"))).alias("busiest"))
