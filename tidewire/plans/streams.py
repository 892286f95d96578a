"""Streaming queries, each with the batch SQL that it must equal.

Windows, sessions and alarms run in append mode over events that arrive in time order: a result leaves when the watermark passes its
end, and its state with it.
"""

from pyspark.sql import functions as F

from tidewire.plans.registry import query
from tidewire.session import table
from tidewire.streaming.events import arrivals, drain, naive, read, replay, watch


def _events(spark, sf):
    return arrivals(table(spark, sf, "events"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    build = lambda s: s.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return naive(replay(spark, _events(spark, sf), build).select(F.col("w.start").alias("day"), "event_type", "n"), "day")


@query("SELECT s AS since, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1")
def stream_sliding(spark, sf):
    build = lambda s: s.withWatermark("ts", "1 day").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return naive(replay(spark, _events(spark, sf), build).select(F.col("w.start").alias("since"), "n"), "since")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS since, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf):
    build = lambda s: s.withWatermark("ts", "1 day").groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return naive(replay(spark, _events(spark, sf), build).select("user_id", F.col("w.start").alias("since"), "n"), "since")


@query("SELECT count(DISTINCT (user_id, event_type)) AS keys FROM events")
def stream_dedup(spark, sf):
    """Keys seen: state leaves a day after a key was first seen, and what comes again later is merged after the stream."""
    build = lambda s: s.withWatermark("ts", "1 day").select("user_id", "event_type", "ts").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    out = replay(spark, _events(spark, sf), build).filter("event_type IS NOT NULL")
    return out.select("user_id", "event_type").distinct().agg(F.count("*").alias("keys"))


@query("""SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE NOT (event_id % 10 = 0 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 4 FROM events)) GROUP BY 1""")
def stream_late_rows(spark, sf):
    """Rows that come half a stream too late find their windows closed and are dropped: every tenth row of the first slice."""
    a, b, c, d, closing = _events(spark, sf)
    slow = F.col("event_id") % 10 == 0
    parts = [a.filter(~slow), b, c.unionByName(a.filter(slow)), d, closing]
    build = lambda s: s.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("event_id").alias("n"))
    return naive(replay(spark, parts, build).select(F.col("w.start").alias("day"), "n"), "day")


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM (SELECT DISTINCT user_id, date_trunc('millisecond', ts) AS ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, 'opened' AS kind, ts AS at FROM e WHERE before IS NULL OR ts - before > INTERVAL 1 DAY UNION ALL SELECT user_id, 'stalled', ts FROM e WHERE after IS NULL OR after - ts > INTERVAL 1 DAY""")
def stream_alarms(spark, sf):
    """Who begins and who falls silent for a day: timers raise the alarm once, and the state of a silent person is dropped."""
    build = lambda s: watch(s.withWatermark("ts", "1 hour"), "user_id", 1)
    return naive(replay(spark, _events(spark, sf), build), "at")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > (TIMESTAMP '2024-01-20' - INTERVAL 10 DAYS) AND ts <= TIMESTAMP '2024-01-20' + INTERVAL 2 DAYS GROUP BY 1")
def stream_late(spark, sf):
    """Rows older than ten days, or more than two days ahead, of a fixed collection time are dropped before the count."""
    now = F.lit("2024-01-20").cast("timestamp")
    s = read(spark, sf).filter((F.col("ts") > now - F.expr("INTERVAL 10 DAYS")) & (F.col("ts") <= now + F.expr("INTERVAL 2 DAYS"))).groupBy("event_type").agg(F.count("*").alias("n"))
    return drain(s)


@query("SELECT user_id, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_monotonic(spark, sf):
    """The newest row per key, as an upsert that older rows never undo: a maximum of (time, id) kept as state."""
    s = read(spark, sf).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("user_id", "m.ts", "m.event_id", "m.value")
    return naive(drain(s), "ts")
