"""Boards composed of several queries: editions, outages, alerts, polls, words of the day and regional overviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import windows
from tidewire.plans.registry import query
from tidewire.plans.texts import NORM
from tidewire.session import table


@query("SELECT CASE WHEN m < 660 THEN 'morning' WHEN m < 1080 THEN 'midday' ELSE 'night' END AS edition, count(*) AS n, min(m)::INTEGER AS first_minute FROM (SELECT hour(ts) * 60 + minute(ts) AS m FROM events) GROUP BY 1")
def editions(spark, sf):
    """Rows of each edition by the minute of the day."""
    m = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf, "events").select(m.alias("m")).groupBy(F.when(F.col("m") < 660, "morning").when(F.col("m") < 1080, "midday").otherwise("night").alias("edition")).agg(F.count("*").alias("n"), F.min("m").alias("first_minute"))


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split({NORM}, ' ')) AS w FROM documents), c AS (SELECT w FROM w GROUP BY w HAVING count(*) > 12)
SELECT doc_id, count(*) AS n FROM w WHERE w <> '' AND w NOT IN (FROM c) GROUP BY doc_id""")
def rare_signature(spark, sf):
    """The words of each headline that are not too common to tell stories apart: counted first, so common words never meet a join."""
    w = text.each(table(spark, sf, "documents"), F.array_distinct(F.split(text.norm(F.col("text")), " ")), "w", "doc_id").filter("w <> ''")
    rare = w.groupBy("w").agg(F.count("*").alias("df")).filter("df <= 12")
    return w.join(rare, "w").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY day) AS p FROM d)
SELECT user_id, day, n FROM l WHERE p IS NULL OR p <> n""")
def history_on_change(spark, sf):
    """A history that grows only when the value changes."""
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    return d.withColumn("p", F.lag("n").over(Window.partitionBy("user_id").orderBy("day"))).filter("p IS NULL OR p <> n").drop("p")


OUTAGE = """WITH s AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM s WHERE bad)"""


@query(OUTAGE + " SELECT user_id, event_id, ts FROM k WHERE k = 3")
def outage_alerts(spark, sf):
    """One alert an outage: the third failure in a row; the next success arms it again."""
    bad, at = F.col("event_type") == "error", Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf, "events").select("user_id", "event_id", "ts", bad.alias("bad"), F.sum(F.when(bad, 0).otherwise(1)).over(at).alias("run"))
    return s.filter("bad").withColumn("k", F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id"))).filter("k = 3").select("user_id", "event_id", "ts")


@query("SELECT user_id, event_id, date_diff('microsecond', p, ts) // 1000000 AS quiet FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE ts - p >= INTERVAL 1200 SECONDS")
def stall_alerts(spark, sf):
    """Rows that came after a silence of twenty minutes, and its seconds."""
    p = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    quiet = F.timestamp_diff("MICROSECOND", F.col("p"), F.col("ts"))
    return table(spark, sf, "events").withColumn("p", p).filter(quiet >= 1_200_000_000).select("user_id", "event_id", F.floor(quiet / 1_000_000).alias("quiet"))


@query("""WITH t AS (SELECT max(ts) AS now FROM events), e AS (SELECT *, now FROM events, t), d AS (SELECT user_id, count(*) FILTER (ts > now - INTERVAL 3 DAYS) AS recent, count(*) FILTER (ts > now - INTERVAL 14 DAYS) AS fortnight,
 count(*) FILTER (event_type = 'error' AND ts > now - INTERVAL 7 DAYS) AS errors, max(ts) AS last, any_value(now) AS now FROM e GROUP BY 1)
SELECT user_id, 'spike' AS alert, 2 AS severity FROM d WHERE recent >= 4 AND recent * 14 * 2 >= 5 * 3 * fortnight UNION ALL SELECT user_id, 'criticism', 3 FROM d WHERE errors >= 3 UNION ALL SELECT user_id, 'silence', 1 FROM d WHERE last <= now - INTERVAL 2 DAYS""")
def client_alerts(spark, sf):
    """Alerts of each client with severities, all from one aggregation."""
    e = table(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    since = lambda n: F.col("ts") > now - F.expr(f"INTERVAL {n} DAYS")
    d = e.groupBy("user_id").agg(F.count_if(since(3)).alias("recent"), F.count_if(since(14)).alias("fortnight"), F.count_if((F.col("event_type") == "error") & since(7)).alias("errors"), F.max("ts").alias("last"))
    alert = lambda hit, name, severity: F.when(hit, F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(alert((F.col("recent") >= 4) & (F.col("recent") * 28 >= F.col("fortnight") * 15), "spike", 2), alert(F.col("errors") >= 3, "criticism", 3), alert(F.col("last") <= now - F.expr("INTERVAL 2 DAYS"), "silence", 1)))
    return d.select("user_id", F.explode(found).alias("a")).select("user_id", "a.alert", "a.severity")


@query("""WITH t AS (SELECT max(l_shipdate) AS now FROM lineitem), x AS (SELECT l_partkey % 50 AS subject, l_suppkey AS pollster, l_shipdate AS d, (l_orderkey, l_linenumber) AS k, l_quantity::BIGINT AS v, now FROM lineitem, t),
l AS (SELECT subject, pollster, arg_max(v, (d, k)) AS v, max(d) >= any_value(now) - INTERVAL 45 DAYS AS fresh FROM x GROUP BY 1, 2), g AS (SELECT *, bool_or(fresh) OVER (PARTITION BY subject) AS has FROM l)
SELECT subject, count(*) AS n, any_value(has) AS fresh, sum(v)::BIGINT AS total, min(v) AS low, max(v) AS high, count(*) >= 3 AS solid, max(v) - min(v) >= 10 AS wide FROM g WHERE fresh OR NOT has GROUP BY subject""")
def poll_cards(spark, sf):
    """The last value of each pollster: those of the last 45 days if there are any, else all; with quality tags."""
    li = table(spark, sf, "lineitem")
    limit = F.lit(li.agg(F.max("l_shipdate")).first()[0]).cast("timestamp_ntz") - F.expr("INTERVAL 45 DAYS")
    last = li.groupBy((F.col("l_partkey") % 50).alias("subject"), F.col("l_suppkey").alias("pollster")).agg(F.max_by(F.col("l_quantity").cast("long"), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("v"), (F.max("l_shipdate") >= limit).alias("fresh"))
    # two partial results of each subject, so nothing is sorted by a window
    part = last.groupBy("subject", "fresh").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    best = part.groupBy("subject").agg(F.max_by(F.struct("n", "fresh", "total", "low", "high"), "fresh").alias("b"))
    return best.select("subject", "b.*").select("*", (F.col("n") >= 3).alias("solid"), (F.col("high") - F.col("low") >= 10).alias("wide"))


@query("""WITH f AS (SELECT l_partkey % 20 AS ind, l_suppkey % 4 AS src, arg_max(l_quantity::BIGINT, (l_shipdate, l_orderkey, l_linenumber)) AS v FROM lineitem GROUP BY 1, 2)
SELECT ind, max(v) FILTER (src = 0) AS a, max(v) FILTER (src = 1) AS b, max(v) FILTER (src = 2) AS c, max(v) FILTER (src = 3) AS d, min(v) AS low, max(v) AS high, median(v)::DOUBLE AS med FROM f GROUP BY ind""")
def projections(spark, sf):
    """Sources side by side for each indicator, with the range and the median."""
    f = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 20).alias("ind"), (F.col("l_suppkey") % 4).alias("src")).agg(F.max_by(F.col("l_quantity").cast("long"), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("v"))
    return f.groupBy("ind").agg(*(F.max(F.when(F.col("src") == i, F.col("v"))).alias(n) for i, n in enumerate("abcd")), F.min("v").alias("low"), F.max("v").alias("high"), F.median("v").alias("med"))


@query("""WITH r AS (SELECT l_suppkey AS k, sum(l_quantity)::BIGINT AS whole, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity + 20 ELSE 0 END)::BIGINT AS part FROM lineitem GROUP BY 1) SELECT k, whole, part FROM r WHERE part * 10 > whole * 4""")
def incoherent(spark, sf):
    """Series whose reported part is more than it can be of the whole."""
    r = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").cast("long").alias("whole"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") + 20).otherwise(0)).cast("long").alias("part"))
    return r.filter("part * 10 > whole * 4")


@query(f"""WITH w AS (SELECT DISTINCT doc_id, source, lang, unnest(string_split({NORM}, ' ')) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n, count(DISTINCT source) AS outlets FROM w WHERE length(w) >= 4 GROUP BY 1, 2)
SELECT lang, w, n, outlets FROM c WHERE n >= 4 AND outlets >= 3 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 10""")
def words_of_day(spark, sf):
    """The ten most used words of each scope that three outlets use."""
    w = text.each(table(spark, sf, "documents"), F.array_distinct(F.split(text.norm(F.col("text")), " ")), "w", "source", "lang").filter(F.length("w") >= 4)
    # summed by outlet first: one partial sum per word and outlet is shuffled, and no set of outlets is collected
    c = w.groupBy("lang", "w", "source").agg(F.count("*").alias("n")).groupBy("lang", "w").agg(F.sum("n").alias("n"), F.count("source").alias("outlets")).filter("n >= 4 AND outlets >= 3")
    return windows.top_k(c, ["lang"], [F.desc("n"), F.col("w")], 10).select("lang", "w", "n", "outlets")


@query("""WITH o AS (SELECT n_regionkey AS region, o_orderkey, o_totalprice, o_orderdate, (SELECT max(o_orderdate) FROM orders) AS now FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT region, count(*) FILTER (o_orderdate > now - INTERVAL 90 DAYS) AS recent, count(*) FILTER (o_orderdate > now - INTERVAL 180 DAYS AND o_orderdate <= now - INTERVAL 90 DAYS) AS before, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM o GROUP BY 1""")
def region_board(spark, sf):
    """Each region's rows of this period and the one before, and its best story."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    now = F.lit(o.agg(F.max("o_orderdate")).first()[0]).cast("timestamp_ntz")
    back = lambda n: F.col("o_orderdate") > now - F.expr(f"INTERVAL {n} DAYS")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(F.col("n_regionkey").alias("region")).agg(F.count_if(back(90)).alias("recent"), F.count_if(back(180) & ~back(90)).alias("before"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query("""WITH c AS (SELECT c_mktsegment AS bloc, count(*) AS members FROM customer GROUP BY 1), m AS (SELECT c_mktsegment AS bloc, count(*) AS mentions, count(*) FILTER (o_orderstatus = 'F') AS good, count(*) FILTER (o_orderstatus = 'P') AS bad FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT bloc, members, coalesce(mentions, 0) AS mentions, coalesce(good - bad, 0) AS net FROM c LEFT JOIN m USING (bloc)""")
def bloc_board(spark, sf):
    """Members, mentions and net tone of each bloc; mentions are summed by person before they meet the roster."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("m"), (F.count_if(F.col("o_orderstatus") == "F") - F.count_if(F.col("o_orderstatus") == "P")).alias("t"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy(F.col("c_mktsegment").alias("bloc")).agg(F.count("*").alias("members"), F.coalesce(F.sum("m"), F.lit(0)).alias("mentions"), F.coalesce(F.sum("t"), F.lit(0)).alias("net"))


@query("""SELECT 'source' AS kind, s_suppkey AS id, s_name AS label FROM supplier WHERE contains(s_name, '00001') UNION ALL SELECT 'person', c_custkey, c_name FROM customer WHERE contains(c_name, '00001') UNION ALL SELECT 'indicator', p_partkey, p_name FROM part WHERE contains(p_name, '00001') OR contains(p_type, 'BRASS')""")
def search_kinds(spark, sf):
    """One search over sources, persons and indicators."""
    part = lambda kind, t, p, hit: table(spark, sf, t).filter(hit).select(F.lit(kind).alias("kind"), F.col(f"{p}key").cast("long").alias("id"), F.col(f"{p[:2]}name").alias("label"))
    has = lambda c, w="00001": F.col(c).contains(w)
    return part("source", "supplier", "s_supp", has("s_name")).unionByName(part("person", "customer", "c_cust", has("c_name"))).unionByName(part("indicator", "part", "p_part", has("p_name") | has("p_type", "BRASS")))


@query("""WITH c AS (SELECT l_suppkey AS k, l_returnflag AS list, sum(l_quantity)::BIGINT AS votes FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(votes) OVER (PARTITION BY k)::BIGINT AS base, row_number() OVER (PARTITION BY k ORDER BY votes DESC, list) AS place FROM c)
SELECT k, arg_min(list, place) AS leader, any_value(base) AS base, round(max(votes) FILTER (place = 1) * 100.0 / any_value(base), 2)::DOUBLE AS share, (max(votes) FILTER (place = 1) - coalesce(max(votes) FILTER (place = 2), 0))::BIGINT AS margin FROM r GROUP BY k""")
def result_cards(spark, sf):
    """Leader, share of the base and margin of each contest; the two best of each come from one sorted array of few lists."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("list")).agg(F.sum("l_quantity").cast("long").alias("votes"))
    r = c.groupBy("k").agg(F.sum("votes").alias("base"), F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("minus"), "list"))).alias("x"))
    first, second = -F.col("x")[0]["minus"], F.coalesce(-F.get("x", F.lit(1))["minus"], F.lit(0))
    return r.select("k", F.col("x")[0]["list"].alias("leader"), "base", F.round(first * 100.0 / F.col("base"), 2).alias("share"), (first - second).alias("margin"))


@query("""WITH t AS (SELECT min(ts)::DATE AS d0, max(ts)::DATE AS now FROM events), f AS (SELECT user_id, event_type, min(ts)::DATE AS seen FROM events GROUP BY 1, 2), b AS (SELECT user_id, min(seen) AS base FROM f GROUP BY 1)
SELECT user_id, event_type, CASE WHEN seen = base THEN 'baseline' WHEN seen < now - 3 THEN 'old' ELSE 'pending' END AS state FROM f JOIN b USING (user_id), t""")
def agenda_states(spark, sf):
    """What a source's first run saw is a silent baseline; later documents are pending until they are three days old."""
    e = table(spark, sf, "events")
    now = F.lit(e.agg(F.max(F.to_date("ts"))).first()[0])
    f = e.groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("seen")).withColumn("base", F.min("seen").over(Window.partitionBy("user_id")))
    return f.select("user_id", "event_type", F.when(F.col("seen") == F.col("base"), "baseline").when(F.col("seen") < F.date_sub(now, 3), "old").otherwise("pending").alias("state"))


@query("""WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS n, max(ts) AS last FROM events GROUP BY 1), r AS (SELECT *, max(n) OVER () AS best FROM p)
SELECT user_id, n, CASE WHEN (SELECT count(*) FROM r WHERE n = best) > 1 THEN 'choose' ELSE 'answer' END AS kind FROM r WHERE n = best""")
def tie_answer(spark, sf):
    """The best match, or all equals to choose from."""
    p = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"))
    tied = p.groupBy("n").agg(F.collect_list("user_id").alias("ids")).agg(F.max_by(F.struct("n", "ids"), "n").alias("b"))
    return tied.select(F.col("b.n").alias("n"), F.col("b.ids").alias("ids")).select(F.explode("ids").alias("user_id"), "n", F.when(F.size("ids") > 1, "choose").otherwise("answer").alias("kind"))


@query("""WITH t AS (SELECT max(ts) AS now FROM events), e AS (SELECT event_type, user_id, ts, event_id FROM events, t WHERE ts > now - INTERVAL 21 DAYS AND ts <= now - INTERVAL 6 HOURS)
SELECT event_type, user_id, event_id FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 60""")
def window_dedup_cap(spark, sf):
    """Rows of a time window, one per key, the newest sixty of each kind."""
    e = table(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    e = e.filter((F.col("ts") > now - F.expr("INTERVAL 21 DAYS")) & (F.col("ts") <= now - F.expr("INTERVAL 6 HOURS")))
    one = e.groupBy("event_type", "user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("event_type", "user_id", "m.ts", "m.event_id")
    return windows.top_k(one, ["event_type"], [F.desc("ts"), F.col("event_id")], 60).select("event_type", "user_id", "event_id")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS seen FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM c WHERE n >= 2 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' GROUP BY 1 HAVING count(*) > 14)""")
def new_name_alerts(spark, sf):
    """Names seen twice that were not announced before."""
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    told = c.filter("event_type = 'signup' AND n > 14").select("user_id")
    return c.filter("n >= 2").join(told, "user_id", "left_anti")


@query("SELECT a.k AS k, a.n AS n, b.m AS m, b.m - a.n AS gap, (rank() OVER (ORDER BY a.n DESC) - rank() OVER (ORDER BY b.m DESC))::INTEGER AS shift FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY 1) b USING (k)")
def relate_indicators(spark, sf):
    """Two indicators of each unit side by side, and how far its place differs."""
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("m"))
    place = lambda c: F.rank().over(Window.orderBy(F.desc(c)))
    return a.join(b, "k").select("k", "n", "m", (F.col("m") - F.col("n")).alias("gap"), (place("n") - place("m")).alias("shift"))
