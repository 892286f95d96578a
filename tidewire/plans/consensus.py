"""Queries over numbers of several sources: consensus, contradiction, bias, revisions, seats, shares."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import figures
from tidewire.plans.registry import query
from tidewire.session import table


def _figures(spark, sf):
    """The last price per unit that each source gives for each indicator."""
    li = table(spark, sf, "lineitem").select((F.col("l_partkey") % 100).alias("ind"), (F.col("l_suppkey") % 10).alias("src"), "l_shipdate", "l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("v"))
    return li.groupBy("ind", "src").agg(F.max_by("v", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("last"), F.min_by("v", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first"), F.count("*").alias("n"))


FIG = """WITH x AS (SELECT l_partkey % 100 AS ind, l_suppkey % 10 AS src, l_shipdate, l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity)::BIGINT AS v FROM lineitem),
f AS (SELECT ind, src, arg_max(v, (l_shipdate, l_orderkey, l_linenumber)) AS last, arg_min(v, (l_shipdate, l_orderkey, l_linenumber)) AS first, count(*) AS n FROM x GROUP BY 1, 2)"""


@query(FIG + " SELECT ind, count(*) AS sources, round(median(last), 4) AS med, round(avg(last), 3) AS mean, round(stddev_samp(last), 3) AS sd, min(last) AS low, max(last) AS high FROM f GROUP BY ind")
def consensus_stats(spark, sf):
    return _figures(spark, sf).groupBy("ind").agg(F.count("*").alias("sources"), F.round(F.median("last"), 4).alias("med"), F.round(F.avg("last"), 3).alias("mean"), F.round(F.stddev_samp("last"), 3).alias("sd"), F.min("last").alias("low"), F.max("last").alias("high"))


@query(FIG + """, m AS (SELECT ind, median(last) AS med FROM f GROUP BY ind)
SELECT ind, a.src AS a, b.src AS b, CASE WHEN abs(a.last - b.last) <= 0.08 * med THEN 'agree' WHEN abs(a.last - b.last) <= 2 * (0.08 * med) THEN 'compatible' ELSE 'contradict' END AS verdict FROM f a JOIN f b USING (ind) JOIN m USING (ind) WHERE a.src < b.src""")
def pair_verdicts(spark, sf):
    f = _figures(spark, sf).select("ind", "src", "last")
    m = f.groupBy("ind").agg(F.median("last").alias("med"))
    p = f.select("ind", F.col("src").alias("a"), F.col("last").alias("x")).join(f.select("ind", F.col("src").alias("b"), F.col("last").alias("y")), "ind").filter("a < b").join(m, "ind")
    return p.select("ind", "a", "b", figures.verdict(F.col("x"), F.col("y"), figures.threshold(F.col("med"))).alias("verdict"))


@query(FIG + ", m AS (SELECT ind, median(last) AS med, count(*) AS c FROM f GROUP BY ind) SELECT src, count(*) AS n, round(avg((last - med) / med), 6) AS bias FROM f JOIN m USING (ind) WHERE c >= 3 GROUP BY src")
def source_bias(spark, sf):
    f = _figures(spark, sf)
    m = f.groupBy("ind").agg(F.median("last").alias("med"), F.count("*").alias("c")).filter("c >= 3")
    return f.join(m, "ind").groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg((F.col("last") - F.col("med")) / F.col("med")), 6).alias("bias"))


@query(FIG + " SELECT ind, src, first, last, last - first AS change FROM f WHERE n >= 2 AND first <> last")
def revisions(spark, sf):
    return _figures(spark, sf).filter("n >= 2 AND first <> last").select("ind", "src", "first", "last", (F.col("last") - F.col("first")).alias("change"))


@query(FIG + ", s AS (SELECT ind, (max(last) - min(last)) / abs(median(last)) AS spread FROM f GROUP BY ind) SELECT ind, round(spread, 6) AS spread, CASE WHEN spread < 0.1 THEN 'narrow' WHEN spread < 0.3 THEN 'medium' ELSE 'wide' END AS class FROM s")
def dispersion(spark, sf):
    s = _figures(spark, sf).groupBy("ind").agg(((F.max("last") - F.min("last")) / F.abs(F.median("last"))).alias("s"))
    return s.select("ind", F.round("s", 6).alias("spread"), F.when(F.col("s") < 0.1, "narrow").when(F.col("s") < 0.3, "medium").otherwise("wide").alias("class"))


SEATS = """WITH c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), q AS (SELECT nation, n, (n * 257) // sum(n) OVER () AS base, (n * 257) % sum(n) OVER () AS rest FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, nation) AS k, 257 - sum(base) OVER () AS spare FROM q), s AS (SELECT nation, n, (base + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS seats FROM r)"""


def _seats(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return figures.largest_remainder(c, "n", 257, "nation")


@query(SEATS + " SELECT nation, n, seats FROM s")
def apportionment(spark, sf):
    return _seats(spark, sf).select("nation", "n", "seats")


@query(SEATS + " SELECT nation, round(n::DOUBLE / seats, 4) AS per_seat, round((seats::DOUBLE / sum(seats) OVER ()) / (n::DOUBLE / sum(n) OVER ()), 4) AS index, rank() OVER (ORDER BY n DESC)::INTEGER AS place FROM s WHERE seats > 0")
def representation(spark, sf):
    every = Window.partitionBy()
    s = _seats(spark, sf).filter("seats > 0")
    return s.select("nation", F.round(F.col("n") / F.col("seats"), 4).alias("per_seat"), F.round((F.col("seats") / F.sum("seats").over(every)) / (F.col("n") / F.sum("n").over(every)), 4).alias("index"), F.rank().over(Window.orderBy(F.desc("n"))).alias("place"))


@query("""SELECT event_type, n, n::DOUBLE / sum(n) OVER () AS voice, CASE WHEN n >= 5 THEN round((pos - neg) * 100.0 / n, 2) END AS net, neg AS critical FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS pos, count(*) FILTER (value < 20) AS neg FROM events GROUP BY 1)""")
def share_of_voice(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("pos"), F.count_if(F.col("value") < 20).alias("neg"))
    return c.select("event_type", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("voice"), F.when(F.col("n") >= 5, F.round((F.col("pos") - F.col("neg")) * 100.0 / F.col("n"), 2).cast("double")).alias("net"), F.col("neg").alias("critical"))


@query("""WITH c AS (SELECT l_shipmonth AS m, l_suppkey % 10 AS src, count(*) AS n FROM (SELECT *, date_trunc('month', l_shipdate)::DATE AS l_shipmonth FROM lineitem) GROUP BY 1, 2)
SELECT m, arg_max(src, (n, -src)) AS leader, max(n) AS n FROM c GROUP BY m""")
def leader_matrix(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("m"), (F.col("l_suppkey") % 10).alias("src")).agg(F.count("*").alias("n"))
    return c.groupBy("m").agg(F.max_by("src", F.struct("n", -F.col("src"))).alias("leader"), F.max("n").alias("n"))


@query("SELECT l_suppkey % 10 AS src, quantile_disc(l_shipdate, 0.02) AS since, count(*) AS n FROM lineitem GROUP BY 1")
def coverage_start(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("src"), "l_shipdate")
    return li.groupBy("src").agg(F.expr("percentile_disc(0.02) WITHIN GROUP (ORDER BY unix_micros(l_shipdate::timestamp))").cast("long").alias("u"), F.count("*").alias("n")).select("src", F.timestamp_micros("u").cast("timestamp_ntz").alias("since"), "n")
