"""A registry of chart measures: each is a label and a filter over one table, counted; the SQL comes from the same entry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans import registry
from tidewire.plans.registry import query
from tidewire.session import table


@dataclass(frozen=True)
class Measure:
    """Rows of `source` that `where` keeps, counted by `label` (both are SQL that Spark and DuckDB share)."""

    source: str
    label: str
    where: str = "true"

    def frame(self, spark, sf: str) -> DataFrame:
        rows = table(spark, sf, self.source).filter(self.where)
        return rows.groupBy(F.expr(self.label).cast("string").alias("label")).agg(F.count("*").alias("n"))

    def sql(self) -> str:
        return f"SELECT CAST({self.label} AS VARCHAR) AS label, count(*) AS n FROM {self.source} WHERE {self.where} GROUP BY 1"


TONE = "CASE WHEN value > 50 THEN 'positive' WHEN value < 20 THEN 'negative' ELSE 'neutral' END"
BRANCH = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'executive' WHEN event_type = 'error' THEN 'judiciary' ELSE 'other' END"
SRC = {
    "press_outlet": Measure("documents", "source"),
    "press_tone": Measure("events", TONE),
    "mentions_chosen": Measure("events", "user_id", "user_id IN (1, 2, 3)"),
    "mentions_person": Measure("events", "user_id"),
    "press_scope": Measure("documents", "lang"),
    "press_branch": Measure("events", BRANCH),
    "people_status": Measure("customer", "CASE WHEN c_acctbal > 0 THEN 'current' ELSE 'former' END"),
    "people_body": Measure("customer", "c_mktsegment"),
    "members_bloc": Measure("supplier", "s_nationkey % 4"),
    "members_district": Measure("supplier", "s_nationkey"),
    "members_chamber": Measure("supplier", "s_suppkey % 2"),
    "official_source": Measure("orders", "o_orderpriority"),
    "official_kind": Measure("orders", "o_orderstatus"),
    "official_scope": Measure("orders", "CASE WHEN o_totalprice > 150000 THEN 'national' ELSE 'local' END"),
    "links_confidence": Measure("lineitem", "CASE WHEN l_quantity >= 40 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' ELSE 'low' END"),
    "links_territory": Measure("lineitem", "l_returnflag"),
    "links_actors": Measure("lineitem", "l_suppkey", "l_quantity >= 40"),
}


def _register(name: str, m: Measure) -> None:
    def run(spark, sf):
        return m.frame(spark, sf)

    run.__name__ = f"measure_{name}"
    registry.query(m.sql())(run)


for _name, _measure in SRC.items():
    _register(_name, _measure)


def in_period(df: DataFrame, time: str, days: int, offset: int = 0) -> DataFrame:
    """Rows of the `days` days that end `offset` days before the newest row."""
    now = F.lit(df.agg(F.max(time)).first()[0]).cast("timestamp_ntz")
    return df.filter((F.col(time) > now - F.expr(f"INTERVAL {days + offset} DAYS")) & (F.col(time) <= now - F.expr(f"INTERVAL {offset} DAYS")))


@query("""WITH t AS (SELECT max(ts) AS now FROM events), e AS (SELECT * FROM events, t WHERE ts > now - INTERVAL 14 DAYS AND ts <= now - INTERVAL 7 DAYS) SELECT event_type AS label, count(*) AS n FROM e WHERE contains(event_type, 'i') GROUP BY 1""")
def measure_period(spark, sf):
    """A measure of the week before the last, of labels that hold a text."""
    return in_period(table(spark, sf, "events"), "ts", 7, 7).filter(F.col("event_type").contains("i")).groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT DISTINCT date_trunc('week', ts)::DATE AS week FROM events), s AS (SELECT unnest(generate_series((SELECT min(week) FROM w)::TIMESTAMP, (SELECT max(week) FROM w)::TIMESTAMP, INTERVAL 7 DAYS))::DATE AS week),
c AS (SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT DISTINCT event_type FROM events)
SELECT event_type, week, coalesce(n, 0) AS n FROM s CROSS JOIN k LEFT JOIN c USING (week, event_type)""")
def measure_evolution(spark, sf):
    """Weekly counts of each term with zeros; the calendar is made from each term's row, so nothing is cross joined."""
    c = table(spark, sf, "events").groupBy("event_type", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    ends = c.agg(F.min("week").alias("a"), F.max("week").alias("b")).first()
    weeks = F.explode(F.sequence(F.lit(ends.a), F.lit(ends.b), F.expr("INTERVAL 7 DAYS")))
    return c.select("event_type").distinct().select("event_type", weeks.alias("week")).join(c, ["event_type", "week"], "left").select("event_type", "week", F.coalesce("n", F.lit(0)).alias("n"))


TERMS = ("the", "que", "der", "les")


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({list(TERMS)}) AS term, text FROM documents) WHERE contains(lower(text), term) GROUP BY term")
def measure_terms(spark, sf):
    """Documents that hold each term."""
    low = F.lower("text")
    return table(spark, sf, "documents").select(F.explode(F.array_compact(F.array(*(F.when(low.contains(t), F.lit(t)) for t in TERMS)))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT term, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t}'" for t in TERMS) + " END AS term FROM documents) WHERE term IS NOT NULL GROUP BY term")
def measure_first_term(spark, sf):
    """Documents by the first term that they hold."""
    low = F.lower("text")
    return table(spark, sf, "documents").select(F.coalesce(*(F.when(low.contains(t), F.lit(t)) for t in TERMS)).alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT n_nationkey AS k, n_regionkey AS region, coalesce(p, 0) AS people, coalesce(q, 0) AS before, coalesce(s, 0) AS seats FROM nation
 LEFT JOIN (SELECT c_nationkey AS k, count(*) AS p, count(*) FILTER (c_custkey % 5 > 0) AS q FROM customer GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) b ON b.k = n_nationkey)
SELECT k, people, people - before AS gain, CASE WHEN before > 0 THEN round((people - before) * 100.0 / before, 3)::DOUBLE END AS growth, round(people * 100.0 / sum(people) OVER (), 3)::DOUBLE AS share, CASE WHEN seats > 0 THEN round(people * 1.0 / seats, 3)::DOUBLE END AS per_seat, rank() OVER (PARTITION BY region ORDER BY people DESC)::INTEGER AS place FROM c""")
def territories(spark, sf):
    """Indicators of each unit: gain, growth, share of the whole, people a seat, place within its region."""
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("people"), F.count_if(F.col("c_custkey") % 5 > 0).alias("before"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("seats"))
    c = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey").join(a, "k", "left").join(b, "k", "left").na.fill(0)
    pct = lambda x, y: F.when(y > 0, F.round(x * 100.0 / y, 3))
    return c.select(
        "k", "people", (F.col("people") - F.col("before")).alias("gain"), pct(F.col("people") - F.col("before"), F.col("before")).alias("growth"), pct(F.col("people"), F.sum("people").over(Window.partitionBy())).alias("share"),
        F.when(F.col("seats") > 0, F.round(F.col("people") / F.col("seats"), 3)).alias("per_seat"), F.rank().over(Window.partitionBy("n_regionkey").orderBy(F.desc("people"))).alias("place"),
    )
