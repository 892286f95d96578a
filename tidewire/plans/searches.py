"""Ranked search, paging, coverage, and questions turned into queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.plans.registry import query
from tidewire.plans.texts import NORM
from tidewire.session import table


def score(x: Column, words: list[str]) -> tuple[Column, Column]:
    """Hits and score of folded text: ten a hit, fifteen for the whole phrase."""
    padded = F.concat(F.lit(" "), x, F.lit(" "))
    hits = F.lit(0)
    for w in words:
        hits = hits + F.when(padded.contains(f" {w}"), 1).otherwise(0)
    return hits, hits * 10 + F.when(padded.contains(f" {' '.join(words)} "), 15).otherwise(0)


def search(docs: DataFrame, question: str) -> DataFrame:
    """Documents that hold two thirds of the question's words, with their score."""
    words = re.findall("[a-z0-9]+", question.lower())
    # what explode() makes is not computed anew by the filter that follows
    folded = docs.select("doc_id", "source", F.explode(F.array(text.norm(F.col("text")))).alias("x"))
    hits, points = score(F.col("x"), words)
    return folded.select("doc_id", "source", hits.alias("hits"), points.alias("score")).filter(F.col("hits") * 100 >= 67 * len(words))


FOUND = f"""WITH x AS (SELECT doc_id, source, ' ' || {NORM} || ' ' AS x FROM documents), h AS (SELECT doc_id, source, x, (contains(x, ' the'))::INT + (contains(x, ' and'))::INT + (contains(x, ' of'))::INT AS hits FROM x),
f AS (SELECT doc_id, source, hits, hits * 10 + CASE WHEN contains(x, ' the and of ') THEN 15 ELSE 0 END AS score FROM h WHERE hits * 100 >= 201)"""


@query(FOUND + " SELECT doc_id, score FROM f ORDER BY score DESC, doc_id LIMIT 20")
def search_ranked(spark, sf):
    return search(table(spark, sf, "documents"), "the and of").orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score")


@query(FOUND + " SELECT doc_id, score FROM f ORDER BY score DESC, doc_id LIMIT 20 OFFSET 20")
def page2(spark, sf):
    return search(table(spark, sf, "documents"), "the and of").orderBy(F.desc("score"), "doc_id").offset(20).limit(20).select("doc_id", "score")


@query(FOUND + " SELECT source, count(*) AS n FROM f GROUP BY source")
def coverage_by_outlet(spark, sf):
    return search(table(spark, sf, "documents"), "the and of").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_name = 'blue' THEN 100 WHEN starts_with(p_name, 'bl') THEN 80 ELSE 40 END AS tier FROM part WHERE contains(p_name, 'bl')")
def search_names(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").filter(n.contains("bl")).select("p_partkey", F.when(n == "blue", 100).when(n.startswith("bl"), 80).otherwise(40).alias("tier"))


@dataclass(frozen=True)
class Spec:
    """What a question asks for: the measure, filters and the number of rows."""

    by: str
    kind: str | None = None
    days: int | None = None
    most: int = 10


KINDS = ("view", "click", "purchase", "signup", "error", "login", "logout")


def understand(question: str) -> Spec:
    """A question as a Spec, by ordered patterns that each consume what they match."""
    q = " ".join(re.findall("[a-z0-9]+", question.lower()))
    days = re.search(r"last (\d+) days", q)
    most = re.search(r"top (\d+)", q)
    kind = next((k for k in KINDS if re.search(rf"\b{k}s?\b", q)), None)
    by = "day" if re.search(r"\b(per|by|each) day\b", q) else "event_type" if re.search(r"\b(type|kind)s?\b", q) else "user_id"
    return Spec(by, kind, int(days[1]) if days else None, int(most[1]) if most else 10)


def answer(events: DataFrame, spec: Spec) -> DataFrame:
    e = events.withColumn("day", F.to_date("ts"))
    if spec.kind:
        e = e.filter(F.col("event_type") == spec.kind)
    if spec.days:
        now = events.agg(F.max("ts")).first()[0]
        e = e.filter(F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {spec.days} DAYS"))
    return e.groupBy(F.col(spec.by).cast("string").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(spec.most)


@query("SELECT user_id::VARCHAR AS label, count(*) AS n FROM events WHERE event_type = 'click' AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY 1 ORDER BY n DESC, label LIMIT 5")
def nl_query(spark, sf):
    return answer(table(spark, sf, "events"), understand("Top 5 people by clicks in the last 7 days?"))
