"""Rule queries: dictionaries, vetoes, boolean text queries, checks and classifier evaluation."""

from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.plans.registry import query
from tidewire.plans.texts import NORM
from tidewire.session import table

#: order, label, weight and word of an editable topic dictionary.
TOPICS = ((1, "economy", 2, "the"), (2, "economy", 1, "que"), (3, "justice", 2, "des"), (4, "justice", 1, "and"), (5, "health", 3, "der"), (6, "health", 1, "con"), (7, "sport", 1, "was"))
VALUES = ", ".join(f"({o}, '{lab}', {w}, '{p}')" for o, lab, w, p in TOPICS)


def _rules(spark):
    return spark.createDataFrame(list(TOPICS), "ord int, label string, weight int, word string")


def _hits(spark, sf):
    """Documents joined to the dictionary on whole words of the text: an equi-join on the word, not a loop over rules."""
    d = text.each(table(spark, sf, "documents"), F.array_distinct(F.split(text.norm(F.col("text")), " ")), "word", "doc_id")
    return d.join(_rules(spark), "word")


HITS = f"WITH rules(ord, label, weight, word) AS (VALUES {VALUES}), h AS (SELECT doc_id, ord, label, weight FROM (SELECT DISTINCT doc_id, unnest(string_split({NORM}, ' ')) AS word FROM documents) JOIN rules USING (word))"


@query(HITS + ", s AS (SELECT doc_id, label, sum(weight) AS score, min(ord) AS o FROM h GROUP BY 1, 2) SELECT doc_id, label, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS r FROM s) WHERE r = 1")
def topic_argmax(spark, sf):
    s = _hits(spark, sf).groupBy("doc_id", "label").agg(F.sum("weight").alias("score"), F.min("ord").alias("o"))
    return s.groupBy("doc_id").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("o"))).alias("m")).select("doc_id", "m.label", "m.score")


@query(HITS + " SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id")
def multi_label(spark, sf):
    return _hits(spark, sf).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


@query(HITS + " SELECT label, count(*) AS docs FROM (SELECT doc_id, arg_min(label, ord) AS label FROM h GROUP BY doc_id) GROUP BY label")
def first_match(spark, sf):
    return _hits(spark, sf).groupBy("doc_id").agg(F.min_by("label", "ord").alias("label")).groupBy("label").agg(F.count("*").alias("docs"))


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(the|que)([^a-z0-9]|$)') AND (NOT regexp_matches(text, '[$#&]{3}|!!') OR regexp_matches(lower(text), 'password|token'))")
def veto_filter(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").filter(low.rlike("(^|[^a-z0-9])(the|que)([^a-z0-9]|$)") & (~F.col("text").rlike("[$#&]{3}|!!") | low.rlike("password|token"))).select("doc_id", "source")


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || {NORM} || ' ' AS x FROM documents) WHERE contains(x, ' the ') AND (contains(x, 'tion') OR contains(x, 'ment')) AND NOT contains(x, 'of the')")
def bool_query(spark, sf):
    return table(spark, sf, "documents").filter(text.boolean_query(F.col("text"), 'the tion|ment -"of the"')).select("doc_id")


@query("""WITH p AS (SELECT d.doc_id, quality, CASE WHEN regexp_matches(text, '[$#&]{3}|!!| \\| ') THEN 0 ELSE 1 END AS guess FROM documents d JOIN labels USING (doc_id))
SELECT quality, guess, count(*) AS n FROM p GROUP BY 1, 2""")
def gold_eval(spark, sf):
    p = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("quality", F.when(F.col("text").rlike(r"[$#&]{3}|!!| \| "), 0).otherwise(1).alias("guess"))
    return p.groupBy("quality", "guess").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_tax > 0.07 THEN 'tax' END) AS broken
FROM lineitem WHERE l_quantity > 45 OR l_discount > 0.09 OR l_tax > 0.07""")
def constraints(spark, sf):
    bad = {"quantity": F.col("l_quantity") > 45, "discount": F.col("l_discount") > 0.09, "tax": F.col("l_tax") > 0.07}
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in bad.items())))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", broken.alias("b")).filter(F.size("b") > 0).select("l_orderkey", "l_linenumber", F.array_join("b", ",").alias("broken"))


@query("""SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphan_lines, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS empty_orders,
 (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphan_orders""")
def integrity(spark, sf):
    o, li, c = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    count = lambda df, n: df.agg(F.count("*").alias(n))
    a = count(li.join(o, li.l_orderkey == o.o_orderkey, "left_anti"), "orphan_lines")
    b = count(o.join(li, li.l_orderkey == o.o_orderkey, "left_anti"), "empty_orders")
    d = count(o.join(c, o.o_custkey == c.c_custkey, "left_anti"), "orphan_orders")
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(a).join(one(b), "k").join(one(d), "k").drop("k")


@query("SELECT kind, count(*) AS docs FROM (SELECT unnest(['token', 'access', 'email', 'card']) AS kind, unnest([regexp_matches(text, '(?i)(password|token|secret) *[:=]'), regexp_matches(text, 'AKIA[A-Z0-9]{16}'), regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+\\.[a-z]+'), regexp_matches(text, '[0-9]{16}')]) AS hit FROM documents) WHERE hit GROUP BY kind")
def detectors(spark, sf):
    rules = {"token": "(?i)(password|token|secret) *[:=]", "access": "AKIA[A-Z0-9]{16}", "email": r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", "card": "[0-9]{16}"}
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(k)) for k, p in rules.items())))
    return table(spark, sf, "documents").select(F.explode(hits).alias("kind")).groupBy("kind").agg(F.count("*").alias("docs"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAYS THEN 'open' WHEN o_totalprice > 200000 THEN 'watch' ELSE 'wait' END AS phase FROM orders""")
def phases(spark, sf):
    o = table(spark, sf, "orders")
    last = F.lit(o.agg(F.max("o_orderdate")).first()[0]).cast("timestamp_ntz")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderdate") > last - F.expr("INTERVAL 30 DAYS"), "open").when(F.col("o_totalprice") > 200000, "watch").otherwise("wait").alias("phase"))
