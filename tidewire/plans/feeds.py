"""Feeds, JSON files, HTML tables, safe sinks and poll headlines as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import poll_values
from tidewire.operators.graphs import work_folder
from tidewire.plans.registry import query
from tidewire.session import table
from tidewire.sources import feeds, sinks


def _rss(spark, sf):
    """One feed a customer that has orders: RSS for even keys, Atom for odd ones; every seventh is cut off before its items."""
    o = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rss = F.concat(F.lit("<item><title><![CDATA[Order & "), F.col("o_orderkey").cast("string"), F.lit("]]></title><link>http://x.org/"), F.col("o_orderkey").cast("string"), F.lit("</link><pubDate>"), F.col("day"), F.lit("T10:00:00Z</pubDate><description>&lt;b&gt;"), "o_orderpriority", F.lit("&lt;/b&gt;</description></item>"))
    atom = F.concat(F.lit('<entry><title type="text">Order &amp; '), F.col("o_orderkey").cast("string"), F.lit('</title><link rel="alternate" href="http://x.org/'), F.col("o_orderkey").cast("string"), F.lit('"/><updated>'), F.col("day"), F.lit("T10:00:00+00:00</updated><summary>"), "o_orderpriority", F.lit("</summary></entry>"))
    even = F.col("o_custkey") % 2 == 0
    o = o.select("o_custkey", F.when(even, rss).otherwise(atom).alias("item"), "o_orderkey")
    parts = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), "\n")
    cut = F.when(F.col("o_custkey") % 7 == 0, F.lit("")).otherwise(body)
    return parts.select(F.col("o_custkey").alias("id"), F.when(even, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel>'), cut, F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed>"), cut, F.lit("</feed>"))).alias("xml"))


@query("""SELECT o_custkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS nth, 'Order & ' || o_orderkey AS title, 'http://x.org/' || o_orderkey AS link,
 date_trunc('day', o_orderdate) + INTERVAL 10 HOURS AS published, CASE WHEN o_custkey % 2 = 0 THEN '<b>' || o_orderpriority || '</b>' ELSE o_orderpriority END AS summary FROM orders WHERE o_custkey % 7 <> 0""")
def feed_items(spark, sf):
    """Entries of RSS and Atom feeds."""
    return feeds.feed_entries(_rss(spark, sf), "id", "xml").withColumn("published", F.col("published").cast("timestamp_ntz"))


@query("SELECT o_custkey AS id, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE count(*) END AS entries, CASE WHEN o_custkey % 7 = 0 THEN 'silent' ELSE 'active' END AS status FROM orders GROUP BY o_custkey")
def feed_health(spark, sf):
    """Each feed's number of entries and status."""
    f = _rss(spark, sf)
    return feeds.feed_status(f, feeds.feed_entries(f, "id", "xml"), "id", "xml").select("id", "entries", "status")


@query("SELECT n_nationkey AS key, n_name AS name, (n_regionkey + 1)::INTEGER AS seats FROM nation")
def html_rosters(spark, sf):
    """Rows of an HTML table by the names of its header, whatever the order of its columns."""
    n = table(spark, sf, "nation")
    row = F.concat(F.lit("<tr><td>"), F.col("n_name"), F.lit("</td><td class='n'><b>"), (F.col("n_regionkey") + 1).cast("string"), F.lit("</b></td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    page = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    page = page.select(F.col("n_regionkey").alias("id"), F.concat(F.lit("<p>List</p><table><tr><td>All members</td></tr><tr><th>Member</th><th>Séats</th><th>Key</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    t = feeds.named_rows(feeds.html_tables(page, "id", "html"), {"key": ("key", "id"), "name": ("name", "member"), "seats": ("seats",)})
    return t.select(F.col("key").cast("int").alias("key"), "name", F.col("seats").cast("int").alias("seats"))


@query(r"""SELECT page_id, count(*) AS nodes, sum(length(node))::BIGINT AS chars FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(unnest(regexp_split_to_array(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>')),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS node FROM pages) WHERE node <> '' GROUP BY page_id""")
def page_nodes(spark, sf):
    """The texts between a page's tags."""
    t = feeds.text_nodes(table(spark, sf, "pages"), "page_id", "html")
    return t.groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("nodes"), F.sum(F.length("node").cast("long")).alias("chars"))


@query("SELECT 'there' AS source, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'missing', 0, 'none' UNION ALL SELECT 'broken', 0, 'none'")
def json_default(spark, sf):
    """A JSON file read with a default: there, missing, and broken."""
    base = work_folder(spark, "json")
    sinks.to_json(table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).coalesce(1), f"{base}/there")
    spark.range(1).select(F.lit("[{oh no").alias("value")).write.text(f"{base}/broken")
    schema, out = "key int, name string", None
    for kind in ("there", "missing", "broken"):
        if kind == "there":
            part = spark.read.schema(schema).json(f"{base}/there")
        else:
            part = feeds.json_or(spark, f"{base}/{kind}", schema, [(0, "none")])
        part = part.select(F.lit(kind).alias("source"), "key", "name")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT 1 AS step, 'written' AS state, (SELECT count(*) FROM supplier) AS kept UNION ALL SELECT 2, 'same', (SELECT count(*) FROM supplier)
 UNION ALL SELECT 3, 'kept', (SELECT count(*) FROM supplier) UNION ALL SELECT 4, 'written', (SELECT count(*) + 1 FROM supplier)""")
def safe_publish(spark, sf):
    """A result published four times: new; the same but for its time; smaller, which is refused; larger."""
    path = work_folder(spark, "publish")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    extra = s.unionByName(spark.createDataFrame([(-1, "new")], "s_suppkey long, s_name string"))
    rows = []
    for step, df in enumerate((s, s, s.filter("s_suppkey > 1"), extra), 1):
        got = sinks.publish(df.withColumn("written_at", F.lit(step)), path, ignore=("written_at",), least=1.0)
        rows.append((step, got.state, spark.read.parquet(path).count()))
    return spark.createDataFrame(rows, "step int, state string, kept long")


@query("SELECT doc_id, lang, text FROM documents")
def csv_round_trip(spark, sf):
    """Texts exported as CSV and read again: line breaks, quotes and commas stay."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    sinks.to_csv(d, path := work_folder(spark, "csv"))
    return sinks.from_csv(spark, path, d.schema)


#: Headlines of orders: a level, a change with a level after it, a figure of the clause before, and one over a hundred.
HEADS = """SELECT o_orderkey AS id, CASE o_orderkey % 5
 WHEN 0 THEN 'Poll: ' || o_orderpriority || ' has ' || (o_orderkey % 101) || '% approval'
 WHEN 1 THEN o_orderpriority || ' fell ' || (o_orderkey % 101) || '% and keeps 40,5 % vote intention'
 WHEN 2 THEN 'Vote: 1-URGENT ' || (o_orderkey % 97) || '%, ' || o_orderpriority || ' ' || (o_orderkey % 89) || '%; prices up 300%'
 WHEN 3 THEN 'Image of ' || o_orderpriority || ' at ' || (o_orderkey % 130) || '% while the others of the long list of those who were asked stay far below at 12%'
 ELSE o_orderpriority || ': ' || (o_orderkey % 50) || '%' END AS title FROM orders"""
NAMES = [(p, p.lower()) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")] + [("specified", "specified")]
CUES = [("approval", "approv"), ("approval", "image"), ("vote", "vote"), ("vote", "intent"), ("inflation", "prices")]


def _values(rows, names):
    return f"SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) AS x({names})"


@query(f"WITH {poll_values.oracle(HEADS, _values(NAMES, 'subject, phrase'), _values(CUES, 'measure, stem'))} SELECT id, pos::INTEGER AS pos, subject, measure, value, confidence FROM found")
def poll_triples(spark, sf):
    """Poll values out of headlines: a subject, a measure and figures, some of them changes."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    n = lambda m: (k % m).cast("string")
    p = F.col("o_orderpriority")
    title = (
        F.when(k % 5 == 0, F.concat(F.lit("Poll: "), p, F.lit(" has "), n(101), F.lit("% approval")))
        .when(k % 5 == 1, F.concat(p, F.lit(" fell "), n(101), F.lit("% and keeps 40,5 % vote intention")))
        .when(k % 5 == 2, F.concat(F.lit("Vote: 1-URGENT "), n(97), F.lit("%, "), p, F.lit(" "), n(89), F.lit("%; prices up 300%")))
        .when(k % 5 == 3, F.concat(F.lit("Image of "), p, F.lit(" at "), n(130), F.lit("% while the others of the long list of those who were asked stay far below at 12%")))
        .otherwise(F.concat(p, F.lit(": "), n(50), F.lit("%")))
    )
    titles = o.select(k.alias("id"), title.alias("title"))
    # a few rows each, whose size Spark does not know
    names, cues = F.broadcast(spark.createDataFrame(NAMES, "subject string, phrase string")), F.broadcast(spark.createDataFrame(CUES, "measure string, stem string"))
    return poll_values.poll_values(titles, names, cues, 2)
