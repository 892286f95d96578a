"""Feeds, tables, sinks and poll headlines on small hand-written inputs."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.operators import poll_values
from tidewire.sources import feeds, sinks

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Site</title>
<item><title>First &amp; best</title><link>http://a.org/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0200</pubDate><description><![CDATA[<p>x</p>]]></description></item>
<item><title><![CDATA[Second <b>]]></title><link>http://a.org/2</link></item></channel></rss>"""
ATOM = """<feed><entry><title type="html">Third</title><link rel="self" href="http://a.org/s"/><link rel="alternate" href="http://a.org/3"/><updated>2024-03-05T08:00:00Z</updated></entry></feed>"""


def test_feed_entries(spark):
    f = spark.createDataFrame([(1, RSS), (2, ATOM), (3, "<html></html>"), (4, None), (5, "<rss><channel></channel></rss>")], "id int, xml string")
    e = feeds.feed_entries(f, "id", "xml")
    at = datetime.datetime(2024, 3, 5, 8)
    got = [(r.id, r.nth, r.title, r.link, r.summary) for r in e.orderBy("id", "nth").collect()]
    assert got == [(1, 1, "First & best", "http://a.org/1", "<p>x</p>"), (1, 2, "Second <b>", "http://a.org/2", None), (2, 1, "Third", "http://a.org/3", None)]
    published = [r.p for r in e.orderBy("id", "nth").selectExpr("cast(published as timestamp_ntz) AS p").collect()]
    assert published == [at, None, at]
    assert {r.id: (r.entries, r.status) for r in feeds.feed_status(f, e, "id", "xml").collect()} == {1: (2, "active"), 2: (1, "active"), 3: (0, "broken"), 4: (0, "missing"), 5: (0, "silent")}
    assert feeds.feed_entries(f, "id", "xml", 1).count() == 2
    assert feeds.feed_entries(f.limit(0), "id", "xml").count() == 0


def test_html_tables(spark):
    page = "<table class=x><tr><td>Title</td></tr><tr><TH>Name</TH><th>Bloc </th></tr><tr><td>Ann <i>Lee</i></td><td>A&amp;B</td></tr><tr><td>Bo</td></tr><tr><td> </td><td></td></tr></table><table><tr><td>other</td></tr></table>"
    p = spark.createDataFrame([(1, page), (2, None), (3, "no table")], "id int, html string")
    t = feeds.html_tables(p, "id", "html")
    assert [(r.table, r.line, r.cells) for r in t.orderBy("table", "line").collect()][:3] == [(1, 1, ["Title"]), (1, 2, ["Name", "Bloc"]), (1, 3, ["Ann Lee", "A&B"])]
    got = feeds.named_rows(t, {"bloc": ("bloc", "party"), "name": ("name",)}).orderBy("line").collect()
    assert [(r.name, r.bloc) for r in got] == [("Ann Lee", "A&B"), ("Bo", None)]
    assert [r.node for r in feeds.text_nodes(p, "id", "html").filter("id = 1").orderBy("nth").collect()][:4] == ["Title", "Name", "Bloc", "Ann"]


def test_source_query():
    assert feeds.source_query(["Ann Lee", "Bo"], ["a.org"], ["North Town"]) == '("Ann Lee" OR Bo) AND (site:a.org OR "North Town")'
    assert feeds.source_query([], ["a.org", "b.org"]) == "(site:a.org OR site:b.org)"


def test_publish(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    a = spark.createDataFrame([(1, "x", 5), (2, None, 5)], "id int, t string, at int")
    assert sinks.publish(a, path, ignore=("at",)) == sinks.Outcome("written", 2, 0)
    assert sinks.publish(a.selectExpr("id", "t", "at + 1 AS at"), path, ignore=("at",)).state == "same"
    assert sinks.publish(a.limit(1), path, ignore=("at",), least=0.8).state == "kept"
    assert spark.read.parquet(path).count() == 2
    assert sinks.publish(a.limit(1), path, ignore=("at",)) == sinks.Outcome("written", 1, 2)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]  # nothing is left beside it
    odd = spark.createDataFrame([(1, 'a "b", c\nd\\', "x"), (2, "", None), (3, None, " y ")], "id int, t string, u string")
    sinks.to_csv(odd, f"file://{tmp_path}/csv")
    assert sorted(map(repr, sinks.from_csv(spark, f"file://{tmp_path}/csv", odd.schema).collect())) == sorted(map(repr, odd.collect()))


def test_json_or(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "t": "x"},\n {"id": 2}]')
    (tmp_path / "b.json").write_text("[{oh")
    read = lambda n: [tuple(r) for r in feeds.json_or(spark, f"file://{tmp_path}/{n}.json", "id int, t string", [(0, "none")]).collect()]
    assert read("a") == [(1, "x"), (2, None)]
    assert read("b") == read("c") == [(0, "none")]


NAMES = [("lee", "ann lee"), ("park", "park"), ("parker", "jo park"), ("lake", "lake party")]
CUES = [("approval", "approv"), ("vote", "vote"), ("inflation", "prices")]


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Poll: Ann Lee has 45% approval", [("lee", "approval", 45.0, "high")]),
        ("Ann Lee fell 3% and keeps 40,5 % of the vote", [("lee", "vote", 40.5, "high")]),  # a change; a subject of another clause
        ("Vote: Ann Lee 31%, Park 29.5%", [("lee", "vote", 31.0, "medium"), ("park", "vote", 29.5, "medium")]),  # the headline's only measure
        ("Jo Park at 20%", [("parker", "unclassified", 20.0, "low")]),  # the longer name
        ("Approval of Ann Lee 50%; Park 40%", [("lee", "approval", 50.0, "high"), ("park", "approval", 40.0, "medium")]),  # from the clause before
        ("Prices rise 120% says Park", []),
        ("Turnout was 70%", []),
        ("Park 20% vote, 20% vote", [("park", "vote", 20.0, "high")]),
        ("", []),
        (None, []),
    ],
)
def test_poll_values(spark, title, want):
    n, c = spark.createDataFrame(NAMES, "subject string, phrase string"), spark.createDataFrame(CUES, "measure string, stem string")
    got = poll_values.poll_values(spark.createDataFrame([(1, title)], "id int, title string"), n, c, 2)
    assert [(r.subject, r.measure, r.value, r.confidence) for r in got.orderBy("pos").collect()] == want


def test_poll_values_read_titles_once(spark):
    """Random headlines against the SQL, repeated and null ones with them; words are dealt out by headline once, not for each join."""
    rng = random.Random(9)
    bits = ["Ann Lee", "Park", "Jo Park", "Lake Party", "fell", "and", "while", "vote", "approval,", "Prices:", "of", "the", "7 %", "45%", "45%,", "40,5%;", "101%", "x" * 9]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randrange(1, 25)))) for i in range(400)] + [(400, None), (401, ""), (402, "Park 3% vote"), (402, "Park 3% vote")]
    n, c = spark.createDataFrame(NAMES, "subject string, phrase string"), spark.createDataFrame(CUES, "measure string, stem string")
    got = poll_values.poll_values(spark.createDataFrame(rows, "id int, title string"), F.broadcast(n), F.broadcast(c), 2)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id int, title varchar)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    values = lambda xs, names: f"SELECT * FROM (VALUES {', '.join(map(str, xs))}) AS x({names})"
    want = con.sql(f"WITH {poll_values.oracle('SELECT * FROM t', values(NAMES, 'subject, phrase'), values(CUES, 'measure, stem'), 2)} SELECT id, pos, subject, measure, value, confidence FROM found").fetchall()
    assert len(want) > 400
    assert sorted(map(tuple, got.select("id", "pos", "subject", "measure", "value", "confidence").collect())) == sorted(want)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
