"""Collection, edges, contexts and boards: what stands between scans and the finished reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import geometry, text
from tidewire.operators import graphs, poll_values
from tidewire.plans.choices import AREAS, SIDES, _areas
from tidewire.plans.notes import json_leaves
from tidewire.plans.registry import query
from tidewire.plans.texts import NORM
from tidewire.session import table

TRADE = """t AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b, o_orderkey AS k, o_orderdate AS d FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
e AS (SELECT a, b, count(*) AS w, min(d) AS since, max(d) AS last FROM t GROUP BY 1, 2)"""


def _trade(spark, sf):
    li, s, o, c = (table(spark, sf, t) for t in ("lineitem", "supplier", "orders", "customer"))
    t = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    t = t.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d")).distinct()
    return t.groupBy("a", "b").agg(F.count("*").alias("w"), F.min("d").alias("since"), F.max("d").alias("last"))


@query(f"""WITH {TRADE} SELECT a, b, w, x.n_regionkey <> y.n_regionkey AS crosses, since >= (SELECT max(since) FROM e) - INTERVAL 3 DAYS AS fresh FROM e JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b""")
def territory_edges(spark, sf):
    """Links between territories, whether they cross a region's border and whether they are new."""
    e, n = _trade(spark, sf), table(spark, sf, "nation")
    x, y = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb"))
    newest = e.agg(F.max("since")).scalar()
    return e.join(x, "a").join(y, "b").select("a", "b", "w", (F.col("ra") != F.col("rb")).alias("crosses"), (F.col("since") >= newest - F.expr("INTERVAL 3 DAYS")).alias("fresh"))


@query(f"""WITH {TRADE} SELECT a, b, w, last FROM e WHERE last >= (SELECT max(last) FROM e) - INTERVAL 7 DAYS""")
def changed_edges(spark, sf):
    """The links that changed within a week of the last change, newest first."""
    e = _trade(spark, sf)
    newest = e.agg(F.max("last")).scalar()
    return e.filter(F.col("last") >= newest - F.expr("INTERVAL 7 DAYS")).orderBy(F.desc("last"), "a", "b").select("a", "b", "w", "last")


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS k, s_nationkey AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), p AS (SELECT DISTINCT l_partkey AS k, s_nationkey AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
r AS (SELECT x.v AS a, y.v AS b, 'orders' AS kind FROM o x JOIN o y ON x.k = y.k AND x.v < y.v UNION ALL SELECT x.v, y.v, 'parts' FROM p x JOIN p y ON x.k = y.k AND x.v < y.v),
s AS (SELECT a, b, count(*) FILTER (kind = 'orders') AS orders, count(*) FILTER (kind = 'parts') AS parts FROM r GROUP BY 1, 2) SELECT a, b, orders, parts, 2 * orders + parts AS weight, CASE WHEN 2 * orders >= parts THEN 'orders' ELSE 'parts' END AS kind FROM s""")
def source_network(spark, sf):
    """Links of several relations between sources, weighed together, and the relation that weighs most."""
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    x = li.join(s, li.l_suppkey == s.s_suppkey).select("l_orderkey", "l_partkey", F.col("s_nationkey").alias("v"))
    pairs = lambda key, kind: graphs.pairs_within(x, key, "v").select("a", "b", F.lit(kind).alias("kind"), "w")
    r = pairs("l_orderkey", "orders").unionByName(pairs("l_partkey", "parts"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("w"))), F.lit(0)).alias(kind)
    n = r.groupBy("a", "b").agg(total("orders"), total("parts"))
    return n.select("a", "b", "orders", "parts", (2 * F.col("orders") + F.col("parts")).alias("weight"), F.when(2 * F.col("orders") >= F.col("parts"), "orders").otherwise("parts").alias("kind"))


INITCAP = "array_to_string(list_transform(string_split(lower({x}), ' '), lambda v: upper(v[1]) || v[2:]), ' ')"


@query(f"""WITH t AS (SELECT p_partkey, p_size, 'They met ' || {INITCAP.format(x='p_type')} || ' with ' || {INITCAP.format(x='p_name')} || ' today' AS t FROM part),
c AS (SELECT p_partkey, unnest(regexp_extract_all(substr(t, 6), '[A-Z][a-z]+(?: [A-Z][a-z]+){{1,3}}')) AS name FROM t), known AS (SELECT DISTINCT {INITCAP.format(x='p_type')} AS name FROM part WHERE p_size < 10)
SELECT name, count(DISTINCT p_partkey) AS notes FROM c WHERE name NOT IN (SELECT name FROM known) AND NOT regexp_matches(name, '(^| )(Red|Blue)( |$)') GROUP BY name""")
def unknown_names(spark, sf):
    """Runs of two to four capitalised words inside sentences that no roster knows and no stop word spoils."""
    p = table(spark, sf, "part")
    kind = F.initcap(F.lower("p_type"))
    t = F.concat(F.lit("met "), kind, F.lit(" with "), F.initcap(F.lower("p_name")), F.lit(" today"))
    c = p.select("p_partkey", F.explode(F.regexp_extract_all(t, F.lit("([A-Z][a-z]+(?: [A-Z][a-z]+){1,3})"), F.lit(1))).alias("name")).filter(~F.col("name").rlike("(^| )(Red|Blue)( |$)"))
    known = p.filter("p_size < 10").select(kind.alias("name")).distinct()
    return c.join(known, "name", "left_anti").groupBy("name").agg(F.countDistinct("p_partkey").alias("notes"))


@query(f"""WITH n AS (SELECT DISTINCT array_to_string(string_split({NORM}, ' ')[1:2], ' ') AS name FROM benchmark WHERE len(string_split({NORM}, ' ')) > 1), l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
h AS (SELECT doc_id, line, {NORM} AS x FROM l), m AS (SELECT doc_id, name, line, substr(x, greatest(1, instr(' ' || x || ' ', ' ' || name || ' ') - 20), 60) AS context FROM h JOIN n ON contains(' ' || x || ' ', ' ' || name || ' ')),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY line) AS r FROM m), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, name) AS k FROM f WHERE r = 1) SELECT doc_id, name, line::INTEGER AS line, context FROM g WHERE k <= 40""")
def page_contexts(spark, sf):
    """The first line of a document that names each known person, with what stands around; at most forty persons a document."""
    w = F.split(text.norm(F.col("text")), " ")
    n = table(spark, sf, "benchmark").filter(F.size(w) > 1).select(F.array_join(F.slice(w, 1, 2), " ").alias("name")).distinct()
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("line"), text.norm(F.col("text")).alias("x"))
    v = F.col("w")
    two = F.array_distinct(F.transform(F.arrays_zip(v.alias("a"), F.slice(v, F.lit(2), F.size(v)).alias("b")), lambda z: F.concat_ws(" ", z["a"], z["b"])))
    m = lines.withColumn("w", F.split("x", " ")).select("doc_id", "line", "x", F.explode(two).alias("name")).join(n, "name")
    r = m.groupBy("doc_id", "name").agg(F.min(F.struct("line", "x")).alias("f")).select("doc_id", "name", "f.*")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "name"))
    at = F.expr("greatest(1, instr(concat(' ', x, ' '), concat(' ', name, ' ')) - 20)")
    return r.withColumn("k", k).filter("k <= 40").select("doc_id", "name", "line", F.substring(F.col("x"), at, F.lit(60)).alias("context"))


KINDS = (("notice", ("license", "copyright")), ("list", (" | ", "\t")), ("secret", ("token", "password")), ("prose", (" the ", " der ", " que ", " des ")))


@query(
    "SELECT kind, count(*) AS n, sum(kept)::BIGINT AS chars FROM (SELECT CASE "
    + " ".join("WHEN " + " OR ".join("contains(h, '{}')".format("' || chr(9) || '" if k == "\t" else k) for k in ks) + f" THEN '{n}'" for n, ks in KINDS)
    + " ELSE 'other' END AS kind, least(length(text), 6000) AS kept FROM (SELECT lower(substr(text, 1, 400)) AS h, text FROM documents WHERE NOT contains(lower(substr(text, 1, 800)), '@'))) GROUP BY kind"
)
def document_types(spark, sf):
    """A document's type by the first list whose word its first 400 characters hold; some sections are left out by their first 800."""
    d = table(spark, sf, "documents").filter(~F.lower(F.substring("text", 1, 800)).contains("@")).select(F.lower(F.substring("text", 1, 400)).alias("h"), F.least(F.length("text"), F.lit(6000)).alias("kept"))
    kind = F
    for n, ks in KINDS:
        hit = F.lit(False)
        for k in ks:
            hit = hit | F.col("h").contains(k)
        kind = kind.when(hit, n)
    return d.groupBy(kind.otherwise("other").alias("kind")).agg(F.count("*").alias("n"), F.sum("kept").cast("bigint").alias("chars"))


ASKED = "SELECT n_nationkey AS id, 'Compare ' || n_name || ' with Arabia, the united states and UNITED kingdom' AS title FROM nation"
PLACES = "SELECT n_name AS subject, lower(n_name) AS phrase FROM nation UNION ALL SELECT 'Arabia', 'arabia' UNION ALL SELECT 'United', 'united'"


@query(f"WITH {poll_values.oracle(ASKED, PLACES, 'SELECT NULL AS measure, NULL AS stem WHERE false', 2)} SELECT id, pos::INTEGER AS pos, subject FROM m")
def masked_names(spark, sf):
    """The names of a question, longest first: what a longer name covers is not read as a shorter one."""
    n = table(spark, sf, "nation")
    asked = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Compare "), "n_name", F.lit(" with Arabia, the united states and UNITED kingdom")).alias("title"))
    names = n.select(F.col("n_name").alias("subject"), F.lower("n_name").alias("phrase")).unionByName(spark.createDataFrame([("Arabia", "arabia"), ("United", "united")], "subject string, phrase string"))
    return poll_values.mentions(poll_values.words(asked, "id", "title"), names, 2).select("id", "pos", "subject")


@query("""WITH q AS (SELECT o_orderkey AS id, 1 AS ord, 'urgent' AS topic, NULL AS area FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 2, NULL, o_orderstatus FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT o_orderkey, 3, 'done', 'archive' FROM orders WHERE o_orderstatus = 'F')
SELECT id, arg_min(topic, ord) FILTER (topic IS NOT NULL) AS topic, arg_min(area, ord) FILTER (area IS NOT NULL) AS area, count(*) AS hits FROM q GROUP BY id""")
def tagged_union(spark, sf):
    """One table out of several questions: a row that comes again only adds the tags that it lacked."""
    o = table(spark, sf, "orders")
    q = lambda cond, k, topic, area: o.filter(cond).select(F.col("o_orderkey").alias("id"), F.lit(k).alias("ord"), topic.cast("string").alias("topic"), area.cast("string").alias("area"))
    u = q("o_orderpriority = '1-URGENT'", 1, F.lit("urgent"), F.lit(None)).unionByName(q("o_totalprice > 150000", 2, F.lit(None), F.col("o_orderstatus"))).unionByName(q("o_orderstatus = 'F'", 3, F.lit("done"), F.lit("archive")))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ord", c)))[c].alias(c)
    return u.groupBy("id").agg(first("topic"), first("area"), F.count("*").alias("hits"))


@query("SELECT o_custkey AS id, 'general' AS origin, count(*) AS notes FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'local', 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def local_append(spark, sf):
    """Rows of local feeds join the general table where it lacks them."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    general = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("notes")).select("id", F.lit("general").alias("origin"), "notes")
    new = c.select(F.col("c_custkey").alias("id")).join(general.select("id"), "id", "left_anti")
    return general.unionByName(new.select("id", F.lit("local").alias("origin"), F.lit(0).cast("long").alias("notes")))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(^| )(red|dim)( |$)') THEN 'excluded' WHEN regexp_matches(p_name, '^b[a-z]+ ') THEN 'pattern' WHEN regexp_matches(p_name, '(^| )(small|green|large)( |$)') THEN 'keyword' ELSE 'none' END AS how FROM part""")
def agenda_match(spark, sf):
    """A link is taken by its pattern, else by any keyword, unless it holds an excluded word."""
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", F.when(n.rlike("(^| )(red|dim)( |$)"), "excluded").when(n.rlike("^b[a-z]+ "), "pattern").when(n.rlike("(^| )(small|green|large)( |$)"), "keyword").otherwise("none").alias("how"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)'))::INTEGER AS years, (contains(lower(text), 'tion'))::INT + (contains(lower(text), 'ung'))::INT + (contains(lower(text), 'ment'))::INT AS terms,
 CASE WHEN contains(lower(text), 'tion') THEN substr(text, greatest(1, instr(lower(text), 'tion') - 30), 60) END AS excerpt FROM documents""")
def watched_documents(spark, sf):
    """How many years and watched terms a document holds, and what stands around the first of its main term."""
    low = F.lower("text")
    has = lambda w: low.contains(w).cast("int")
    excerpt = F.substring(F.col("text"), F.greatest(F.lit(1), F.instr(low, "tion") - 30), F.lit(60))
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)")).alias("years"), (has("tion") + has("ung") + has("ment")).alias("terms"), F.when(low.contains("tion"), excerpt).alias("excerpt"))


@query("""WITH n AS (SELECT max(o_orderdate)::DATE - 20 AS today FROM orders) SELECT o_orderkey, CASE WHEN o_orderdate::DATE >= today - 1 THEN 'upcoming' WHEN o_orderdate::DATE >= today - 3 THEN 'notice' ELSE 'past' END AS state, date_diff('day', today, o_orderdate::DATE) AS days FROM orders, n WHERE o_orderdate::DATE >= today - 10""")
def upcoming_sessions(spark, sf):
    """Sessions from yesterday on, and notices that are still valid."""
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    today = F.lit(o.agg(F.date_sub(F.max("d"), 20)).first()[0])
    o = o.filter(F.col("d") >= F.date_sub(today, 10))
    return o.select("o_orderkey", F.when(F.col("d") >= F.date_sub(today, 1), "upcoming").when(F.col("d") >= F.date_sub(today, 3), "notice").otherwise("past").alias("state"), F.datediff(F.col("d"), today).cast("long").alias("days"))


@query("""WITH s AS (SELECT o_custkey AS story, o_orderdate::DATE AS day, count(*) AS n, count(DISTINCT o_orderpriority) AS outlets FROM orders WHERE o_totalprice > 20000 GROUP BY 1, 2) SELECT story, day, n, outlets FROM s ORDER BY day DESC, outlets DESC, story LIMIT 450""")
def serving_stories(spark, sf):
    """The stories to serve: noise out, newest days first, then the most outlets; 450 of them."""
    s = table(spark, sf, "orders").filter("o_totalprice > 20000").groupBy(F.col("o_custkey").alias("story"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("outlets"))
    return s.orderBy(F.desc("day"), F.desc("outlets"), "story").limit(450)


@query("""WITH s AS (SELECT string_split(p_name, ' ')[-1] AS surname, count(*) AS people FROM part GROUP BY 1), p AS (SELECT DISTINCT unnest(string_split(lower(n_name), ' ')) AS place FROM nation UNION SELECT unnest(['green', 'small'])) SELECT surname, people FROM s WHERE surname NOT IN (SELECT place FROM p)""")
def place_guard(spark, sf):
    """Surnames that are also places are not read as persons."""
    s = table(spark, sf, "part").groupBy(F.element_at(F.split("p_name", " "), -1).alias("surname")).agg(F.count("*").alias("people"))
    p = table(spark, sf, "nation").select(F.explode(F.split(F.lower("n_name"), " ")).alias("surname")).unionByName(spark.createDataFrame([("green",), ("small",)], "surname string")).distinct()
    return s.join(p, "surname", "left_anti")


@query("""WITH c AS (SELECT c_mktsegment AS topic, c_custkey AS story, count(*) AS n, list_sort(list_distinct(list(o_orderpriority))) AS p FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, story) AS r FROM c)
SELECT topic, story, n, CASE WHEN len(p) <= 2 THEN array_to_string(p, ', ') ELSE array_to_string(p[1:2], ', ') || ' and ' || (len(p) - 2) || ' more' END AS outlets FROM r WHERE r <= 3""")
def short_edition(spark, sf):
    """Three stories a topic, each with two outlets and the number of the others."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    s = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("topic"), F.col("c_custkey").alias("story")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "story"))).filter("r <= 3")
    more = F.concat(F.array_join(F.slice("p", 1, 2), ", "), F.lit(" and "), (F.size("p") - 2).cast("string"), F.lit(" more"))
    return r.select("topic", "story", "n", F.when(F.size("p") <= 2, F.array_join("p", ", ")).otherwise(more).alias("outlets"))


@query("""WITH j AS (SELECT event_id, user_id, ts, round(value, 2) AS counted, max(round(value, 2)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WHERE ts >= TIMESTAMP '2024-01-03')
SELECT event_id, user_id, counted, counted - best AS gain FROM j WHERE best IS NULL OR counted > best""")
def result_passes(spark, sf):
    """Answers of a counting service that are taken: after the embargo, and only while the count rises; with what each adds."""
    e = table(spark, sf, "events").filter(F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz"))
    answer = F.from_json(F.concat(F.lit('{"state":{"counted":'), F.round("value", 2).cast("string"), F.lit("}}")), "state struct<counted: double>")
    e = e.select("event_id", "user_id", "ts", answer["state"]["counted"].alias("counted"))
    best = F.max("counted").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("best", best).filter("best IS NULL OR counted > best").select("event_id", "user_id", "counted", (F.col("counted") - F.col("best")).alias("gain"))


@query("""WITH j AS (SELECT event_id, ('{"id":' || event_id || ',"props":' || props || ',"tags":["' || event_type || '","' || user_id || '"],"ok":' || (value > 50)::VARCHAR || '}')::JSON AS j FROM events)
SELECT regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, CASE WHEN t.type = 'VARCHAR' AND NOT regexp_matches(atom ->> '$', '^-?[0-9]+$') THEN 'text' WHEN t.type = 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, count(*) AS n, count(DISTINCT event_id) AS rows
FROM j, json_tree(j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') GROUP BY 1, 2""")
def json_shapes(spark, sf):
    """What an unknown JSON service sends: its paths, kinds of values and how many rows have them."""
    e = table(spark, sf, "events")
    j = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"props":'), "props", F.lit(',"tags":["'), "event_type", F.lit('","'), F.col("user_id").cast("string"), F.lit('"],"ok":'), (F.col("value") > 50).cast("string"), F.lit("}"))
    leaves = json_leaves(e.select("event_id", j.alias("j")), "event_id", "j")
    v = F.col("value")
    kind = F.when(v.isin("true", "false"), "boolean").when(v.rlike(r"^-?[0-9]+$"), "number").otherwise("text")
    return leaves.groupBy(F.regexp_replace("path", r"\[[0-9]+\]", "[]").alias("path"), kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("rows"))


@query("""WITH h AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no name 30%' WHEN o_orderkey % 7 = 1 THEN 'customer rises' WHEN o_orderkey % 7 = 2 THEN 'customer at ' || o_orderkey || '%' ELSE 'customer at ' || (o_orderkey % 90) || '%' END AS t, o_orderpriority AS outlet FROM orders),
c AS (SELECT *, CASE WHEN NOT contains(t, 'customer') THEN 'no name' WHEN NOT contains(t, '%') THEN 'no figure' WHEN regexp_extract(t, '([0-9]+)%', 1)::BIGINT > 100 THEN 'over 100' ELSE 'taken' END AS state FROM h)
SELECT state, count(*) AS notes, count(DISTINCT t) AS titles, count(DISTINCT outlet) AS outlets FROM c GROUP BY state""")
def poll_intake(spark, sf):
    """Why headlines are not taken as polls, in the order of the tests, and how many titles and outlets the taken ones have."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    t = F.when(k % 7 == 0, "no name 30%").when(k % 7 == 1, "customer rises").when(k % 7 == 2, F.concat(F.lit("customer at "), k.cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("customer at "), (k % 90).cast("string"), F.lit("%")))
    h = o.select(t.alias("t"), F.col("o_orderpriority").alias("outlet"))
    state = F.when(~F.col("t").contains("customer"), "no name").when(~F.col("t").contains("%"), "no figure").when(F.regexp_extract("t", "([0-9]+)%", 1).try_cast("bigint") > 100, "over 100").otherwise("taken")
    return h.groupBy(state.alias("state")).agg(F.count("*").alias("notes"), F.countDistinct("t").alias("titles"), F.countDistinct("outlet").alias("outlets"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT event_type AS source, user_id, count(*) AS n, count(*) FILTER (ts > now - INTERVAL 14 DAYS) AS recent, max(ts) AS last FROM events, n GROUP BY 1, 2)
SELECT source, user_id, n, recent, last, CASE WHEN recent = 0 THEN 'silent' WHEN recent * 4 < n THEN 'few' ELSE 'active' END AS state FROM s""")
def source_status(spark, sf):
    """A row for each source: all rows, those of the last fourteen days, and its state."""
    e = table(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    s = e.groupBy(F.col("event_type").alias("source"), "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("ts") > now - F.expr("INTERVAL 14 DAYS")).alias("recent"), F.max("ts").alias("last"))
    return s.withColumn("state", F.when(F.col("recent") == 0, "silent").when(F.col("recent") * 4 < F.col("n"), "few").otherwise("active"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, round(value) ORDER BY ts DESC, event_id) AS k FROM events WHERE value > 10), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM f WHERE k = 1) SELECT user_id, event_id, event_type FROM g WHERE r <= 15""")
def refiltered_rows(spark, sf):
    """Stored rows judged by today's rule, one of each key, and the newest fifteen of each source."""
    e = table(spark, sf, "events").filter("value > 10").withColumn("v", F.expr("round(value)"))
    k = F.row_number().over(Window.partitionBy("user_id", "event_type", "v").orderBy(F.desc("ts"), "event_id"))
    f = e.withColumn("k", k).filter("k = 1")
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    return f.withColumn("r", r).filter("r <= 15").select("user_id", "event_id", "event_type")


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ')[-1] AS surname FROM part), k AS (SELECT surname, min(p_partkey) AS who, count(*) AS people FROM p GROUP BY 1), n AS (SELECT max(l_shipdate) AS now FROM lineitem),
m AS (SELECT surname, count(*) AS mentions, count(*) FILTER (l_shipdate > now - INTERVAL 30 DAYS) AS recent FROM lineitem JOIN p ON p_partkey = l_partkey, n GROUP BY surname) SELECT surname, CASE WHEN people = 1 THEN who END AS who, people > 1 AS ambiguous, mentions, recent FROM k JOIN m USING (surname)""")
def authority_mentions(spark, sf):
    """Mentions by last name: of all time and of thirty days; names of several people stay ambiguous."""
    p = table(spark, sf, "part").select("p_partkey", F.element_at(F.split("p_name", " "), -1).alias("surname"))
    li = table(spark, sf, "lineitem")
    now = F.lit(li.agg(F.max("l_shipdate")).first()[0]).cast("timestamp_ntz")
    k = p.groupBy("surname").agg(F.min("p_partkey").alias("who"), F.count("*").alias("people"))
    m = li.join(p, li.l_partkey == p.p_partkey).groupBy("surname").agg(F.count("*").alias("mentions"), F.count_if(F.col("l_shipdate") > now - F.expr("INTERVAL 30 DAYS")).alias("recent"))
    return k.join(m, "surname").select("surname", F.when(F.col("people") == 1, F.col("who")).alias("who"), (F.col("people") > 1).alias("ambiguous"), "mentions", "recent")


@query("""WITH i AS (SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS r FROM (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem)) WHERE r <= 10), e AS (SELECT x.v AS a, y.v AS b, count(*) AS w FROM i x JOIN i y ON x.k = y.k AND x.v < y.v GROUP BY 1, 2 HAVING count(*) >= 2),
u AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), d AS (SELECT a AS v, count(*) AS degree FROM u GROUP BY 1 ORDER BY degree DESC, v LIMIT 20), f AS (SELECT v FROM d ORDER BY degree DESC, v LIMIT 1) SELECT u.b AS v, u.w, u.b IN (SELECT v FROM d) AS central FROM u JOIN f ON u.a = f.v""")
def focus_network(spark, sf):
    """Whom the most linked entity is linked with, ten entities a note at most, and which of them are among the twenty most linked."""
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v")).distinct()
    i = i.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v"))).filter("r <= 10")
    u = graphs.undirected(graphs.pairs_within(i, "k", "v").filter("w >= 2"))
    d = u.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "v").limit(20)
    first = d.orderBy(F.desc("degree"), "v").limit(1).select(F.col("v").alias("a"))
    return u.join(first, "a").join(d.select(F.col("v").alias("b"), F.lit(True).alias("c")), "b", "left").select(F.col("b").alias("v"), "w", F.coalesce("c", F.lit(False)).alias("central"))


@query("""WITH o AS (SELECT o_orderstatus AS branch, o_orderpriority AS outlet, o_totalprice, date_trunc('week', o_orderdate)::DATE AS week FROM orders), w AS (SELECT branch, 'week' AS part, week::VARCHAR AS label, count(*) AS n FROM o GROUP BY branch, week QUALIFY row_number() OVER (PARTITION BY branch ORDER BY week DESC) <= 10),
t AS (SELECT branch, 'tone' AS part, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'even' ELSE 'low' END AS label, count(*) AS n FROM o GROUP BY 1, 3), s AS (SELECT branch, 'outlet' AS part, outlet AS label, count(*) AS n FROM o GROUP BY branch, outlet QUALIFY row_number() OVER (PARTITION BY branch ORDER BY count(*) DESC, outlet) <= 3)
SELECT * FROM w UNION ALL SELECT * FROM t UNION ALL SELECT * FROM s""")
def branch_block(spark, sf):
    """A branch's block: tone, its first outlets and its last ten weeks."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("branch"), F.col("o_orderpriority").alias("outlet"), "o_totalprice", F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"))
    tone = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 50000, "even").otherwise("low")
    part = lambda name, label: o.groupBy("branch", label.cast("string").alias("label")).agg(F.count("*").alias("n")).select("branch", F.lit(name).alias("part"), "label", "n")
    top = lambda df, k, *order: df.withColumn("r", F.row_number().over(Window.partitionBy("branch").orderBy(*order))).filter(F.col("r") <= k).drop("r")
    return top(part("week", F.col("week")), 10, F.desc("label")).unionByName(part("tone", tone)).unionByName(top(part("outlet", F.col("outlet")), 3, F.desc("n"), F.col("label")))


@query("""WITH o AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'el ' ELSE '' END || p_name AS name FROM part) SELECT p_partkey, regexp_replace(lower(name), '^(the|el|la|los) ', '') AS plain FROM o WHERE starts_with(regexp_replace(lower(name), '^(the|el|la|los) ', ''), 'sm')""")
def outlet_lookup(spark, sf):
    """Outlets whose name begins with what was asked for, articles aside."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "The ").when(k % 3 == 1, "el ").otherwise(""), "p_name")
    o = table(spark, sf, "part").select(k, F.regexp_replace(F.lower(name), "^(the|el|la|los) ", "").alias("plain"))
    return o.filter(F.col("plain").startswith("sm"))


@query("""SELECT c_custkey AS id, c_mktsegment AS list, round(c_acctbal, 1) AS votes, 'first' AS kind FROM customer WHERE c_nationkey < 8 UNION ALL SELECT c_custkey, c_mktsegment, round(c_acctbal, 1), 'second' FROM customer WHERE c_nationkey BETWEEN 8 AND 15 UNION ALL SELECT c_custkey, c_mktsegment, round(c_acctbal, 1), 'third' FROM customer WHERE c_nationkey > 15""")
def feed_adapters(spark, sf):
    """Three JSON forms of the same result, each read by the adapter registered for it."""
    c = table(spark, sf, "customer").withColumn("v", F.round("c_acctbal", 1))
    forms = {
        "first": (c.filter("c_nationkey < 8"), F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("list"), F.col("v").alias("votes")).alias("result")))),
        "second": (c.filter("c_nationkey BETWEEN 8 AND 15"), F.to_json(F.struct(F.array(F.struct(F.col("c_custkey").cast("string").alias("code"), F.col("c_mktsegment").alias("name"), F.col("v").alias("n"))).alias("rows")))),
        "third": (c.filter("c_nationkey > 15"), F.to_json(F.struct(F.col("c_custkey").alias("id"), F.create_map("c_mktsegment", F.col("v").cast("string")).alias("by")))),
    }
    out = None
    for kind, (rows, body) in forms.items():
        part = ADAPTERS[kind](rows.select(body.alias("body"))).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def _nested(df):
    x = df.select(F.from_json("body", "id long, result struct<list: string, votes: double>").alias("x"))
    return x.select("x.id", "x.result.list", "x.result.votes")


def _listed(df):
    x = df.select(F.explode(F.from_json("body", "rows array<struct<code: string, name: string, n: double>>")["rows"]).alias("x"))
    return x.select(F.col("x.code").try_cast("long").alias("id"), F.col("x.name").alias("list"), F.col("x.n").alias("votes"))


def _mapped(df):
    x = df.select(F.from_json("body", "id long, by map<string,string>").alias("x"))
    return x.select("x.id", F.explode("x.by").alias("list", "v")).select("id", "list", F.col("v").try_cast("double").alias("votes"))


#: Readers of the forms that a result can come in.
ADAPTERS = {"first": _nested, "second": _listed, "third": _mapped}


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN value > 20 THEN ts END AS own FROM events), f AS (SELECT event_id, own, lead(own) OVER w AS a, lead(own, 2) OVER w AS b, lead(own, 3) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(own, a, b, c) AS day, CASE WHEN own IS NOT NULL THEN 0 WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 END AS attempts FROM f""")
def backfilled_dates(spark, sf):
    """Missing dates filled from the next rows of the same person, in three attempts at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = F.when(F.col("value") > 20, F.col("ts"))
    e = table(spark, sf, "events").withColumn("own", own)
    tries = [F.col("own"), *(F.lead("own", k).over(w) for k in (1, 2, 3))]
    e = e.select("event_id", *(t.alias(f"t{k}") for k, t in enumerate(tries)))
    attempts = F
    for k in range(4):
        attempts = attempts.when(F.col(f"t{k}").isNotNull(), k)
    return e.select("event_id", F.coalesce("t0", "t1", "t2", "t3").alias("day"), attempts.alias("attempts"))


@query(f"""WITH s(area, ax, ay, bx, b_y) AS (VALUES {SIDES}), m AS (SELECT area, (min(ay) + max(ay))::DOUBLE / 2 AS y FROM s GROUP BY area), c AS (SELECT s.area, y, ((bx - ax) * (y - ay) / (b_y - ay) + ax)::DOUBLE AS x FROM s JOIN m USING (area) WHERE (ay > y) <> (b_y > y)),
r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY x) AS k FROM c), p AS (SELECT a.area, a.y, a.x AS x0, b.x AS x1 FROM r a JOIN r b ON a.area = b.area AND b.k = a.k + 1 AND a.k % 2 = 1) SELECT area, round(arg_max((x0 + x1) / 2, x1 - x0), 4) AS x, round(any_value(y), 4) AS y FROM p GROUP BY area""")
def label_points(spark, sf):
    """A point for each area's label: the middle of the longest stretch of the area at half its height, so never outside."""
    return _areas(spark).select("area", geometry.label_point(F.col("ring")).alias("p")).select("area", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query(f"""WITH s(area, ax, ay, bx, b_y) AS (VALUES {SIDES}), p AS (SELECT c_custkey AS id, (c_custkey * 37 % 1000) / 100.0::DOUBLE AS x, (c_custkey * 91 % 1000) / 100.0::DOUBLE AS y FROM customer),
t AS (SELECT id, area, x, y, ax::DOUBLE AS ax, ay::DOUBLE AS ay, (bx - ax)::DOUBLE AS dx, (b_y - ay)::DOUBLE AS dy, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))))::DOUBLE AS t FROM p, s)
SELECT id, area, round(min(sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)), 6) AS distance FROM t GROUP BY id, area""")
def border_distances(spark, sf):
    """How far each point is from each area's border."""
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 1000 / 100.0).alias("x"), (k * 91 % 1000 / 100.0).alias("y"))
    rings = F.array(*(F.struct(F.lit(n).alias("area"), F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in r)).alias("ring")) for n, r in AREAS.items()))
    far = F.transform(rings, lambda a: F.struct(a["area"].alias("area"), F.round(geometry.border_distance(a["ring"], F.col("x"), F.col("y")), 6).alias("distance")))
    return p.select("id", F.explode(far).alias("f")).select("id", "f.*")
