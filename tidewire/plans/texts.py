"""Text queries: folding, keys, extraction of links, numbers and quotes, frequent terms."""

from pyspark.sql import functions as F

from tidewire.functions import dates, text
from tidewire.plans.registry import query
from tidewire.session import table

FOLD = f"translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}')"
NORM = f"trim(regexp_replace({FOLD}, '[^a-z0-9]+', ' ', 'g'))"
STOPS = ", ".join(f"'{w}'" for w in text.STOP)


@query(f"SELECT doc_id, {FOLD} AS folded, regexp_replace({FOLD}, '[^\\x00-\\x7F]', '', 'g') AS ascii, {NORM} AS words FROM documents")
def fold_titles(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.fold(t).alias("folded"), text.fold_ascii(t).alias("ascii"), text.norm(t).alias("words"))


@query(f"SELECT key, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT source) AS outlets FROM (SELECT doc_id, source, sha256({NORM}) AS key FROM (SELECT doc_id, source, regexp_replace(text, ' - [^-]*$', '') AS text FROM documents)) GROUP BY key")
def title_key(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2(text.title_key(F.col("text")), 256).alias("key"))
    return d.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.countDistinct("source").alias("outlets"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS id, sha256(source || '|' || lang) AS pair FROM documents")
def stable_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.stable_id(F.col("text")).alias("id"), F.sha2(F.concat("source", F.lit("|"), "lang"), 256).alias("pair"))


@query("""SELECT doc_id, regexp_extract(text, '[“"]([^”"]{10,220})[”"]', 1) AS quote FROM documents WHERE regexp_matches(text, '[“"]([^”"]{10,220})[”"]')""")
def quotes(spark, sf):
    p = '[“"]([^”"]{10,220})[”"]'
    return table(spark, sf, "documents").filter(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 1).alias("quote"))


@query("""SELECT doc_id, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i)[1:3], ',') AS numbers FROM (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[0-9]+(?:[.,][0-9]+)? ?(?:%|[a-z]+)?'), lambda x: trim(x)) AS n FROM documents)""")
def numbers(spark, sf):
    """The first three distinct numbers of a text, each with its unit."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("([0-9]+(?:[.,][0-9]+)? ?(?:%|[a-z]+)?)"), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(F.transform(found, lambda x: F.trim(x))), 1, 3), ",").alias("numbers"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("""SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""")
def html_links(spark, sf):
    d = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return d.groupBy("href").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("""SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]* lang="([a-z]+)"', 1) AS lang, regexp_matches(html, 'rel="alternate"') AS feed FROM pages""")
def page_head(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(h, "(?i)<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '(?i)<html[^>]* lang="([a-z]+)"', 1).alias("lang"), h.contains('rel="alternate"').alias("feed"))


@query("""SELECT page_id, coalesce(try_strptime(nullif(regexp_extract(url || '/2024/03/' || (1 + page_id % 28) || '/', '/(20[0-9]{2}/[01]?[0-9]/[0-3]?[0-9])(/|$)', 1), ''), '%Y/%-m/%-d')::DATE, NULL) AS day FROM pages""")
def url_dates(spark, sf):
    made = F.concat("url", F.lit("/2024/03/"), (1 + F.col("page_id") % 28).cast("string"), F.lit("/"))
    return table(spark, sf, "pages").select("page_id", dates.url_date(made).alias("day"))


@query("""SELECT host, count(*) AS pages, count(DISTINCT lang) AS langs FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '/(en|fr|es|de)/', 1) AS lang FROM pages) GROUP BY host""")
def page_hosts(spark, sf):
    d = table(spark, sf, "pages").select(F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("url", "/(en|fr|es|de)/", 1).alias("lang"))
    return d.groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct("lang").alias("langs"))


@query(f"SELECT term, count(*) AS df, count(DISTINCT source) AS outlets FROM (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all({FOLD}, '[a-z]{{4,}}')) AS term FROM documents) WHERE term NOT IN ({STOPS}) GROUP BY term HAVING count(*) > 1 ORDER BY df DESC, term LIMIT 50")
def trending_terms(spark, sf):
    d = text.each(table(spark, sf, "documents"), text.tokens(F.col("text")), "term", "source")
    return d.groupBy("term").agg(F.count("*").alias("df"), F.countDistinct("source").alias("outlets")).filter("df > 1").orderBy(F.desc("df"), "term").limit(50)


@query(f"SELECT stem, count(*) AS n FROM (SELECT unnest(list_transform(list_distinct(regexp_extract_all({FOLD}, '[a-z]{{4,}}')), lambda w: CASE WHEN length(w) >= 7 THEN substr(w, 1, 6) ELSE w END)) AS stem, doc_id FROM documents) GROUP BY stem")
def stems(spark, sf):
    d = text.each(table(spark, sf, "documents"), text.stems(text.tokens(F.col("text"), stop=("",))), "stem")
    return d.groupBy("stem").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT doc_id, source, string_split({NORM}, ' ') AS w FROM documents), g AS (SELECT DISTINCT doc_id, source, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t))
SELECT gram, count(*) AS uses, count(DISTINCT source) AS outlets FROM g GROUP BY gram HAVING count(*) >= 4 AND count(DISTINCT source) >= 3""")
def bigrams(spark, sf):
    d = table(spark, sf, "documents").select("source", F.split(text.norm(F.col("text")), " ").alias("w"))
    pairs = F.array_distinct(F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1))))
    return text.each(d, pairs, "gram", "source").groupBy("gram").agg(F.count("*").alias("uses"), F.countDistinct("source").alias("outlets")).filter("uses >= 4 AND outlets >= 3")


@query("SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_extract(substr(text, 1, 59), '(?s)^(.*) ', 1) || '…' END AS short FROM documents")
def shorten(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.shorten(F.col("text"), 60).alias("short"))


@query("SELECT item_id, instr(text, ' ') AS at, substr(text, greatest(1, instr(text, ' ') - 50), 100) AS context FROM benchmark")
def context_window(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.instr("text", " ").cast("long").alias("at"), F.expr("substring(text, greatest(1, instr(text, ' ') - 50), 100)").alias("context"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS slug, list_reverse(string_split(p_name, ' '))[1] AS last_name, len(string_split(p_name, ' '))::INTEGER AS words FROM part")
def name_parts(spark, sf):
    w = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug"), F.element_at(w, -1).alias("last_name"), F.size(w).alias("words"))
