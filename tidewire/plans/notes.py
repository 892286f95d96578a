"""Names, dates, classes and selections of notes: what a collector reads out of a text and what it keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import dates, text
from tidewire.plans.registry import query
from tidewire.plans.texts import FOLD, NORM
from tidewire.session import table

SPACES = "[ \\t\\n\\r]+"


def word_pairs(x: Column) -> Column:
    """Each word of a text after the first, with the one before it: the list of words beside itself, so each is read once."""
    w = F.split(F.trim(x), SPACES)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.arrays_zip(F.slice(w, F.lit(1), n).alias("before"), F.slice(w, F.lit(2), n).alias("word"))


@query(rf"""WITH w AS (SELECT doc_id, string_split_regex(trim(text), '{SPACES}') AS w FROM documents), p AS (SELECT doc_id, w[i] AS word, w[i - 1] AS before FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM w))
SELECT noun, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, regexp_extract(word, '^[A-Z][a-z]+') AS noun FROM p WHERE regexp_matches(word, '^[A-Z][a-z]+') AND NOT regexp_matches(before, '[.!?:]$')) GROUP BY noun""")
def proper_nouns(spark, sf):
    """Capitalised words that do not begin a sentence."""
    p = table(spark, sf, "documents").select("doc_id", F.explode(word_pairs(F.col("text"))).alias("p"))
    p = p.filter(F.col("p.word").rlike("^[A-Z][a-z]+") & ~F.col("p.before").rlike("[.!?:]$"))
    return p.groupBy(F.regexp_extract("p.word", "^[A-Z][a-z]+", 0).alias("noun")).agg(F.count("*").alias("uses"), F.countDistinct("doc_id").alias("docs"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^(www|m|blog|shop|amp)\.', ''), '(\.example)?\.(com|org|net)$', '') AS h FROM pages)
SELECT upper(substr(h, 1, 1)) || substr(h, 2) AS outlet, count(*) AS pages, min(page_id) AS first_page FROM h WHERE h <> '' GROUP BY 1""")
def canonical_outlets(spark, sf):
    """Variants of an outlet's address merged under one name: no www or section host, no domain ending, a capital first."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)), r"^(www|m|blog|shop|amp)\.", ""), r"(\.example)?\.(com|org|net)$", "")
    p = table(spark, sf, "pages").select("page_id", h.alias("h")).filter("h <> ''")
    return p.groupBy(F.concat(F.upper(F.substring("h", 1, 1)), F.expr("substr(h, 2)")).alias("outlet")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query(rf"SELECT doc_id, regexp_replace(substr(replace({NORM}, ' ', '-'), 1, 60), '-+$', '') AS slug FROM documents")
def slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.substring(F.replace(text.norm(F.col("text")), F.lit(" "), F.lit("-")), 1, 60), "-+$", "").alias("slug"))


MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def long_date(x: Column) -> Column:
    """The first date of the form "5 de marzo de 2024" (or "del") in a text; null where there is none or no such day."""
    p = rf"(?i)\b([0-9]{{1,2}}) de ({'|'.join(MONTHS)}) del? ([0-9]{{4}})\b"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(x, p, 2)))
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(x, p, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(x, p, 1), 2, "0")), F.lit("yyyy-MM-dd")))


M_LIST = ", ".join(f"'{m}'" for m in MONTHS)


@query(f"""WITH t AS (SELECT o_orderkey, 'Salta, ' || CASE WHEN o_orderkey % 9 = 0 THEN 31 ELSE day(o_orderdate) END || ' de ' || upper(([{M_LIST}])[month(o_orderdate)]) || CASE WHEN o_orderkey % 2 = 0 THEN ' de ' ELSE ' del ' END || year(o_orderdate) || '. Y el 1 de enero de 1999.' AS t, o_orderdate AS d FROM orders)
SELECT o_orderkey, try_strptime(year(d) || '-' || month(d) || '-' || CASE WHEN o_orderkey % 9 = 0 THEN 31 ELSE day(d) END, '%Y-%-m-%-d')::DATE AS said FROM t""")
def long_dates(spark, sf):
    """Dates written out in Spanish; days that a month does not have are none."""
    d = F.col("o_orderdate")
    day = F.when(F.col("o_orderkey") % 9 == 0, 31).otherwise(F.day(d)).cast("string")
    said = F.concat(F.lit("Salta, "), day, F.lit(" de "), F.upper(F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))), F.when(F.col("o_orderkey") % 2 == 0, " de ").otherwise(" del "), F.year(d).cast("string"), F.lit(". Y el 1 de enero de 1999."))
    return table(spark, sf, "orders").select("o_orderkey", long_date(said).alias("said"))


#: Where a page tells its day, in the order in which it is believed.
PAGE_DATES = (
    ("meta", r'<meta[^>]*property="article:published_time"[^>]*content="([^"]+)"'),
    ("data", r'"datePublished" *: *"([^"]+)"'),
    ("time", r'<time[^>]*datetime="([^"]+)"'),
)


def local_day(x: Column) -> Column:
    """The day of an ISO time at UTC-3: a plain date is itself, a time without a zone is UTC."""
    when = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(x, "Z$", "+00:00"), "^([0-9-]+T[0-9:]+)$", "$1+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return F.when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.to_date(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")))).otherwise(F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(when, F.current_timezone()), "-03:00")))


def _dated_pages(spark, sf):
    k = F.col("page_id")
    day = F.concat(F.lit("2024-03-"), F.lpad((1 + k % 28).cast("string"), 2, "0"))
    mark = (
        F.when(k % 5 == 0, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T01:30:00Z"><time datetime="2020-01-01">')))
        .when(k % 5 == 1, F.concat(F.lit('<script type="application/ld+json">{"datePublished": "'), day, F.lit('T23:30:00-03:00"}</script>')))
        .when(k % 5 == 2, F.concat(F.lit('<time class="x" datetime="'), day, F.lit('">')))
        .when(k % 5 == 3, F.lit('<time datetime="soon">'))
        .otherwise(F.lit(""))
    )
    url = F.when(k % 10 == 4, F.concat("url", F.lit("/"), F.replace(day, F.lit("-"), F.lit("/")), F.lit("/"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select(k, F.concat(mark, "html").alias("html"), url.alias("url"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN DATE '2024-03-01' + (page_id % 28)::INT - 1 WHEN 1 THEN DATE '2024-03-01' + (page_id % 28)::INT WHEN 2 THEN DATE '2024-03-01' + (page_id % 28)::INT
 ELSE CASE WHEN page_id % 10 = 4 THEN DATE '2024-03-01' + (page_id % 28)::INT ELSE DATE '2024-04-01' END END AS day,
 CASE page_id % 5 WHEN 0 THEN 'meta' WHEN 1 THEN 'data' WHEN 2 THEN 'time' ELSE CASE WHEN page_id % 10 = 4 THEN 'url' ELSE 'collected' END END AS origin FROM pages""")
def page_days(spark, sf):
    """A page's local day and where it is from: its address, then its marks in turn, else the day of collection."""
    found = [("url", F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract("url", "/(20[0-9]{2}/[0-9]{2}/[0-9]{2})/", 1), F.lit("")), F.lit("yyyy/MM/dd"))))]
    found += [(name, local_day(F.nullif(F.regexp_extract("html", p, 1), F.lit("")))) for name, p in PAGE_DATES]
    found.append(("collected", F.lit("2024-04-01").cast("date")))
    first = F.element_at(F.filter(F.array(*(F.struct(d.alias("day"), F.lit(n).alias("origin")) for n, d in found)), lambda x: x["day"].isNotNull()), 1)
    return _dated_pages(spark, sf).select("page_id", first.alias("f")).select("page_id", "f.*")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) WHEN 1 THEN 'H' || CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END || ' ' || year(o_orderdate)
 WHEN 2 THEN strftime(o_orderdate, '%Y-%m') ELSE year(o_orderdate)::VARCHAR END AS period FROM orders""")
def period_labels(spark, sf):
    """The label of a period by its ISO frequency: quarter, half, month or year."""
    d, every = F.col("o_orderdate"), F.element_at(F.array(*map(F.lit, ("P3M", "P6M", "P1M", "P1Y"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    y = F.year(d).cast("string")
    label = F.when(every == "P3M", F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), y)).when(every == "P6M", F.concat(F.lit("H"), F.when(F.month(d) <= 6, "1").otherwise("2"), F.lit(" "), y)).when(every == "P1M", F.date_format(d, "yyyy-MM")).otherwise(y)
    return table(spark, sf, "orders").select("o_orderkey", label.alias("period"))


def strict_int(x: Column) -> Column:
    """A whole number without signs of anything else: no blanks, points or exponents; null beyond 64 bits."""
    return F.when(x.rlike(r"^-?[0-9]+$"), x.try_cast("bigint"))


def strict_float(x: Column) -> Column:
    """A finite decimal number with a point or a comma."""
    return F.when(x.rlike(r"^-?[0-9]+([.,][0-9]+)?$"), F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_id || ',5' WHEN 2 THEN ' ' || event_id WHEN 3 THEN event_id || '.25' WHEN 4 THEN '9999999999999999999999' ELSE 'nan' END AS s FROM events)
SELECT event_id, CASE WHEN regexp_matches(s, '^-?[0-9]+$') THEN try_cast(s AS BIGINT) END AS whole, CASE WHEN regexp_matches(s, '^-?[0-9]+([.,][0-9]+)?$') THEN try_cast(replace(s, ',', '.') AS DOUBLE) END AS number FROM s""")
def strict_numbers(spark, sf):
    k = F.col("event_id")
    t = k.cast("string")
    s = F.when(k % 6 == 0, t).when(k % 6 == 1, F.concat(t, F.lit(",5"))).when(k % 6 == 2, F.concat(F.lit(" "), t)).when(k % 6 == 3, F.concat(t, F.lit(".25"))).when(k % 6 == 4, "9999999999999999999999").otherwise("nan")
    return table(spark, sf, "events").select("event_id", strict_int(s).alias("whole"), strict_float(s).alias("number"))


@query(f"""SELECT doc_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i)[1:6], ' ') AS keywords FROM (SELECT doc_id, regexp_extract_all({FOLD}, '[a-z0-9]{{3,}}') AS k FROM documents)""")
def keyword_lists(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate - INTERVAL 3 HOURS WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate + INTERVAL 3 HOURS END AS published FROM orders")
def published_times(spark, sf):
    """Times written as in mails or in ISO form, in UTC; what is neither is none."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    said = F.when(k % 4 == 0, F.concat(F.date_format(d, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0300"))).when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k % 4 == 2, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:00"))).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", dates.published(said).cast("timestamp_ntz").alias("published"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN make_date(year(o_orderdate), month(o_orderdate), 15) WHEN 2 THEN make_date(year(o_orderdate), 7, 1) END AS day FROM orders")
def mixed_dates(spark, sf):
    """Dates told by day, month or year as one day."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    said = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "yyyy-MM")).when(k % 4 == 2, F.date_format(d, "yyyy")).otherwise("n/a")
    return table(spark, sf, "orders").select("o_orderkey", dates.mid_period(said).alias("day"))


def json_leaves(rows: DataFrame, id_col: str, json_col: str, deepest: int = 16) -> DataFrame:
    """id, path and value of every leaf of a JSON value, level by level: a level opens the objects and arrays that the one above left.

    Leaves are told as text; nulls and empty objects and arrays have none. Values below `deepest` levels raise an error.
    """
    open_ = rows.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.col(json_col).alias("value"))
    done = None
    for _ in range(deepest):
        kind = F.substring(F.ltrim("value"), 1, 1)
        leaf = open_.filter(~kind.isin("{", "[") & F.col("value").isNotNull())
        done = leaf if done is None else done.unionByName(leaf)
        inner = open_.filter(kind.isin("{", "["))
        if inner.isEmpty():
            return done
        fields = inner.filter(kind == "{").select("id", "path", F.explode(F.from_json("value", "map<string,string>")).alias("k", "v")).select("id", F.concat("path", F.lit("."), "k").alias("path"), F.col("v").alias("value"))
        items = inner.filter(kind == "[").select("id", "path", F.posexplode(F.from_json("value", "array<string>")).alias("k", "v")).select("id", F.concat("path", F.lit("["), F.col("k").cast("string"), F.lit("]")).alias("path"), F.col("v").alias("value"))
        open_ = fields.unionByName(items)
    raise ValueError(f"JSON of more than {deepest} levels")


@query("""WITH j AS (SELECT event_id, ('{"id":' || event_id || ',"in":{"props":' || props || ',"tags":["' || event_type || '",{"u":' || user_id || '}]},"none":null}')::JSON AS j FROM events)
SELECT event_id AS id, fullkey AS path, atom ->> '$' AS value FROM j, json_tree(j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')""")
def json_leaf_walk(spark, sf):
    e = table(spark, sf, "events")
    j = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"in":{"props":'), "props", F.lit(',"tags":["'), "event_type", F.lit('",{"u":'), F.col("user_id").cast("string"), F.lit('}]},"none":null}'))
    return json_leaves(e.select("event_id", j.alias("j")), "event_id", "j")


@query("""WITH f AS (SELECT event_type, user_id, min(ts) AS t, min(event_id) FILTER (true) AS e FROM events GROUP BY 1, 2), r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY t, user_id) AS r FROM f)
SELECT event_type, count(*) AS known, string_agg(user_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS examples FROM r GROUP BY event_type""")
def capped_examples(spark, sf):
    """How many distinct people each kind has, and the first three: distinct ones are found before any list is made."""
    f = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.min("ts").alias("t"))
    r = f.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("t", "user_id")))
    three = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "user_id")))), lambda x: x["user_id"].cast("string"))
    return r.groupBy("event_type").agg(F.count("*").alias("known"), F.array_join(three, ",").alias("examples"))


@query("""WITH c AS (SELECT user_id, count(*) AS n, min(ts) AS since, max(ts) AS last, list(event_id ORDER BY event_id)[1:3] AS x FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1 UNION ALL SELECT user_id, count(*), min(ts), max(ts), list(event_id ORDER BY event_id)[1:3] FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT user_id, sum(n)::BIGINT AS n, min(since) AS since, max(last) AS last, array_to_string(list_sort(list_distinct(flatten(list(x))))[1:3], ',') AS examples FROM c GROUP BY user_id""")
def merged_counters(spark, sf):
    """Counters of an old and a new period merged: numbers add up, ends widen, examples unite and stay three."""
    e = table(spark, sf, "events")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    few = F.slice(F.array_sort(F.collect_list("event_id")), 1, 3)
    part = lambda x: x.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("since"), F.max("ts").alias("last"), few.alias("x"))
    c = part(e.filter(F.col("ts") < cut)).unionByName(part(e.filter(F.col("ts") >= cut)))
    every = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("x")))), 1, 3)
    return c.groupBy("user_id").agg(F.sum("n").alias("n"), F.min("since").alias("since"), F.max("last").alias("last"), F.array_join(every, ",").alias("examples"))


#: Words of a dictionary of outlets, places and markets.
LOCAL = ("src1", "src3")
DOMESTIC, FOREIGN = "(que|los|ción)", "(the|and|der|und)"


@query("""WITH d AS (SELECT doc_id, source, text, contains(source, 'src1') OR contains(source, 'src3') AS listed, regexp_matches(text, '(?i)(^|[^a-z])(salta|norte|des)([^a-z]|$)') AS placed FROM documents)
SELECT doc_id, CASE WHEN listed THEN 'listed' WHEN placed THEN 'placed' ELSE 'other' END AS local FROM d""")
def local_notes(spark, sf):
    """A note is local by its outlet (the dictionary's words are parts of names), or else by a place that it names."""
    listed = F.lit(False)
    for w in LOCAL:
        listed = listed | F.col("source").contains(w)
    placed = F.col("text").rlike("(?i)(^|[^a-z])(salta|norte|des)([^a-z]|$)")
    return table(spark, sf, "documents").select("doc_id", F.when(listed, "listed").when(placed, "placed").otherwise("other").alias("local"))


@query(r"""SELECT source, count(*) FILTER (f AND NOT d) AS foreign_only, count(*) FILTER (d) AS domestic FROM (SELECT source, regexp_matches(lower(text), '(^|[^a-z])(the|and|der|und)([^a-z]|$)') AS f, regexp_matches(lower(text), '(^|[^a-z])(que|los)([^a-z]|$)') AS d FROM documents) GROUP BY source""")
def foreign_only(spark, sf):
    """Notes that name foreign matters and no domestic ones."""
    low = F.lower("text")
    d = table(spark, sf, "documents").select("source", low.rlike("(^|[^a-z])(the|and|der|und)([^a-z]|$)").alias("f"), low.rlike("(^|[^a-z])(que|los)([^a-z]|$)").alias("d"))
    return d.groupBy("source").agg(F.count_if(F.col("f") & ~F.col("d")).alias("foreign_only"), F.count_if("d").alias("domestic"))


@query(r"""SELECT doc_id, n::INTEGER AS hits FROM (SELECT doc_id, lang, len(regexp_extract_all(lower(text), '(tion|ment|ción|ung)s?[ ,.]')) AS n, regexp_matches(text, '[$€]|[0-9]%') AS market FROM documents) WHERE n >= 2 AND lang IN ('es', 'fr') OR market AND lang NOT IN ('es', 'fr')""")
def finance_notes(spark, sf):
    """Two finance words or more; notes from abroad need a market sign."""
    home = F.col("lang").isin("es", "fr")
    d = table(spark, sf, "documents").select("doc_id", home.alias("home"), F.regexp_count(F.lower("text"), F.lit("(tion|ment|ción|ung)s?[ ,.]")).alias("hits"), F.col("text").rlike("[$€]|[0-9]%").alias("market"))
    return d.filter((F.col("home") & (F.col("hits") >= 2)) | (~F.col("home") & F.col("market"))).select("doc_id", "hits")


#: Ordered rules of a cascade: the first that fits decides. Acronyms are read with their capitals, all else without.
CASCADE = (("veto", "(?i)password|token"), ("official", "AKIA[A-Z0-9]+"), ("veto", "(?i)[a-z0-9.]+@[a-z0-9]+"), ("news", "(?i)(^|[^a-z])(vote|the|des|que)([^a-z]|$)"), ("notice", "[0-9]{4}"))


@query("SELECT level, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in CASCADE) + " ELSE 'none' END AS level FROM documents) GROUP BY level")
def cascade_level(spark, sf):
    """Vetoes and acceptances in turn, some of them with capitals that count."""
    (k, p), *rest = CASCADE
    level = F.when(F.col("text").rlike(p), k)
    for k, p in rest:
        level = level.when(F.col("text").rlike(p), k)
    return table(spark, sf, "documents").select("doc_id", level.otherwise("none").alias("level")).groupBy("level").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH s AS (SELECT o_custkey AS story, list_sort(list_distinct(list(o_orderpriority))) AS p FROM orders GROUP BY 1) SELECT story, CASE WHEN list_contains(p, '1-URGENT') AND list_contains(p, '2-HIGH') THEN 'both' WHEN list_contains(p, '1-URGENT') THEN 'national' WHEN list_contains(p, '2-HIGH') THEN 'local' ELSE 'other' END AS scope, len(p)::INTEGER AS outlets FROM s""")
def story_scope(spark, sf):
    """A story's scope follows from the set of scopes of the outlets that carry it."""
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("story")).agg(F.collect_set("o_orderpriority").alias("p"))
    nat, loc = F.array_contains("p", "1-URGENT"), F.array_contains("p", "2-HIGH")
    return s.select("story", F.when(nat & loc, "both").when(nat, "national").when(loc, "local").otherwise("other").alias("scope"), F.size("p").alias("outlets"))


@query(r"""SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z])(The|Der|Los) ') AS capital, regexp_matches(lower(text), '(vote|tion|poll)') AS context FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z])(The|Der|Los) ') AND regexp_matches(lower(text), '(vote|tion|poll)') OR regexp_matches(lower(text), '(^|[^a-z])ondonat([^a-z]|$)')""")
def ambiguous_names(spark, sf):
    """Names that are words as well need a capital and a word of the trade nearby; others are enough by themselves."""
    capital, context = F.col("text").rlike("(^|[^A-Za-z])(The|Der|Los) "), F.lower("text").rlike("(vote|tion|poll)")
    return table(spark, sf, "documents").filter((capital & context) | F.lower("text").rlike("(^|[^a-z])ondonat([^a-z]|$)")).select("doc_id", capital.alias("capital"), context.alias("context"))


@query("""WITH o AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), w AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT o.k AS source, o.n AS old_rows, coalesce(w.n, 0) AS new_rows, CASE WHEN coalesce(w.n, 0) = 0 THEN 'abort: empty' WHEN coalesce(w.n, 0) * 20 < o.n THEN 'abort: shrunk' WHEN w.n > 8 * o.n THEN 'abort: grown' ELSE 'merge' END AS decision FROM o LEFT JOIN w ON o.k = w.k""")
def guarded_sources(spark, sf):
    """A source whose new rows are none, far fewer or far more than the old ones is not merged."""
    o = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("source")).agg(F.count("*").alias("old_rows"))
    w = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("source")).agg(F.count("*").alias("n"))
    x = o.join(w, "source", "left").withColumn("new_rows", F.coalesce("n", F.lit(0)))
    decision = F.when(F.col("new_rows") == 0, "abort: empty").when(F.col("new_rows") * 20 < F.col("old_rows"), "abort: shrunk").when(F.col("new_rows") > 8 * F.col("old_rows"), "abort: grown").otherwise("merge")
    return x.select("source", "old_rows", "new_rows", decision.alias("decision"))


@query("""WITH w AS (SELECT DISTINCT o_custkey AS who, o_orderkey AS story, o_orderdate AS at, unnest(string_split(p_name, ' ')) AS word FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
SELECT a.story AS a, b.story AS b, count(*) AS shared FROM w a JOIN w b ON a.who = b.who AND a.word = b.word AND a.story < b.story AND abs(epoch(a.at) - epoch(b.at)) <= 72 * 3600 GROUP BY 1, 2 HAVING count(*) >= 2""")
def events_72h(spark, sf):
    """Stories of one person within 72 hours that share two words or more: days are bands, so only neighbouring ones meet."""
    o, li, p = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "part")
    w = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey).select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("story"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"), F.explode(F.split("p_name", " ")).alias("word")).distinct()
    w = w.withColumn("band", F.floor(F.col("at") / (72 * 3600)))
    other = w.select("who", "word", F.col("story").alias("b"), F.col("at").alias("at_b"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    m = w.withColumnRenamed("story", "a").join(other, ["who", "word", "band"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("at") - F.col("at_b")) <= 72 * 3600))
    return m.groupBy("a", "b").agg(F.count("*").alias("shared")).filter("shared >= 2")


@query("""WITH n AS (SELECT DISTINCT o_orderdate::DATE AS day, o_orderkey AS story, string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2] AS name, string_split(p_name, ' ')[2] AS surname FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
s AS (SELECT day, surname, name, count(*) AS n FROM n GROUP BY 1, 2, 3), g AS (SELECT day, surname, sum(n)::BIGINT AS stories, count(*) AS forms, arg_min(name, (-n, name)) AS shown FROM s GROUP BY 1, 2) SELECT * FROM g WHERE stories >= 2""")
def most_named(spark, sf):
    """A day's full names grouped by surname, each under its most frequent form; surnames of two stories or more."""
    o, li, p = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "part")
    w = F.split("p_name", " ")
    n = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey).select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("story"), F.concat_ws(" ", F.slice(w, 1, 2)).alias("name"), F.get(w, F.lit(1)).alias("surname")).distinct()
    s = n.groupBy("day", "surname", "name").agg(F.count("*").alias("n"))
    g = s.groupBy("day", "surname").agg(F.sum("n").alias("stories"), F.count("*").alias("forms"), F.min_by("name", F.struct((-F.col("n")).alias("d"), "name")).alias("shown"))
    return g.filter("stories >= 2")


def relaxed(rows: DataFrame, filters: list[tuple[str, Column]]) -> tuple[DataFrame, list[str]]:
    """The rows that pass all filters, or, while none does, all but the last ones; and the names of the filters that held."""
    for k in range(len(filters), -1, -1):
        out = rows
        for _, f in filters[:k]:
            out = out.filter(f)
        if k == 0 or not out.isEmpty():
            return out, [n for n, _ in filters[:k]]
    return rows, []


@query("""SELECT event_type, count(*) AS n, 'kind' AS held FROM events WHERE event_type = 'click' GROUP BY 1""")
def relaxed_search(spark, sf):
    """A question with three filters of which the last two leave nothing: they are dropped, the last one first."""
    rows, held = relaxed(table(spark, sf, "events"), [("kind", F.col("event_type") == "click"), ("person", F.col("user_id") == -7), ("value", F.col("value") > 1e12)])
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("held", F.lit(",".join(held)))
