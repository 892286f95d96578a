"""Feeds, JSON files with a default, and tables and text of HTML, parsed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates, text


def json_or(spark: SparkSession, path: str, schema: str, default: list[tuple]) -> DataFrame:
    """The records of a JSON file (one array or object over many lines), or `default` where there is none or none can be read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        found = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
        names = found.columns[:-1]
        good = found.filter(F.coalesce(*(F.col(c).cast("string") for c in names)).isNotNull()).select(names)
        if not good.isEmpty():
            return good
    return spark.createDataFrame(default, schema)


def _first(x: Column, *tags: str) -> Column:
    """What stands in the first element that has one of the names, as it is written; null where there is none."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(x, rf"(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}>", 1)), F.lit("")) for t in tags))


def _plain(raw: Column) -> Column:
    """An element's text: CDATA as it is, anything else without tags and entities."""
    data = F.regexp_extract(raw, r"(?s)^<!\[CDATA\[(.*?)\]\]>$", 1)
    return F.trim(F.when(raw.startswith("<![CDATA["), data).otherwise(text.html_text(raw)))


def feed_entries(feeds: DataFrame, id_col: str, xml_col: str, most: int | None = None) -> DataFrame:
    """id, nth, title, link, published (UTC, null if none can be read) and summary of the items of RSS and the entries of Atom.

    A broken or null document has no entries, and so has one that is no feed; `most` keeps the first entries of each feed, where
    that is wanted. An Atom link is the href of the alternate link, or of the first one.
    """
    items = F.regexp_extract_all(F.coalesce(F.col(xml_col), F.lit("")), F.lit(r"(?is)<(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)>"), F.lit(1))
    e = feeds.select(F.col(id_col).alias("id"), F.posexplode(F.slice(items, 1, most) if most else items).alias("nth", "x"))
    x = F.col("x")
    href = lambda p: F.regexp_extract(x, p, 1)
    link = F.coalesce(_first(x, "link"), F.nullif(href(r'(?is)<link[^>]*rel="alternate"[^>]*href="([^"]*)"'), F.lit("")), F.nullif(href(r'(?is)<link[^>]*href="([^"]*)"'), F.lit("")))
    raw = e.select("id", (F.col("nth") + 1).alias("nth"), _first(x, "title").alias("title"), link.alias("link"), _first(x, "pubDate", "published", "updated", "dc:date").alias("said"), _first(x, "description", "summary", "content").alias("summary"))
    return raw.select("id", "nth", _plain(F.col("title")).alias("title"), F.replace("link", F.lit("&amp;"), F.lit("&")).alias("link"), dates.published(F.col("said")).alias("published"), _plain(F.col("summary")).alias("summary"))


def feed_status(feeds: DataFrame, entries: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """id, entries, newest and status of each feed: active, silent (a feed without entries), broken (no feed) or missing (null)."""
    n = entries.groupBy("id").agg(F.count(F.lit(1)).alias("entries"), F.max("published").alias("newest"))
    f = feeds.select(F.col(id_col).alias("id"), F.col(xml_col).isNull().alias("missing"), F.coalesce(F.col(xml_col).rlike(r"(?is)<(rss|feed|rdf:RDF)[\s>]"), F.lit(False)).alias("feed"))
    status = F.when(F.col("missing"), "missing").when(~F.col("feed"), "broken").when(F.col("entries") > 0, "active").otherwise("silent")
    return f.join(n, "id", "left").select("id", F.coalesce("entries", F.lit(0)).alias("entries"), "newest", status.alias("status"))


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, table, line and cells (text, in order) of every row of every table; header cells count as cells. Numbers are from 1.

    Tables within tables are not told apart: their rows belong to the outer one up to the inner one's end.
    """
    found = lambda x, tag: F.regexp_extract_all(x, F.lit(rf"(?is)<(?:{tag})(?:\s[^>]*)?>(.*?)</(?:{tag})>"), F.lit(1))
    t = pages.select(F.col(id_col).alias("id"), F.posexplode(found(F.coalesce(F.col(html_col), F.lit("")), "table")).alias("t", "body"))
    r = t.select("id", (F.col("t") + 1).alias("table"), F.posexplode(found(F.col("body"), "tr")).alias("r", "row"))
    return r.select("id", "table", (F.col("r") + 1).alias("line"), F.transform(found(F.col("row"), "td|th"), text.html_text).alias("cells"))


def named_rows(tables: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of tables as columns: the first row that holds all wanted headers (folded, any of the listed names) names the cells.

    A table without such a row gives nothing; short rows have null cells; the header itself and rows without text are left out.
    """
    head = F.transform("cells", text.norm)
    at = {c: F.coalesce(*(F.nullif(F.array_position(head, text.norm(F.lit(n))), F.lit(0).cast("long")) for n in names)) for c, names in wanted.items()}
    h = tables.select("id", "table", "line", *(a.alias(f"_{c}") for c, a in at.items())).filter(" AND ".join(f"_{c} IS NOT NULL" for c in wanted))
    h = h.groupBy("id", "table").agg(F.min_by(F.struct("line", *(f"_{c}" for c in wanted)), "line").alias("h"))
    body = tables.join(h, ["id", "table"]).filter(F.col("line") > F.col("h.line"))
    out = body.select("id", "table", "line", *(F.nullif(F.get("cells", (F.col(f"h._{c}") - 1).cast("int")), F.lit("")).alias(c) for c in wanted))
    return out.filter(F.coalesce(*wanted).isNotNull())


def text_nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, nth and node: the texts between tags, in order, without those of scripts and styles; white space is single."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<!--.*?-->", " ")
    nodes = F.filter(F.transform(F.split(body, r"(?s)<[^>]*>"), text.html_text), lambda x: x != "")
    return pages.select(F.col(id_col).alias("id"), F.posexplode(nodes).alias("n", "node")).select("id", (F.col("n") + 1).alias("nth"), "node")


def source_query(names: list[str], sites: list[str], places: list[str] = ()) -> str:
    """The search string of a source: any of the names, and any of the sites or places. Names of several words are quoted."""
    quoted = lambda xs: " OR ".join(f'"{x}"' if " " in x else x for x in xs)
    where = " OR ".join([*(f"site:{s}" for s in sites), *([quoted(places)] if places else [])])
    return " AND ".join(f"({part})" for part in (quoted(names), where) if part)
