"""Extraction queries: links with their text, numbered items, longest-match entities, greedy and online clustering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.plans.registry import query
from tidewire.plans.texts import NORM
from tidewire.session import table


@query("""SELECT page_id, pos, href, label FROM (SELECT page_id, unnest(range(1, len(h) + 1))::INTEGER AS pos, unnest(list_transform(h, lambda x: regexp_extract(x, 'href="([^"]*)"', 1))) AS href, unnest(list_transform(h, lambda x: regexp_extract(x, '>([^<]*)</a>', 1))) AS label
FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS h FROM pages))""")
def links_with_text(spark, sf):
    a = F.regexp_extract_all("html", F.lit('(<a href="[^"]*">[^<]*</a>)'), F.lit(1))
    d = table(spark, sf, "pages").select("page_id", F.posexplode(a).alias("pos", "x"))
    return d.select("page_id", (F.col("pos") + 1).alias("pos"), F.regexp_extract("x", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("x", ">([^<]*)</a>", 1).alias("label"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM l)
SELECT doc_id, k::INTEGER AS item, length(line)::INTEGER AS size, coalesce(length(after), 0)::INTEGER AS next_size FROM n WHERE regexp_matches(line, '^[A-Z][a-z]+ ')""")
def agenda_items(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    n = d.withColumn("after", F.lead("line").over(Window.partitionBy("doc_id").orderBy("k")))
    return n.filter(F.col("line").rlike("^[A-Z][a-z]+ ")).select("doc_id", (F.col("k") + 1).alias("item"), F.length("line").alias("size"), F.coalesce(F.length("after"), F.lit(0)).alias("next_size"))


@query()
def longest_entities(spark, sf):
    """Greedy left-to-right links: the longest of the known names that starts at a word, names not overlapping.

    The names are the first two words of every item of the benchmark (of one-word items that word). The texts' words and pairs of
    words meet them in a join, and only what met is resolved per document, so neither names nor texts have a limit.
    """
    first = F.slice(F.split(text.norm(F.col("text")), " "), 1, 2)
    names = table(spark, sf, "benchmark").select(F.array_join(first, " ").alias("name")).filter("name <> ''").distinct()
    w = F.col("w")
    grams = F.concat(
        F.transform(w, lambda x, i: F.struct(i.alias("at"), F.lit(1).alias("n"), x.alias("name"))),
        F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.struct(i.alias("at"), F.lit(2).alias("n"), F.concat_ws(" ", x, F.get(w, i + 1)).alias("name"))),
    )
    # rows that repeat a doc_id are linked one by one
    d = table(spark, sf, "documents").select("doc_id", F.monotonically_increasing_id().alias("row"), F.split(text.norm(F.col("text")), " ").alias("w"))
    met = d.select("doc_id", "row", F.explode(grams).alias("g")).select("doc_id", "row", "g.*").join(names, "name")
    hits = met.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "name"))).alias("hits"))

    @F.pandas_udf("array<string>")
    def link(at: pd.Series, less: pd.Series, name: pd.Series) -> pd.Series:
        def one(row: tuple) -> list[str]:
            end, out = 0, []
            for i, k, x in zip(*row, strict=True):
                if i >= end:
                    out.append(x)
                    end = i - k
            return out

        return pd.Series([one(row) for row in zip(at, less, name, strict=True)], dtype=object)

    return hits.select("doc_id", F.explode(link("hits.at", "hits.less", "hits.name")).alias("name"))


@query()
def leader_clusters(spark, sf):
    """Online clustering in id order per source: a headline joins the first leader of Jaccard 0.3 with three shared words, else leads."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.floor(F.col("doc_id") / 500).cast("long").alias("day"), text.tokens(F.col("text")).alias("t"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders, out = [], []
        for i, t in zip(pdf.sort_values("doc_id")["doc_id"], pdf.sort_values("doc_id")["t"], strict=True):
            s = set(t)
            hit = next((a for a, b in leaders if len(s & b) >= 3 and len(s & b) >= 0.3 * len(s | b)), None)
            if hit is None:
                leaders.append((i, s))
                hit = i
            out.append((i, hit))
        return pd.DataFrame(out, columns=["doc_id", "leader"])

    return d.groupBy("source", "day").applyInPandas(run, "doc_id long, leader long")


@query(f"SELECT doc_id, list_reduce(list_transform(list_filter(string_split({NORM}, ' '), lambda w: w <> ''), lambda w: length(w)), lambda a, b: greatest(a, b))::INTEGER AS longest FROM documents WHERE len(list_filter(string_split({NORM}, ' '), lambda w: w <> '')) > 0")
def longest_word(spark, sf):
    w = F.filter(F.split(text.norm(F.col("text")), " "), lambda x: x != "")
    return table(spark, sf, "documents").filter(F.size(w) > 0).select("doc_id", F.array_max(F.transform(w, F.length)).alias("longest"))
