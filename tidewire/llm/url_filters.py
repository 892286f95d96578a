"""URL filters: host suffix and path prefix rules found by a sorted sweep over canonical keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Urls of a host suffix that one task sweeps, about; a suffix with more is dealt over several.
HOT = 1 << 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    found = lambda k: F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", k)
    return F.translate(found(1), UPPER, LOWER), found(2)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def segments(rules: DataFrame) -> DataFrame:
    """The rules (host, path, verdict) as events: from key `at` on, below reversed host `rev`, the innermost rule is `hit`.

    A rule's path is a prefix, hence an interval from its bytes to its bytes and 0xFF, which UTF-8 never holds. Such intervals nest
    or are disjoint, so a stack tells the innermost one: a start pushes its rule; an end pops, and the top is then the last start
    of the depth that is left. Both are window functions over the sorted events, with no rule collected.
    """
    named = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    named = named.select(F.array_join(_reversed(F.col("host")), ".").alias("rev"), F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("hn"), F.concat("host", "path").alias("rule"), "verdict").alias("own"), F.col("path").cast("binary").alias("path"))
    ends = named.select("rev", F.col("own"), F.explode(F.array(F.struct(F.col("path").alias("at"), F.lit(1).alias("step")), F.struct(F.concat("path", F.unhex(F.lit("FF"))).alias("at"), F.lit(-1).alias("step")))).alias("e")).select("rev", "own", "e.*")
    deep = ends.withColumn("depth", F.sum("step").over(Window.partitionBy("rev").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    top = F.last(F.when(F.col("step") == 1, F.col("own")), ignorenulls=True).over(Window.partitionBy("rev", "depth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return deep.select("rev", "at", F.when(F.col("depth") > 0, top).alias("hit"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", hot: int = HOT) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits) and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest (host and path together, then host)
    wins; of rules equal in host and path, allow wins. A null url, or one without '://', has an empty host and path and gets the
    default. Repeated rows are each judged, very long urls like any other; other columns are not read; no pages or no rules are fine.

    Distinct (host, path) pairs are judged once. Each is swept under each of its host suffixes that is no longer than the longest
    rule's, next to that suffix's events, in sorted order: a host fits by equal labels from its end and a path by its first bytes,
    so under a key of both a host's subdomains would not be one interval of a path. A suffix with more than `hot` urls is dealt
    over tasks by a salt; each of them is given the events of the suffix, which come from the rules alone.
    """
    rules = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labels = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()[0]
    keys = rows.filter("host != ''").select("host", "path").distinct()
    parts = F.slice(_reversed(F.col("host")), 1, max(labels, 1))
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    urls = keys.select("host", "path", F.explode(levels).alias("rev"), F.col("path").cast("binary").alias("at"))
    # only suffixes that have rules are swept
    named = rules.select(F.array_join(_reversed(F.col("host")), ".").alias("rev")).distinct()
    urls = urls.join(named, "rev", "left_semi")
    dealt = urls.groupBy("rev").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("salts")).filter("salts > 1")
    urls = urls.join(dealt, "rev", "left").select("host", "path", "rev", "at", F.pmod(F.xxhash64("host", "path"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    events = segments(rules).join(dealt, "rev", "left").select("rev", "at", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.struct("hit").alias("event"))
    both = urls.select("rev", "at", "salt", "host", "path", F.lit(1).alias("late")).unionByName(events.withColumn("late", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("rev", "salt").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    hits = both.withColumn("hit", F.last("event", ignorenulls=True).over(sweep)["hit"]).filter("late = 1 AND hit IS NOT NULL")
    best = hits.groupBy("host", "path").agg(F.max("hit").alias("hit"))
    return rows.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def oracle() -> str:
    """The registered query in DuckDB: every rule against every page."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH r(h, p, v) AS (VALUES {values}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
m AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1"""
