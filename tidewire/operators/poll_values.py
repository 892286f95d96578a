"""Values stated in headlines: who, which measure and how much, as joins over a table of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text

#: Words that begin another clause, and words that turn a figure into a change.
CONNECTIVES = ("and", "but", "while", "against", "although")
CHANGES = ("rose", "fell", "grew", "dropped", "lost", "gained", "up", "down")
#: Words between a value and its subject at most, and up to which the match is sure.
REACH, NEAR = 12, 6
#: Letters of a word that decide whether it is a cue.
STEM = 6


def words(titles: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, w, clause, value, changed: a row per word. A comma, semicolon or colon at a word's end and connectives end a clause."""
    whole = F.regexp_replace(text.fold(F.coalesce(F.col(text_col), F.lit(""))), r"([0-9])\s+%", "$1%")
    t = titles.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.trim(whole), r"\s+")).alias("pos", "raw"))
    t = t.withColumn("w", F.regexp_replace(F.regexp_replace("raw", "^[^a-z0-9]+", ""), "[^a-z0-9%]+$", ""))
    ends = (F.col("raw").rlike("[,;:]$") | F.col("w").isin(*CONNECTIVES)).cast("int")
    line = Window.partitionBy("id").orderBy("pos")
    t = t.withColumn("clause", F.coalesce(F.sum(ends).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("value", F.replace(F.nullif(F.regexp_extract("w", r"^([0-9]{1,3}([.,][0-9]+)?)%$", 1), F.lit("")), F.lit(","), F.lit(".")).cast("double"))
    changed = F.lit(False)
    for k in (1, 2, 3):  # a clause is a stretch of words, so one order serves all windows
        changed = changed | F.coalesce((F.lag("clause", k).over(line) == F.col("clause")) & F.lag("w", k).over(line).isin(*CHANGES), F.lit(False))
    return t.select("id", "pos", "w", "clause", "value", changed.alias("changed"))


def mentions(t: DataFrame, names: DataFrame, longest: int) -> DataFrame:
    """id, pos, last, clause, subject: where names (subject, phrase) stand. Of names that overlap the longer stays, or the earlier."""
    line = Window.partitionBy("id").orderBy("pos")
    gram = lambda n: F.concat_ws(" ", "w", *(F.lead("w", k).over(line) for k in range(1, n)))
    grams = F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"g{n}").alias("phrase")) for n in range(1, longest + 1)))
    t = t.select("id", "pos", "clause", *(gram(n).alias(f"g{n}") for n in range(1, longest + 1)))
    m = t.select("id", "pos", "clause", F.explode(grams).alias("g")).select("id", "pos", "clause", "g.*").join(names, "phrase")
    m = m.select("id", "pos", (F.col("pos") + F.col("n") - 1).alias("last"), "n", "clause", "subject").distinct()
    o = m.select(F.col("id").alias("id2"), F.col("pos").alias("pos2"), F.col("last").alias("last2"), F.col("n").alias("n2"))
    better = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("pos2") < F.col("pos")))
    return m.join(o, (F.col("id") == F.col("id2")) & (F.col("pos2") <= F.col("last")) & (F.col("pos") <= F.col("last2")) & better, "left_anti").drop("n")


def _first(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def poll_values(titles: DataFrame, names: DataFrame, cues: DataFrame, longest: int = 3, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """id, pos, subject, measure, value and confidence of each percentage that a headline states.

    `names`: subject and phrase (folded words, `longest` at most); `cues`: measure and stem (the first STEM letters of a word).
    Values over 100, changes (a word like "fell" among the three before, in the same clause) and values without a subject within
    REACH words are left out. The subject is the nearest of the value's clause, else the nearest. The measure is the nearest cue of
    its clause; else, with medium confidence, the headline's only measure where a clause without values names it, or that of the
    clause before or after; else it is "unclassified", with low confidence. The first of equal (subject, measure, value) stays.
    Null and empty headlines state nothing; an id that repeats is one headline to the joins.
    """
    heads = titles.select(F.col(id_col).alias("id"), F.col(text_col).alias("title")).filter(F.col("id").isNotNull()).repartition("id")
    h = hits(words(heads, "id", "title"), names, cues, longest)
    x = h.filter((F.size("v") > 0) & (F.size("m") > 0)).select("id", F.inline(_stated(F.col("v"), F.col("m"), F.col("c"))))
    return _first(x, ("id", "subject", "measure", "value"), F.col("pos"))


def hits(t: DataFrame, names: DataFrame, cues: DataFrame, longest: int) -> DataFrame:
    """A row per headline, from one pass over its words: id and the arrays v (values), m (names) and c (cues)."""
    line = Window.partitionBy("id").orderBy("pos")
    gram = lambda n: F.concat_ws(" ", "w", *(F.lead("w", k).over(line) for k in range(1, n)))
    level = F.when((F.col("value") <= 100) & ~F.col("changed"), F.col("value"))
    t = t.select("id", "pos", "clause", level.alias("value"), F.substring("w", 1, STEM).alias("stem"), *(gram(n).alias(f"g{n}") for n in range(1, longest + 1)))
    # n: words of a gram, 0 for the stem and -1 for the value, which meet other tables
    keys = F.array(F.struct(F.lit(-1).alias("n"), F.col("g1").alias("key")), F.struct(F.lit(0).alias("n"), F.col("stem").alias("key")), *(F.struct(F.lit(n).alias("n"), F.col(f"g{n}").alias("key")) for n in range(1, longest + 1)))
    t = t.select("id", "pos", "clause", "value", F.inline(keys)).filter((F.col("n") >= 0) | F.col("value").isNotNull())
    t = t.join(names.select("phrase", "subject", F.lit(True).alias("named")), (F.col("n") > 0) & (F.col("key") == F.col("phrase")), "left")
    t = t.join(cues.select(F.col("stem").alias("_stem"), "measure", F.lit(True).alias("cued")), (F.col("n") == 0) & (F.col("key") == F.col("_stem")), "left")
    value = F.when(F.col("n") == -1, F.struct("pos", "clause", "value"))
    name = F.when(F.col("named"), F.struct(F.col("pos").alias("at"), (F.col("pos") + F.col("n") - 1).alias("last"), "n", F.col("clause").alias("its"), "subject"))
    cue = F.when(F.col("cued"), F.struct(F.col("pos").alias("cue"), "clause", "measure"))
    t = t.filter((F.col("n") == -1) | F.col("named") | F.col("cued"))
    return t.groupBy("id").agg(F.collect_list(value).alias("v"), F.collect_set(name).alias("m"), F.collect_list(cue).alias("c"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, not for each element of the arrays that refer to it."""
    return F.get(F.transform(F.array(value), body), 0)


def _stated(v: Column, m: Column, c: Column) -> Column:
    """The values of one headline: an array of pos, subject, measure, value and confidence."""

    def overlapped(h: Column) -> Column:
        better = lambda o: (o["n"] > h["n"]) | ((o["n"] == h["n"]) & (o["at"] < h["at"]))
        return F.exists(m, lambda o: (o["at"] <= h["last"]) & (h["at"] <= o["last"]) & better(o))

    def nearest(x: Column, names: Column) -> Column:
        gap = lambda h: F.greatest(h["at"] - x["pos"], x["pos"] - h["last"])
        found = F.filter(names, lambda h: gap(h) <= REACH)
        return F.array_min(F.transform(found, lambda h: F.struct((h["its"] != x["clause"]).cast("int").alias("other"), gap(h).alias("gap"), h["at"].alias("at"), h["subject"].alias("subject"))))

    def own(x: Column) -> Column:
        its = F.filter(c, lambda k: k["clause"] == x["clause"])
        return F.array_min(F.transform(its, lambda k: F.struct(F.abs(k["cue"] - x["pos"]).alias("far"), k["cue"].alias("cue"), k["measure"].alias("measure"))))["measure"]

    def near(names: Column) -> Column:
        rows = F.transform(v, lambda x: F.struct(x["pos"].alias("pos"), nearest(x, names).alias("best"), x["clause"].alias("clause"), x["value"].alias("value")))
        rows = F.array_sort(F.filter(rows, lambda x: x["best"].isNotNull()))
        return _let(rows, lambda r: F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1)["pos"] != x["pos"])))

    measures = F.transform(c, lambda k: k["measure"])
    silent = F.exists(c, lambda k: ~F.exists(v, lambda x: x["clause"] == k["clause"]))
    only = F.when(silent & (F.array_min(measures) == F.array_max(measures)), F.array_min(measures))

    def told(pair: Column) -> Column:
        xs = pair["xs"]
        said = lambda clause: F.get(F.filter(xs, lambda y: (y["clause"] == clause) & y["own"].isNotNull()), 0)["own"]

        def row(x: Column) -> Column:
            other = F.coalesce(pair["only"], said(x["clause"] - 1), said(x["clause"] + 1))
            rest = F.when(other.isNotNull(), F.struct(other.alias("measure"), F.lit("medium").alias("confidence"))).otherwise(F.struct(F.lit("unclassified").alias("measure"), F.lit("low").alias("confidence")))
            its = F.struct(x["own"].alias("measure"), F.when(x["best"]["gap"] <= NEAR, "high").otherwise("medium").alias("confidence"))
            how = F.when(x["own"].isNotNull(), its).otherwise(rest)
            return _let(how, lambda k: F.struct(x["pos"].alias("pos"), x["best"]["subject"].alias("subject"), k["measure"].alias("measure"), x["value"].alias("value"), k["confidence"].alias("confidence")))

        return F.transform(xs, row)

    found = _let(F.filter(m, lambda h: ~overlapped(h)), near)
    owned = F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["best"].alias("best"), x["clause"].alias("clause"), x["value"].alias("value"), own(x).alias("own")))
    return _let(F.struct(owned.alias("xs"), only.alias("only")), told)


def oracle(titles: str, names: str, cues: str, longest: int = 3) -> str:
    """The same in DuckDB, as common table expressions up to `found`; titles (id, title), names (subject, phrase) and cues (measure,
    stem) are queries."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    gram = lambda n: "concat_ws(' ', w" + "".join(f", lead(w, {k}) OVER l" for k in range(1, n)) + ")"
    grams = " UNION ALL ".join(f"SELECT id, pos, clause, {n} AS n, {gram(n)} AS phrase FROM t WINDOW l AS (PARTITION BY id ORDER BY pos)" for n in range(1, longest + 1))
    return rf"""
titles AS ({titles}), names AS ({names}), cues AS ({cues}),
s AS (SELECT id, string_split_regex(trim(regexp_replace(translate(lower(coalesce(title, '')), '{text.ACCENTED}', '{text.PLAIN}'), '([0-9])\s+%', '\1%', 'g')), '\s+') AS x FROM titles),
r AS (SELECT id, unnest(range(len(x))) AS pos, unnest(x) AS raw FROM s),
w AS (SELECT id, pos, raw, regexp_replace(regexp_replace(raw, '^[^a-z0-9]+', ''), '[^a-z0-9%]+$', '') AS w FROM r),
k AS (SELECT *, coalesce(sum((regexp_matches(raw, '[,;:]$') OR w IN ({quoted(CONNECTIVES)}))::INT) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clause FROM w),
t AS (SELECT *, replace(nullif(regexp_extract(w, '^([0-9]{{1,3}}([.,][0-9]+)?)%$', 1), ''), ',', '.')::DOUBLE AS value,
  coalesce(bool_or(w IN ({quoted(CHANGES)})) OVER (PARTITION BY id, clause ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS changed FROM k),
v AS (SELECT id, pos, clause, value FROM t WHERE value <= 100 AND NOT changed),
g AS ({grams}), h AS (SELECT DISTINCT id, pos, pos + n - 1 AS last, n, clause, subject FROM g JOIN names USING (phrase)),
m AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.id = h.id AND o.pos <= h.last AND h.pos <= o.last AND (o.n > h.n OR o.n = h.n AND o.pos < h.pos))),
near AS (SELECT v.*, m.subject, greatest(m.pos - v.pos, v.pos - m.last) AS gap FROM v JOIN m USING (id) WHERE greatest(m.pos - v.pos, v.pos - m.last) <= {REACH}
  QUALIFY row_number() OVER (PARTITION BY v.id, v.pos ORDER BY (m.clause <> v.clause)::INT, greatest(m.pos - v.pos, v.pos - m.last), m.pos, m.subject) = 1),
c AS (SELECT id, pos AS cue, clause, measure FROM t JOIN cues ON substr(w, 1, {STEM}) = stem),
own AS (SELECT near.id, near.pos, c.measure AS own FROM near JOIN c USING (id, clause) QUALIFY row_number() OVER (PARTITION BY near.id, near.pos ORDER BY abs(cue - near.pos), cue, measure) = 1),
x AS (SELECT near.*, own FROM near LEFT JOIN own USING (id, pos)),
only_ AS (SELECT id, min(measure) AS only_one FROM c GROUP BY id HAVING min(measure) = max(measure) AND count(*) FILTER (NOT EXISTS (SELECT 1 FROM v WHERE v.id = c.id AND v.clause = c.clause)) > 0),
said AS (SELECT id, clause, own FROM x WHERE own IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, clause ORDER BY pos) = 1),
y AS (SELECT x.id, x.pos, x.subject, x.value, x.own, x.gap, coalesce(only_one, b.own, a.own) AS other FROM x LEFT JOIN only_ USING (id) LEFT JOIN said b ON b.id = x.id AND b.clause + 1 = x.clause LEFT JOIN said a ON a.id = x.id AND a.clause - 1 = x.clause),
found AS (SELECT id, pos, subject, coalesce(own, other, 'unclassified') AS measure, value, CASE WHEN own IS NOT NULL THEN CASE WHEN gap <= {NEAR} THEN 'high' ELSE 'medium' END WHEN other IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM y
  QUALIFY row_number() OVER (PARTITION BY id, subject, coalesce(own, other, 'unclassified'), value ORDER BY pos) = 1)"""
