"""Quality rules: a threshold table compiled into one projection of native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import SPACE, let

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in is it that was for on as with by are be this an at or from a "
    "le la les de des du et en un une que qui dans pour par sur au est pas "
    "el los las y se por con para del al su es lo "
    "der die das und von zu den ist mit im auf für ein eine nicht"
).split()
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Keeps a document if low <= 100 * part / whole <= high; a bound of None is open. Integers only, so that no engine rounds."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def broken(self) -> Column:
        part, whole, bad = 100 * F.col(self.part), F.col(self.whole), F.lit(False)
        if self.low is not None:
            bad = bad | (part < self.low * whole)
        if self.high is not None:
            bad = bad | (part > self.high * whole)
        return bad

    def broken_sql(self) -> str:
        return " OR ".join(f"100 * {self.part} {op} {bound} * {self.whole}" for op, bound in (("<", self.low), (">", self.high)) if bound is not None)


#: Production thresholds. Ratios of ordinary prose in the four languages lie well inside them.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols_to_words", "n_symbols", "n_words", None, 10),
    Rule("stop_words_to_words", "n_stop", "n_words", 7, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 40),
)


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of `width` words that occurs twice or more: sorted windows, then the union of the found ones."""

    def cover(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["x"] == e["x"], F.lit(False)))
        at = F.array_sort(F.transform(twice, lambda e: e["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(width), F.coalesce(v - F.get(p, k - 1), F.lit(width)))), F.lit(0), lambda a, x: a + x))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(width))))
        return F.when(F.size(w) < width, F.lit(0)).otherwise(let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(let(F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("x"), i.alias("i")))), cover))))

    return let(words, of)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """One row per input row: its metrics, base_failed, kept and the names of the broken rules.

    Null and empty texts have no words and fail the base. A ratio over zero is neither below nor above a bound. Repeated rows are
    judged one by one; other columns of the input are not read, so their names cannot clash. An empty table gives an empty result.
    There is no shuffle: each row is judged where it is read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    parts = docs.select(F.col(id_col), text.alias("_text"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"), lines.alias("_lines"))
    found = parts.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    broken = F.array_compact(F.array(*(F.when(r.broken(), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")
    judged = found.select("*", failed.alias("base_failed"), broken.alias("broken_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    broken = " OR ".join(f"({r.broken_sql()})" for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS l,
  len(list_filter(w, lambda v: v IN ({stops}))) AS n_stop FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM g),
k AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS o FROM r WHERE c > 1) GROUP BY doc_id),
m AS (SELECT x.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_stop::BIGINT AS n_stop, coalesce(k.n, 0)::BIGINT AS n_repeat_words FROM x LEFT JOIN k USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({broken}) AS kept FROM b"""
