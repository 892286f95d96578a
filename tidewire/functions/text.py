"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented letters of the supported languages and their base letters.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"
STOP = ("that", "this", "with", "from", "para", "pour", "dans", "eine", "nicht", "como", "sobre", "their", "which")


def fold(x: Column) -> Column:
    """Lower case without accents; letters such as ß stay."""
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def fold_ascii(x: Column) -> Column:
    """fold, then nothing but ASCII."""
    return F.regexp_replace(fold(x), r"[^\x00-\x7F]", "")


def norm(x: Column) -> Column:
    """Folded words of a-z and 0-9 with one space between them."""
    return F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", " "))


def tokens(x: Column, least: int = 4, stop: tuple[str, ...] = STOP) -> Column:
    """Distinct folded words of at least `least` letters that are not stop words, in order."""
    return F.filter(F.array_distinct(F.regexp_extract_all(fold(x), F.lit(f"([a-z]{{{least},}})"), F.lit(1))), lambda w: ~w.isin(*stop))


def each(df: DataFrame, array: Column, name: str, *rest: str) -> DataFrame:
    """A row for each item that is not null, beside the columns in `rest`. A plain explode makes the optimizer filter on the array
    first, which then is computed twice more for every row."""
    return df.select(*rest, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def stems(toks: Column) -> Column:
    """Words of seven letters or more cut to six."""
    return F.transform(toks, lambda w: F.when(F.length(w) >= 7, F.substring(w, 1, 6)).otherwise(w))


def keywords(x: Column, most: int = 6) -> Column:
    """The first distinct words of three letters or more."""
    return F.slice(F.array_distinct(F.regexp_extract_all(fold(x), F.lit("([a-z0-9]{3,})"), F.lit(1))), 1, most)


def title_key(x: Column) -> Column:
    """A headline without a trailing ' - Source', folded to words: equal for the same headline of two outlets."""
    return norm(F.regexp_replace(x, r" - [^-]*$", ""))


def stable_id(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def shorten(x: Column, most: int) -> Column:
    """Cut at a word's end, with an ellipsis, where longer than `most`."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.regexp_extract(F.substring(x, 1, most - 1), "(?s)^(.*) ", 1), F.lit("…")))


def html_text(x: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments, tags or doubled spaces; five entities resolved."""
    out = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def occurrences(x: Column, word: str) -> Column:
    """How often a substring occurs, without overlaps."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(word), F.lit("")))) / len(word)).cast("long")


def tone(x: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """Occurrences of positive less those of negative substrings of the lower-cased text."""
    low, total = F.lower(x), F.lit(0).cast("long")
    for w in positive:
        total = total + occurrences(low, w)
    for w in negative:
        total = total - occurrences(low, w)
    return total


def boolean_query(x: Column, query: str) -> Column:
    """Words joined by AND, "phrases", -exclusions and a|b alternatives, as one predicate on folded text; short words match whole."""
    import re as _re

    folded, out = F.concat(F.lit(" "), norm(x), F.lit(" ")), F.lit(True)
    for part in _re.findall(r'-?"[^"]+"|\S+', query):
        off = part.startswith("-")
        any_of = F.lit(False)
        for word in part.lstrip("-").strip('"').lower().split("|"):
            any_of = any_of | folded.contains(f" {word} " if len(word) <= 3 else word)
        out = out & (~any_of if off else any_of)
    return out
