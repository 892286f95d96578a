"""Date and time functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(ts: Column, hours: int = 0) -> Column:
    """The day of a time at a fixed offset from UTC."""
    return F.to_date(ts + F.expr(f"INTERVAL {hours} HOURS"))


def band(ts: Column) -> Column:
    """morning (before 12), afternoon (before 19) or night."""
    m = F.hour(ts) * 60 + F.minute(ts)
    return F.when(m < 720, "morning").when(m < 1140, "afternoon").otherwise("night")


def week(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def published(text: Column) -> Column:
    """RFC-822 or ISO time in UTC; null if neither."""
    plain = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    rfc = F.coalesce(F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss z")))
    return F.coalesce(rfc, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def url_date(url: Column) -> Column:
    """The date in /YYYY/MM/DD/ or eight digits of a url; null if it is none."""
    slashed = F.regexp_extract(url, r"/(20[0-9]{2}/[01]?[0-9]/[0-3]?[0-9])(/|$)", 1)
    plain = F.regexp_extract(url, r"(20[0-9]{6})", 1)
    return F.coalesce(F.try_to_timestamp(slashed, F.lit("yyyy/M/d")).cast("date"), F.try_to_timestamp(plain, F.lit("yyyyMMdd")).cast("date"))


def mid_period(text: Column) -> Column:
    """A date of day, month or year precision as a day: months at the 15th, years at 1 July."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")).when(text.rlike("^[0-9]{4}-[0-9]{2}$"), F.try_to_timestamp(F.concat(text, F.lit("-15")), F.lit("yyyy-MM-dd")).cast("date")).when(text.rlike("^[0-9]{4}$"), F.try_to_timestamp(F.concat(text, F.lit("-07-01")), F.lit("yyyy-MM-dd")).cast("date"))


def freshness(age_minutes: Column) -> Column:
    return F.when(age_minutes <= 5, "ok").when(age_minutes <= 15, "mid").otherwise("bad")
