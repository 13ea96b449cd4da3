"""Dates in prose and ages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataquill.functions.patterns import ascii_borders

# Month names with the misspellings that occur.
MONTHS = {
    "mutarama": 1, "gashyantare": 2, "werurwe": 3, "mata": 4, "gicurasi": 5, "kamena": 6, "nyakanga": 7, "kanama": 8, "nzeli": 9, "nzeri": 9, "ukwakira": 10, "ugushyingo": 11, "ugushyungo": 11, "uguhyingo": 11, "ukuboza": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
}
_NAMES = "|".join(MONTHS)
_DAY_FIRST = rf"\b(\d{{1,2}})\s+({_NAMES})\s+(\d{{4}})\b"
_MONTH_FIRST = rf"\b({_NAMES})\s+(\d{{1,2}})\s*,?\s*(\d{{4}})\b"


def day_month_year(text: Column) -> Column:
    """The first D/M/YYYY of a text as YYYY-MM-DD, unchecked; null without one."""
    pattern = ascii_borders(r"\b(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})\b")
    day, month, year = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def _month(name: Column) -> Column:
    result = F.lit(None).cast("int")
    for month in range(1, 13):
        result = F.when(F.lower(name).isin(*(n for n, m in MONTHS.items() if m == month)), F.lit(month)).otherwise(result)
    return result


def named_date(text: Column) -> Column:
    """The first date with a month's name in any of three languages as YYYY-MM-DD; day-first wins."""
    result = None
    for pattern, (day, month, year) in ((_DAY_FIRST, (1, 2, 3)), (_MONTH_FIRST, (2, 1, 3))):
        p = ascii_borders(pattern)
        value = F.when(F.regexp_extract(text, p, year) != "", F.concat_ws("-", F.regexp_extract(text, p, year), F.lpad(_month(F.regexp_extract(text, p, month)).cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, p, day), 2, "0")))
        result = value if result is None else F.coalesce(result, value)
    return result


def date_without_year(text: Column) -> Column:
    """Whether a text has a day and month's name but no complete date."""
    return F.coalesce(named_date(text).isNull() & text.rlike(ascii_borders(rf"\b\d{{1,2}}\s+({_NAMES})\b")), F.lit(False))


def effective_date(on_publication: Column, published: Column, promulgated: Column) -> Column:
    """Publication where the law says so, else publication or promulgation, whichever is known."""
    return F.when(on_publication, published).otherwise(F.coalesce(published, promulgated))


def expiry(start: Column, days: Column) -> Column:
    """``days`` (between 1 and 365, 90 where null) after ``start``."""
    return start + F.make_dt_interval(F.least(F.greatest(F.coalesce(days, F.lit(90)), F.lit(1)), F.lit(365)).cast("int"))


def age_in_days(then: Column, now: Column) -> Column:
    """Age rounded up to days."""
    return F.ceil((F.unix_millis(now) - F.unix_millis(then)) / F.lit(86_400_000))


def age_bucket(then: Column, now: Column) -> Column:
    """``today``, ``week``, ``month`` or ``older``: an age of at most 1, 7 or 30 days, or more."""
    age = age_in_days(then, now)
    return F.when(age <= 1, "today").when(age <= 7, "week").when(age <= 30, "month").otherwise("older")


def age_label(then: Column, now: Column) -> Column:
    """``Today``, ``Yesterday``, ``N days ago`` within a week, else the date."""
    age = age_in_days(then, now)
    return F.when(age <= 1, "Today").when(age == 2, "Yesterday").when(age <= 7, F.concat((age - 1).cast("string"), F.lit(" days ago"))).otherwise(F.date_format(then, "MMM d, yyyy"))
