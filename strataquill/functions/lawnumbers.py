"""Law and case numbers in prose, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataquill.functions.patterns import ascii_borders

# How law, cited and case numbers are printed.
LAW_NUMBER = r"\b(?:N\s*[°ºo]?\s*)?(\d{1,4})\s*(bis|ter)?\s*/\s*(\d{2,4})(\.OL)?\b"
CITED_LAW = r"\bN\s*[°ºo]\s*(\d{1,4})\s*(bis|ter)?\s*/\s*(\d{2,4})\b"
CASE_NUMBER = r"\b((?:[A-Z]+\s*/\s*)*[A-Z]{2,8})\s*(\d{4,6})\s*/\s*(\d{4})\s*/\s*([A-Z]{2,3}(?:/[A-Z]{2,4})?)\b"
# Fixed value: how an entry of a citation list names its law.
STATUTE_ENTRY = r"\b(?:law|itegeko|loi)\b[^.;\n]{0,40}?\bn\s*[°ºo0]?\s*(\d{1,4}\s*/\s*\d{2,4})"
#: A list of article numbers behind the word for article: numbers, joined by commas and words for "and".
ARTICLE_LIST = r"\b(?:articles?|ingingo(?: ya| za)?)\s+(\d+(?:\s*(?:,|&|\band\b|\bet\b|\bna\b)\s*\d+)*)"
CENTURY_PIVOT = 30
CATEGORY_NUMBERED = ("presidential_order", "ministerial_order", "prime_ministerial_order")


def normalise_law_number(raw: Column, year: Column | None = None, kind: Column | None = None) -> Column:
    """``serial[bis|ter]/year[.OL]`` of the first law number in ``raw``; null where there is none.

    Orders whose second part is a category keep it as printed. A four-digit year stays; a shorter one
    takes the stated year's century if their last two digits agree, else the pivot's.
    """
    pattern = ascii_borders(LAW_NUMBER)
    serial, suffix, second, organic = (F.regexp_extract(raw, pattern, k) for k in range(1, 5))
    two = F.lpad(second, 2, "0")
    pivoted = F.concat(F.when(second.try_cast("int") >= CENTURY_PIVOT, F.lit("19")).otherwise(F.lit("20")), two)
    resolved = F.when(F.length(second) == 4, second)
    if year is not None:
        stated = year.cast("string")
        resolved = resolved.when((F.length(stated) == 4) & (F.right(stated, F.lit(2)) == two), stated)
    resolved = resolved.otherwise(pivoted)
    if kind is not None:
        resolved = F.when(kind.isin(*CATEGORY_NUMBERED), second).otherwise(resolved)
    short = F.regexp_replace(serial, r"^0+(?=\d)", "")
    padded = F.when(F.length(short) < 2, F.lpad(short, 2, "0")).otherwise(short)
    return F.when(serial != "", F.concat(padded, F.lower(suffix), F.lit("/"), resolved, F.when(organic != "", F.lit(".OL")).otherwise(F.lit(""))))


def cited_laws(body: Column, own: Column | None = None) -> Column:
    """Distinct canonical numbers of all laws cited with a number sign, in order, without ``own``."""
    found = F.transform(F.regexp_extract_all(body, F.lit(ascii_borders(CITED_LAW)), F.lit(0)), lambda m: normalise_law_number(m))
    kept = found if own is None else F.filter(found, lambda n: ~n.eqNullSafe(own))
    return F.array_distinct(F.array_compact(kept))


def canonical_case_number(text: Column) -> Column:
    """``PREFIX serial/year/COURT`` of the first case number in a text, or null."""
    pattern = ascii_borders(CASE_NUMBER, ignore_case=False)
    prefix, serial, year, court = (F.regexp_extract(text, pattern, k) for k in range(1, 5))
    return F.when(serial != "", F.concat(F.regexp_replace(prefix, r"\s+", ""), F.lit(" "), serial, F.lit("/"), year, F.lit("/"), court))


def cited_cases(text: Column, own: Column | None = None) -> Column:
    """Distinct canonical case numbers of a text, in order, without ``own``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ascii_borders(CASE_NUMBER, ignore_case=False)), F.lit(0)), canonical_case_number)
    kept = found if own is None else F.filter(found, lambda n: ~n.eqNullSafe(own))
    return F.array_distinct(F.array_compact(kept))


def cited_statutes(text: Column) -> Column:
    """Array of (law_number, articles) of a citation list: entries start at the word for law, the first
    number of an entry is its law, article numbers merge per law in numeric order."""
    entries = F.split(text, ascii_borders(r"(?=\b(?:Law|Itegeko|Loi)\b)"))
    law, articles = ascii_borders(STATUTE_ENTRY), ascii_borders(ARTICLE_LIST)
    pairs = F.transform(
        entries,
        lambda e: F.struct(
            normalise_law_number(F.regexp_extract(e, law, 1)).alias("law_number"),
            F.flatten(F.transform(F.regexp_extract_all(e, F.lit(articles), F.lit(1)), lambda m: F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)))).alias("articles"),
        ),
    )
    good = F.filter(pairs, lambda p: p["law_number"].isNotNull())
    numbers = F.array_distinct(F.transform(good, lambda p: p["law_number"]))
    return F.transform(
        numbers,
        lambda n: F.struct(
            n.alias("law_number"),
            F.transform(
                F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(F.filter(good, lambda p: p["law_number"] == n), lambda p: p["articles"])), lambda a: a.cast("int")))), lambda a: a.cast("string")
            ).alias("articles"),
        ),
    )
