"""Language labels in any common spelling, as Column expressions and as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("rw", "en", "fr")
#: Names and codes of the languages, without accents, lower case.
LABELS = {
    "rw": ("rw", "kin", "kinyarwanda", "ikinyarwanda", "rwanda"),
    "en": ("en", "eng", "english", "anglais", "icyongereza", "cyongereza"),
    "fr": ("fr", "fra", "fre", "french", "francais", "igifaransa", "gifaransa"),
}


def label_language(label: Column | str) -> Column:
    """The language a label names (``rw``, ``en``, ``fr``), or null: any case, code, region or name."""
    plain = F.translate(F.lower(F.trim(label)), "ç", "c")
    plain = F.regexp_replace(plain, r"[\s\p{Z}]+", "")
    stem = F.regexp_replace(plain, r"[-_(].*$", "")
    result = F.lit(None).cast("string")
    for language, names in LABELS.items():
        result = F.when(stem.isin(*names), language).otherwise(result)
    return result


def label_sql(label: str) -> str:
    """``label_language`` in SQL; what names none is ``und``."""
    stem = f"regexp_replace(regexp_replace(translate(lower({label}), 'ç', 'c'), '[\\s\\p{{Z}}]+', '', 'g'), '[-_(].*$', '')"
    cases = " ".join(f"WHEN {stem} IN ({', '.join(repr(n) for n in names)}) THEN '{language}'" for language, names in LABELS.items())
    return f"CASE {cases} ELSE 'und' END"
