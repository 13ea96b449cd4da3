"""Canonical spelling of legal references, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"[\s\p{Z}.]+"


def law_key(column: Column | str) -> Column:
    """Canonical key of a law number: ``Law No 007 / 1962 .OL`` becomes ``7/1962ol``.

    Case, blanks, stops, leading zeros of the serial, number signs and words before the number do
    not count; ``bis``, ``ter`` and ``OL`` do. Null stays null; a value without a number is only
    lower-cased and stripped.
    """
    bare = F.regexp_replace(F.lower(column), _BLANKS, "")
    return F.regexp_replace(bare, r"^[^0-9]*0*([0-9]+[a-z]*/[0-9]+[a-z]*)[^a-z0-9]*$", "$1")


def article_key(column: Column | str) -> Column:
    """Canonical key of an article number: ``Art. 09 bis.`` becomes ``9bis``. Blank becomes null."""
    bare = F.regexp_replace(F.lower(column), _BLANKS, "")
    return F.nullif(F.regexp_replace(bare, r"^[^0-9]*0*([0-9]+[a-z]*)[^a-z0-9]*$", "$1"), F.lit(""))
