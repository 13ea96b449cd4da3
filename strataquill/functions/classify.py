"""Ordered pattern lists: the first that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataquill.functions.patterns import ascii_borders
from strataquill.functions.text import clean, count_ascii, rlike_ascii

# Function words that mark each language in statutes.
MARKERS = {
    "rw": r"\b(mu|ku|cyangwa|n[a']|ry[a']|by[a']|w[a']|y[a']|iyi|iri|ibi|uyu|kandi|ariko|igihe|ubwo|itegeko|ingingo)\b",
    "en": r"\b(the|shall|of|and|is|are|which|this|for|from|with|any|has|been|to)\b",
    "fr": r"\b(le|la|les|des|du|de|est|sont|qui|que|cette|dans|pour|par|aux|une|un|être|sur)\b",
}
# The same for judgments.
JUDGMENT_MARKERS = {
    "rw": r"\b(mu|ku|cyangwa|urukiko|urubanza|itegeko|ingingo|ko|kandi|ariko|iyi|uru|ubwo|yavuze)\b",
    "en": r"\b(the|of|and|that|court|law|appeal|judgment|which|shall|was|were)\b",
    "fr": r"\b(le|la|les|des|du|de|que|qui|cour|arrêt|loi|est|sont|dans)\b",
}
# Headings of articles.
RW_HEADING = r"^Ingingo\s+ya\s+(mbere|\d+)\s*:\s*(.*)$"
LATIN_HEADING = r"^Article\s+(premier|one|first|\d+)\s*:\s*(.*)$"
# Instruments, the special before the general, with kind and origin.
INSTRUMENTS = (
    ("organic_law", "parliamentary", r"\b(ITEGEKO\s+NGENGA|ORGANIC\s+LAW|LOI\s+ORGANIQUE)\b"),
    ("constitution", "parliamentary", r"\b(ITEGEKO\s+NSHINGA|CONSTITUTION)\b"),
    ("presidential_order", "presidential", r"\b(ITEKA\s+RYA\s+PEREZIDA|PRESIDENTIAL\s+ORDER|ARR[ÊE]T[ÉE]\s+PR[ÉE]SIDENTIEL)\b"),
    ("prime_ministerial_order", "administrative", r"\b(ITEKA\s+RYA\s+MINISITIRI\s+W[’']INTEBE|PRIME\s+MINISTER[’']?S?\s+ORDER|ARR[ÊE]T[ÉE]\s+DU\s+PREMIER\s+MINISTRE)\b"),
    ("ministerial_order", "ministerial", r"\b(ITEKA\s+RYA\s+MINISITIRI|MINISTERIAL\s+ORDER|ARR[ÊE]T[ÉE]\s+MINIST[ÉE]RIEL)\b"),
    ("decree_law", "presidential", r"\b(ITEGEKO[- ]TEKA|DECREE[- ]LAW|D[ÉE]CRET[- ]LOI)\b"),
    ("law", "parliamentary", r"\b(ITEGEKO|LAW|LOI)\b"),
)
# Kinds of provision, with the patterns of each.
PROVISIONS = (
    ("targeted_amendment", (r"\b(is|are)\s+(hereby\s+)?(amended|modified|complemented)\b", r"\bmodifying\s+and\s+complementing\b", r"\b(est|sont)\s+modifiée?s?\b", r"\bportant\s+modification\b", r"\brivugururwa\b", r"\brihindura\b")),
    ("substitution", (r"\bis\s+substituted\s+by\b", r"\best\s+remplacée?\s+par\b", r"\bgisimbujwe\b", r"\bisimbuzwa\b")),
    ("repeal", (r"\b(is|are)\s+(hereby\s+)?(repealed|abrogated)\b", r"\b(est|sont)\s+abrogée?s?\b", r"\bzivanyweho\b", r"\bivanyweho\b")),
    ("commencement", (r"\bthis\s+(organic\s+)?law\s+(shall\s+)?comes?\s+into\s+force\b", r"\bla\s+présente\s+loi\s+(organique\s+)?entre\s+en\s+vigueur\b", r"\biri\s+tegeko\s+(ngenga\s+)?ritangira\s+gukurikizwa\b")),
)
# Fixed value: what makes a mention of commencement a reference.
BEFORE_COMMENCEMENT = r"\b(before|prior\s+to|avant|mbere)\b[^.]{0,40}$"
# Blanket repeals.
BLANKET = (r"\ball\s+(previous\s+)?(legal\s+)?provisions\s+contrary\b", r"\ball\s+prior\s+(legal\s+)?provisions\b", r"\btoutes\s+les\s+dispositions\s+(légales\s+)?(antérieures\s+)?(et\s+)?contraires\b", r"\bingingo\s+zose\s+z[’']amategeko\b", r"\bin\s+all\s+the\s+legislative\s+texts\b")
# Commencement on publication.
ON_PUBLICATION = (r"\bday\s+of\s+(its\s+)?publication\b", r"\bdate\s+of\s+its\s+publication\b", r"\bjour\s+de\s+sa\s+publication\b", r"\bku\s+munsi\s+ritangarijweho\b")
# Words for a status, negations first.
STATUS_WORDS = (
    ("repealed", r"\b(not\s*in\s*force|no\s*longer\s*in\s*force|non\s*en\s*vigueur|inactive|abrogated?|abrogée?)\b"),
    ("repealed", r"\b(repeal\w*|abrogat\w*|kurah\w*|vanwaho)\b"),
    ("amended", r"\b(amended|amend\w*|modifi\w*|vugurur\w*)\b"),
    ("active", r"\b(in\s*force|en\s*vigueur|active|current|dukurikiza)\b"),
)
# Courts by the code that ends a case number, and by name.
COURT_BY_CODE = {"SC": "supreme_court", "CS": "supreme_court", "CA": "court_of_appeal", "HC": "high_court", "TC": "commercial_court", "TGI": "intermediate_court"}
COURT_BY_NAME = (
    ("supreme_court", r"URUKIKO\s+RW?\s*[’'‚]?\s*IKIRENGA"),
    ("supreme_court", r"SUPREME\s+COURT"),
    ("supreme_court", r"COUR\s+SUPR[ÊE]ME"),
    ("court_of_appeal", r"URUKIKO\s+RW?\s*[’'‚]?\s*UBUJURIRE"),
    ("court_of_appeal", r"COURT\s+OF\s+APPEAL"),
    ("court_of_appeal", r"COUR\s+D[’']APPEL"),
    ("high_court", r"URUKIKO\s+RUKURU"),
    ("high_court", r"HIGH\s+COURT"),
    ("commercial_court", r"URUKIKO\s+RW?\s*[’'‚]?\s*UBUCURUZI"),
    ("commercial_court", r"COMMERCIAL\s+COURT"),
)
# Markers that open the sections of a judgment (apostrophes read as blanks).
SECTIONS = (
    ("facts", r"^facts$"),
    ("facts", r"^incamake y ?(ikibazo|icyibazo|kibazo)$"),
    ("facts", r"^les faits$"),
    ("held", r"^held$"),
    ("held", r"^incamake y ?icyemezo$"),
    ("held", r"^decision$"),
    ("statutes_cited", r"^statutes?( and statutory[a-z ]*)? referred to$"),
    ("statutes_cited", r"^statutory and statutes referred to$"),
    ("statutes_cited", r"^amategeko (yashingiweho|yakoreshejwe|yifashishijwe)$"),
    ("cases_cited", r"^cases? (laws? )?referred to$"),
    ("cases_cited", r"^reference cases$"),
    ("cases_cited", r"^imanza (zifashishijwe|zakoreshejwe)$"),
    ("writings_cited", r"^legal writings referred to$"),
    ("writings_cited", r"^inyandiko z abahanga( zifashishijwe)?$"),
)
# Words of an instrument, entries and headings of an index, furniture of a page.
INSTRUMENT_WORD = r"(?<![A-Za-zÀ-ÿ])(ITEGEKO|LAW|LOI|ITEKA|ORDER|ARR[ÊE]T[ÉE]|AMABWIRIZA|REGULATIONS?|R[ÈE]GLEMENT|D[ÉE]CRET|DECREE)(?![A-Za-zÀ-ÿ])"
INDEX_ENTRY = r"[.…·]{3,}\s*\d{1,4}\s*$"
INDEX_HEADING = r"^(Ibirimo|Summary|Sommaire)\b|^[A-Z]\.\s*(Amategeko|Laws?|Lois)\b"
FURNITURE = r"^(Official Gazette n°|Igazeti ya Leta|Journal Officiel|J\.?O\.?\s*n°|Umwaka wa|Year \d|\d+\s*[èe]me Ann[ée]e)"
# Families of parse warnings, and how badly each bites.
WARNING_FAMILIES = (("no text layer", "no text layer (needs OCR)"), ("missing articles", "missing articles"), ("headings not separable", "headings not separable"), ("columns disagree", "columns disagree on metadata"), ("two columns classified", "column split wrong"))
SEVERITY = {
    "no text layer (needs OCR)": "needs OCR", "no articles parsed": "blocks load", "no law number found": "blocks load", "instrument type not recognised": "blocks load",
    "column split wrong": "corrupts text", "column unclassified": "corrupts text", "missing articles": "incomplete", "columns disagree on metadata": "needs a person",
    "headings not separable": "degrades retrieval", "no promulgation date found": "incomplete", "no title": "blocks load",
}


def first_match(text: Column, cases: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first pattern found in ``text``, or null."""
    result = F.lit(None).cast("string")
    for name, pattern in reversed(cases):
        result = F.when(rlike_ascii(text, pattern), F.lit(name)).otherwise(result)
    return result


def parse_heading(line: Column) -> Column:
    """(lang, number, heading) of an article heading, or null. Spelled-out first articles tell English
    from French; other Latin headings are ``und``."""
    rw, latin = ascii_borders(RW_HEADING), ascii_borders(LATIN_HEADING)
    raw = F.lower(F.regexp_extract(line, latin, 1))
    return F.when(
        line.rlike(rw),
        F.struct(F.lit("rw").alias("lang"), F.when(F.lower(F.regexp_extract(line, rw, 1)) == "mbere", 1).otherwise(F.regexp_extract(line, rw, 1).try_cast("int")).alias("number"), clean(F.regexp_extract(line, rw, 2)).alias("heading")),
    ).when(
        line.rlike(latin),
        F.struct(
            F.when(raw == "premier", "fr").when(raw == "one", "en").otherwise("und").alias("lang"),
            F.when(raw.isin("premier", "one", "first"), 1).otherwise(raw.try_cast("int")).alias("number"),
            clean(F.regexp_extract(line, latin, 2)).alias("heading"),
        ),
    )


def marker_counts(text: Column, markers: dict[str, str] = MARKERS) -> dict[str, Column]:
    """Function words of each language in a text."""
    return {language: count_ascii(text, pattern) for language, pattern in markers.items()}


def most_markers(counts: dict[str, Column]) -> Column:
    """The language with the largest count, ties in the order given; null where all are zero."""
    top = F.greatest(*counts.values())
    result = F.lit(None).cast("string")
    for language, count in reversed(list(counts.items())):
        result = F.when(count == top, F.lit(language)).otherwise(result)
    return F.when(top > 0, result)


def language_by_markers(text: Column, markers: dict[str, str] = MARKERS) -> Column:
    """The language with most markers, ties in the order of ``markers``; null without any."""
    return most_markers(marker_counts(F.coalesce(text, F.lit("")), markers))


def english_or_french(counts: dict[str, Column]) -> Column:
    """``en`` or ``fr`` by their marker counts; null where they tie."""
    return F.when(counts["en"] > counts["fr"], "en").when(counts["fr"] > counts["en"], "fr")


def instrument_kind(text: Column) -> Column:
    return first_match(text, tuple((kind, pattern) for kind, _, pattern in INSTRUMENTS))


def instrument_origin(text: Column) -> Column:
    return first_match(text, tuple((origin, pattern) for _, origin, pattern in INSTRUMENTS))


def order_kind(text: Column) -> Column:
    """The kind of an order, whose number's second part is a category; null for other instruments."""
    wanted = ("prime_ministerial_order", "presidential_order", "ministerial_order")
    patterns = {kind: pattern.replace(r"\b", "") for kind, _, pattern in INSTRUMENTS}
    patterns["prime_ministerial_order"] = r"(ITEKA\s+RYA\s+MINISITIRI\s+W[’']INTEBE|PRIME\s+MINISTER|PREMIER\s+MINISTRE)"
    return first_match(text, tuple((kind, patterns[kind]) for kind in wanted))


def read_status(value: Column) -> Column:
    """``active``, ``amended`` or ``repealed`` by the first words that say so; null otherwise."""
    return first_match(value, STATUS_WORDS)


def provision_kind(body: Column) -> Column:
    """Kind of provision; a mention of commencement behind "before" is a reference, not a provision."""
    result = F.lit(None).cast("string")
    for kind, patterns in reversed(PROVISIONS):
        for pattern in reversed(patterns):
            hit = rlike_ascii(body, pattern)
            if kind == "commencement":
                before = F.substring(body, F.lit(1), F.regexp_instr(body, F.lit(ascii_borders(pattern))) - 1)
                hit = hit & ~rlike_ascii(before, BEFORE_COMMENCEMENT)
            result = F.when(hit, F.lit(kind)).otherwise(result)
    return result


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    result = F.lit(False)
    for pattern in patterns:
        result = result | rlike_ascii(text, pattern)
    return result


def court_of(case_number: Column, header: Column) -> Column:
    """(court, disagrees): by the code of the case number, else by name in the header."""
    code = F.regexp_extract(case_number, r"/([A-Z]{2,3})(?:/[A-Z]{2,4})?$", 1)
    by_code = F.lit(None).cast("string")
    for key, court in COURT_BY_CODE.items():
        by_code = F.when(code == key, F.lit(court)).otherwise(by_code)
    by_name = first_match(header, COURT_BY_NAME)
    return F.struct(F.coalesce(by_code, by_name).alias("court"), F.coalesce(by_code != by_name, F.lit(False)).alias("disagrees"))


def warning_family(warning: Column) -> Column:
    result = F.when(warning.contains("unclassified"), "column unclassified").otherwise(warning)
    for start, family in reversed(WARNING_FAMILIES):
        result = F.when(warning.startswith(start), F.lit(family)).otherwise(result)
    return result


def severity_of(family: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, severity in SEVERITY.items():
        result = F.when(family == name, F.lit(severity)).otherwise(result)
    return result
