"""Text functions: Column -> Column, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataquill.functions.patterns import ascii_borders


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def clean(column: Column | str) -> Column:
    """White space (also non-breaking) collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(_col(column), r"[\s ]+", " "))


def bare(column: Column | str) -> Column:
    """The letters and digits of the lower-cased text; null gives an empty text."""
    return F.regexp_replace(F.lower(F.coalesce(_col(column), F.lit(""))), r"[^\p{L}\p{N}]+", "")


def char_ngrams(column: Column | str, n: int = 4) -> Column:
    """Overlapping slices of ``n`` letters and digits of the lower-cased text; a lookahead makes it
    linear in the length, and none begins inside a surrogate pair. Null gives an empty array, as does
    a text of fewer than ``n``."""
    return F.regexp_extract_all(bare(column), F.lit(rf"(?=(.{{{n}}}))(?!\p{{Cs}})"), F.lit(1))


def word_tokens(column: Column | str, longer_than: int = 2) -> Column:
    """Lower-case runs of letters and digits longer than ``longer_than``, in order, with repeats."""
    spaced = F.regexp_replace(F.lower(F.coalesce(_col(column), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: F.length(w) > longer_than)


def content_words(column: Column | str, least: int = 5) -> Column:
    """Lower-case words with their apostrophes and digits, of at least ``least`` characters."""
    spaced = F.regexp_replace(F.lower(F.coalesce(_col(column), F.lit(""))), r"[^\p{L}\p{N}\s'’]+", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda w: F.length(w) >= least)


# Noun and verb affixes of Kinyarwanda, longest first where they share a beginning.
AUGMENTS = ("u", "a", "i", "o")
CLASS_PREFIXES = ("mu", "mw", "ba", "b", "mi", "my", "ri", "ry", "ma", "m", "ki", "gi", "ky", "bi", "by", "n", "ru", "rw", "ka", "ga", "tu", "du", "bu", "bw", "ku", "gu", "kw", "gw", "ha", "h")
VERB_PREFIXES = ("nd", "n", "u", "a", "tu", "du", "mu", "ba", "ki", "bi", "zi", "ru", "ka", "ha", "ya", "ra", "ku", "gu")
TENSE_MARKERS = ("ra", "ri", "za", "a", "aa")
LEAST_ROOT = 3


def _alternatives(affixes: tuple[str, ...]) -> str:
    return "|".join(sorted(affixes, key=len, reverse=True))


def stem_word(column: Column | str) -> Column:
    """Probable root of a Kinyarwanda word: an augment with its class prefix (or either alone), then a
    verb prefix with its tense marker, then a final vowel go, as long as ``LEAST_ROOT`` letters stay.

    An affix counts only if it is the longest that fits its place. Shorter words stay as they are.
    """
    root = f"(?=.{{{LEAST_ROOT}}})"
    classes, verbs, tenses = map(_alternatives, (CLASS_PREFIXES, VERB_PREFIXES, TENSE_MARKERS))
    word = F.regexp_replace(F.lower(_col(column)), r"[^\p{L}\p{N}]", "")
    opened = (
        F.when(word.rlike(f"^[{''.join(AUGMENTS)}](?>{classes}){root}"), F.regexp_replace(word, f"^.(?>{classes})", ""))
        .when(word.rlike(f"^[{''.join(AUGMENTS)}].{{{LEAST_ROOT + 1},}}"), F.substring(word, 2, 10_000))
        .when((word == F.lower(_col(column))) & word.rlike(f"^(?>{classes}){root}"), F.regexp_replace(word, f"^(?>{classes})", ""))
        .otherwise(word)
    )
    verbal = F.when(opened.rlike(f"^(?>{verbs})(?>{tenses}){root}"), F.regexp_replace(opened, f"^(?>{verbs})(?>{tenses})", "")).otherwise(opened)
    ended = F.when(verbal.endswith("ye") & (F.length(verbal) >= LEAST_ROOT + 2), F.expr("'2'")).when(~verbal.endswith("ye") & verbal.rlike("[ae]$") & (F.length(verbal) >= LEAST_ROOT + 1), F.expr("'1'")).otherwise("0").cast("int")
    return F.when(F.length(word) <= LEAST_ROOT, word).otherwise(F.left(verbal, F.length(verbal) - ended))


def stem_tokens(column: Column | str) -> Column:
    """Every word of more than two letters, each followed by its root where that differs."""
    pairs = F.transform(word_tokens(column), lambda w: F.struct(w.alias("word"), stem_word(w).alias("root")))
    return F.flatten(F.transform(pairs, lambda p: F.when(p["root"] == p["word"], F.array(p["word"])).otherwise(F.array(p["word"], p["root"]))))


def stem_and_char_tokens(column: Column | str) -> Column:
    """The bag of words with their roots and of character 4-grams."""
    return F.concat(stem_tokens(column), char_ngrams(column))


def excerpt(column: Column | str, longest: int) -> Column:
    """The first ``longest`` characters, with an ellipsis where more followed."""
    text = _col(column)
    return F.when(F.length(text) > longest, F.concat(F.rtrim(F.left(text, F.lit(longest))), F.lit("…"))).otherwise(text)


def title_of(column: Column | str, longest: int = 50) -> Column:
    """The first ``longest`` characters, with three points where more followed."""
    text = _col(column)
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest)), F.lit("..."))).otherwise(text)


def slug(column: Column | str) -> Column:
    """Lower-case ASCII words joined by single hyphens; accented letters drop out."""
    kept = F.regexp_replace(F.trim(F.lower(_col(column))), r"[^A-Za-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-")


def file_slug(column: Column | str) -> Column:
    """A name for an output file: runs of other characters become a hyphen, ends are trimmed."""
    return F.lower(F.regexp_replace(F.regexp_replace(_col(column), r"[^A-Za-z0-9_-]+", "-"), "^-+|-+$", ""))


def digest12(column: Column | str) -> Column:
    """First 12 hexadecimal digits of SHA-256."""
    return F.left(F.sha2(_col(column), 256), F.lit(12))


def fnv1a(column: Column | str) -> Column:
    """32-bit FNV-1a over UTF-16 code units (basic plane), as 8 hexadecimal digits."""
    codes = F.transform(F.filter(F.split(_col(column), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def fnv1a_sql(text: str) -> str:
    """``fnv1a`` in SQL."""
    codes = f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: unicode(c)::HUGEINT)"
    return f"lower(lpad(to_hex(list_reduce(list_prepend(2166136261::HUGEINT, {codes}), lambda h, c: ((xor(h, c)) * 16777619) % 4294967296)::BIGINT), 8, '0'))"


def caps_ratio(column: Column | str) -> Column:
    """Share of capitals among Latin letters; 0 where there are fewer than four letters."""
    letters = F.regexp_replace(_col(column), "[^A-Za-zÀ-ÿ]", "")
    capitals = F.regexp_replace(letters, "[^A-ZÀ-Þ]", "")
    return F.when(F.length(letters) < 4, F.lit(0.0)).otherwise(F.length(capitals) / F.length(letters))


def chunk_text(column: Column | str, size: int = 1000, overlap: int = 100) -> Column:
    """Chunks that start every ``size - overlap`` characters and end at the last blank not behind
    ``size`` (if one follows the start). Null and empty texts give an empty array."""
    text = F.coalesce(_col(column), F.lit(""))
    step = max(1, size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def chunk(start: Column) -> Column:
        piece = F.substring(text, start + 1, F.lit(size + 1))  # one more: a blank may stand right behind
        back = F.instr(F.reverse(piece), " ")
        last = F.length(piece) - back
        cut = F.when((start + size < F.length(text)) & (back > 0) & (last > 0), last).otherwise(F.lit(size))
        return F.trim(F.left(piece, cut))

    return F.transform(starts, chunk)


def question_lines(column: Column | str, most: int = 3) -> Column:
    """The first ``most`` lines that ask something: bullets off, a question mark, 13 to 239 characters."""
    lines = F.transform(F.split(_col(column), "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.filter(lines, lambda s: (F.length(s) > 12) & (F.length(s) < 240) & s.contains("?")), 1, most)


def tidy(column: Column | str) -> Column:
    """Model output without reasoning blocks and a leading label."""
    plain = F.regexp_replace(_col(column), r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(F.trim(plain), r"(?i)^(?:translation|answer|traduction)\s*:\s*", ""))


def marker_text(column: Column | str) -> Column:
    """Apostrophes of all kinds as blanks, white space collapsed: for section markers."""
    return clean(F.regexp_replace(_col(column), "[’'‘`]", " "))


def contains_ignoring_case(column: Column | str, part: Column | str) -> Column:
    """Substring test without regard to case."""
    return F.contains(F.lower(_col(column)), F.lower(part if isinstance(part, Column) else F.lit(part)))


def collapse_upload(column: Column | str) -> Column:
    """An uploaded text with all white space collapsed, ready for chunking."""
    return F.regexp_replace(_col(column), r"\s+", " ")


def numeric_order(column: Column | str) -> Column:
    """An array of number strings in numeric order."""
    return F.transform(F.array_sort(F.transform(_col(column), lambda x: x.cast("int"))), lambda x: x.cast("string"))


#: Phrasings of one concept, per language.
SYNONYMS = {
    "due_process": {
        "en": ("fair trial", "fair hearing", "due process of law", "due process", "judicial guarantees"),
        "fr": ("procès équitable", "garantie de justice", "droit à la garantie de justice", "droit à un procès"),
        "rw": ("ubutabera buboneye", "uburenganzira ku butabera buboneye", "kuburanishwa neza", "uburenganzira bwo kuburana"),
    },
    "presumption_of_innocence": {
        "en": ("innocent until proven guilty", "presumed innocent", "presumption of innocence"),
        "fr": ("présumé innocent", "présomption d'innocence", "innocent jusqu'à preuve"),
        "rw": ("afatwa nk’umwere", "umwere kugeza igihe"),
    },
    "liberty_of_person": {
        "en": ("locked up without a reason", "arbitrary detention", "unlawful detention", "liberty and security of person", "held without charge"),
        "fr": ("détention arbitraire", "liberté et sécurité de la personne", "détenu sans motif"),
        "rw": ("gufungwa nta mpamvu", "umudendezo w’umuntu"),
    },
    "privacy_of_home": {
        "en": ("search my house", "search my home", "enter my home without permission", "privacy of a person and of family", "privacy of his or her home", "inviolability of the home"),
        "fr": ("perquisition de mon domicile", "inviolabilité du domicile", "entrer chez moi sans autorisation"),
        "rw": ("gusaka inzu", "ubudahangarwa bw’urugo"),
    },
    "freedom_of_expression": {
        "en": ("say what I want", "freedom of speech", "freedom of expression", "freedom of opinion"),
        "fr": ("liberté d'expression", "liberté d'opinion", "dire ce que je veux"),
        "rw": ("kuvuga icyo ntekereza", "ubwisanzure bwo kuvuga"),
    },
    "equality_before_law": {
        "en": ("treated the same", "equality before the law", "equal protection", "discrimination"),
        "fr": ("égalité devant la loi", "traité de la même façon", "discrimination"),
        "rw": ("kunganya imbere y’amategeko", "ivangura"),
    },
    "right_to_property": {
        "en": ("take my land", "expropriation", "right to property", "private property"),
        "fr": ("exproprier ma terre", "droit de propriété", "propriété privée"),
        "rw": ("kwambura ubutaka", "uburenganzira ku mutungo"),
    },
}


def expand_query(query: Column | str, language: Column | str, groups: dict[str, dict[str, tuple[str, ...]]] | None = None) -> Column:
    """The query followed by the other phrasings of every concept it mentions in its language; the
    concepts of ``groups`` (name -> language -> phrasings), ``SYNONYMS`` where none are given."""
    text, lang = _col(query), _col(language)
    parts = []
    for phrasings in (SYNONYMS if groups is None else groups).values():
        for code, phrases in phrasings.items():
            present = [F.contains(F.lower(text), F.lit(p.lower())) for p in phrases]
            hit = present[0]
            for p in present[1:]:
                hit = hit | p
            others = F.array_compact(F.array(*(F.when(~there, F.lit(p)) for p, there in zip(phrases, present))))
            parts.append(F.when((lang == code) & hit, others).otherwise(F.array().cast("array<string>")))
    return F.concat_ws(" ", F.array(text), F.flatten(F.array(*parts)))


def rlike_ascii(column: Column | str, pattern: str) -> Column:
    """Search for a pattern whose borders are ASCII and whose case does not count."""
    return _col(column).rlike(ascii_borders(pattern))


def count_ascii(column: Column | str, pattern: str) -> Column:
    """Number of matches of such a pattern."""
    return F.regexp_count(_col(column), F.lit(ascii_borders(pattern)))
