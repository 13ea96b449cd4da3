"""Text function and classifier queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataquill.functions import classify as C
from strataquill.functions import dates as D
from strataquill.functions import lawnumbers as N
from strataquill.functions import text as T
from strataquill.functions import vectors as V
from strataquill.operators import lines as L
from strataquill.functions.labels import label_sql
from strataquill.sources.tables import records, table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, "article_texts", spread=True)


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", spread=True)


def classify_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder).where("text IS NOT NULL")
    counted = docs.select("doc_id", *(c.cast("long").alias(f"n_{k}") for k, c in C.marker_counts(F.col("text")).items()))
    counts = {k: F.col(f"n_{k}") for k in C.MARKERS}
    return counted.select("*", C.most_markers(counts).alias("language"), C.english_or_french(counts).alias("latin"))


def judgment_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder).where("text IS NOT NULL")
    return docs.select("doc_id", C.language_by_markers(F.col("text"), C.JUDGMENT_MARKERS).alias("language"))


def status_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "laws").dropDuplicates(["id"]).select("id", C.read_status(F.col("status")).alias("status"))


def law_number_normalise(spark: SparkSession, folder: str) -> DataFrame:
    cited = table(spark, folder, "case_statute_citations").where("law_number IS NOT NULL").select("law_number").distinct()
    return cited.select("law_number", N.normalise_law_number(F.col("law_number")).alias("canonical"))


def cited_laws(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder).where("text IS NOT NULL").withColumn("text", F.regexp_replace("text", r"(?iu)\b(law number|loi numéro|itegeko nimero) ", "Law N° "))
    found = docs.select(F.explode(N.cited_laws(F.col("text"))).alias("law"))
    return found.groupBy("law").agg(F.count(F.lit(1)).alias("n"))


def instrument_kinds(spark: SparkSession, folder: str) -> DataFrame:
    t = _texts(spark, folder).where("heading IS NOT NULL")
    return t.groupBy(C.instrument_kind(F.col("body")).alias("kind"), C.instrument_origin(F.col("body")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def provision_kinds(spark: SparkSession, folder: str) -> DataFrame:
    t = _texts(spark, folder).where("body IS NOT NULL")
    return t.groupBy("language", C.provision_kind(F.col("body")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(C.any_match(F.col("body"), C.BLANKET)).alias("blanket"), F.count_if(C.any_match(F.col("body"), C.ON_PUBLICATION)).alias("on_publication"))


def heading_grammar(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles").dropDuplicates(["id"])
    line = F.concat(F.when(F.col("ordinal") % 2 == 0, "Article ").otherwise("Ingingo ya "), F.col("ordinal").cast("string"), F.lit(" :  Title "), F.col("article_number"))
    return a.select("id", C.parse_heading(line).alias("h")).select("id", "h.lang", "h.number", "h.heading")


def case_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cases").dropDuplicates(["id"]).select("id", N.canonical_case_number(F.col("case_number")).alias("canonical"), C.court_of(F.col("case_number"), F.col("court"))["court"].alias("court"))


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = _texts(spark, folder)
    return t.select("id", F.size(T.word_tokens("body")).cast("long").alias("words"), F.size(T.content_words("body")).cast("long").alias("content"), F.size(T.char_ngrams("body")).cast("long").alias("grams"))


def stem_families(spark: SparkSession, folder: str) -> DataFrame:
    words = _texts(spark, folder).where("language = 'rw'").select(F.explode(T.word_tokens("body")).alias("w")).distinct()
    return words.groupBy(T.stem_word("w").alias("stem")).agg(F.count(F.lit(1)).alias("n_words"), F.min("w").alias("first"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("id", T.digest12("heading").alias("heading"), T.digest12("body").alias("body"), F.length("body").cast("long").alias("n"))


def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where("text IS NOT NULL").select("doc_id", T.excerpt("text", 160).alias("excerpt"), T.title_of("text", 50).alias("title"))


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).where("heading IS NOT NULL").select("id", T.slug("heading").alias("slug"), T.file_slug("heading").alias("file"))


def chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder).select("doc_id", F.posexplode(T.chunk_text(T.collapse_upload("text"), 300, 50)).alias("n", "chunk"))
    return docs.select("doc_id", F.col("n").cast("long").alias("n"), "chunk")


def caps_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where("text IS NOT NULL").select("doc_id", F.round(T.caps_ratio("text"), 6).alias("ratio"))


def fnv_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "laws").dropDuplicates(["id"]).select("id", T.fnv1a("law_number").alias("hash"))


def prose_dates(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where("text IS NOT NULL").select("doc_id", D.day_month_year(F.col("text")).alias("first_date"), D.named_date(F.col("text")).alias("named"))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where("text IS NOT NULL").select("doc_id", F.md5(T.clean("text")).alias("digest"))


def vector_lengths(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.round(V.inner_product(F.col("embedding"), F.col("embedding")), 6).alias("square"))


def carried_headings(spark: SparkSession, folder: str) -> DataFrame:
    lines = L.lines_of(_docs(spark, folder), "doc_id", "text")
    carried = L.carry_forward(lines, F.col("text").rlike("^[A-Z]") & ~F.col("text").rlike("[.!?]\\s*$"))
    return carried.groupBy("id", "head_no").agg(F.count(F.lit(1)).alias("n_lines"))


def line_spans(spark: SparkSession, folder: str) -> DataFrame:
    lines = L.lines_of(_docs(spark, folder), "doc_id", "text")
    return L.segment(lines, F.col("text") != "", F.lower(F.substring("text", 1, 1)))


def furniture_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = L.lines_of(_texts(spark, folder).select("id", "body"), "id", "body")
    return lines.where(F.col("text").isNotNull()).groupBy("id").agg(F.count_if(L.is_furniture(F.trim("text"))).alias("furniture"), F.count(F.lit(1)).alias("n_lines"))


def question_lists(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "history").dropDuplicates(["id"])
    return h.select("id", F.array_join(T.question_lines(F.concat_ws("\n", F.concat(F.lit("- "), F.col("question")), "answer")), "|").alias("questions"))


def warning_triage(spark: SparkSession, folder: str) -> DataFrame:
    laws = table(spark, folder, "laws").dropDuplicates(["id"])
    warnings = laws.select("id", F.explode(F.array_compact(F.array(F.when(F.col("gazette_ref").isNull(), "no text layer on 3 pages"), F.when(F.col("published_at").isNull(), "no promulgation date found"), F.when(F.col("coverage") == "partial", F.concat(F.lit("missing articles 2-"), F.length("law_number").cast("string")))))).alias("warning"))
    distinct = warnings.groupBy(C.warning_family(F.col("warning")).alias("family"), "warning").agg(F.count(F.lit(1)).alias("n"))
    # The three first of a family are taken before they are gathered.
    place = F.row_number().over(Window.partitionBy("family").orderBy("warning"))
    examples = distinct.select("family", "warning").withColumn("place", place).where("place <= 3").groupBy("family").agg(F.array_join(F.array_sort(F.collect_list("warning")), ";").alias("examples"))
    by = distinct.groupBy("family").agg(F.sum("n").alias("n")).join(examples, "family")
    return by.withColumn("severity", C.severity_of(F.col("family")))


_NAMES = (
    classify_language, judgment_language, status_words, law_number_normalise, cited_laws, instrument_kinds, provision_kinds, heading_grammar, case_numbers, word_counts, stem_families, digests, excerpts, slugs, chunk_text,
    caps_ratios, fnv_labels, prose_dates, cleaned, vector_lengths, carried_headings, line_spans, furniture_lines, question_lists, warning_triage,
)
QUERIES = {f.__name__: f for f in _NAMES}
_T = f"(SELECT DISTINCT * REPLACE ({label_sql('language')} AS language) FROM article_texts)"


def _n(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '(?i){pattern.replace(chr(39), chr(39) * 2)}'))"


def _argmax(markers: dict[str, str]) -> str:
    a, b, c = (_n(markers[k]) for k in ("rw", "en", "fr"))
    return f"CASE WHEN greatest({a}, {b}, {c}) = 0 THEN NULL WHEN {a} = greatest({a}, {b}, {c}) THEN 'rw' WHEN {b} = greatest({a}, {b}, {c}) THEN 'en' ELSE 'fr' END"


def _case(cases: list[tuple[str, str]], text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in cases) + " END"


_INSTRUMENT = [(k, p) for k, _, p in C.INSTRUMENTS]
_ORIGIN = [(o, p) for _, o, p in C.INSTRUMENTS]
_PROVISION = [(k, p) for k, ps in C.PROVISIONS[:3] for p in ps]
_LAW = r"(?i)\b(?:N\s*[°ºo]?\s*)?(\d{1,4})\s*(bis|ter)?\s*/\s*(\d{2,4})(\.OL)?\b"
_CANON = f"regexp_replace(CASE WHEN length(regexp_replace(a, '^0+(\\d)', '\\1')) < 2 THEN '0' ELSE '' END || regexp_replace(a, '^0+(\\d)', '\\1') || lower(b) || '/' || CASE WHEN length(c) = 4 THEN c WHEN c::INT >= 30 THEN '19' || lpad(c, 2, '0') ELSE '20' || lpad(c, 2, '0') END || CASE WHEN d <> '' THEN '.OL' ELSE '' END, 'x^', '')"
_STEP = "250"
_MONTH_CASES = " ".join("WHEN lower({0}) IN (" + ", ".join(f"'{n}'" for n, m in D.MONTHS.items() if m == month) + f") THEN '{month:02d}'" for month in range(1, 13))


def _named(pattern: str, day: int, month: int, year: int) -> str:
    part = lambda k: f"regexp_extract(text, '(?i){pattern}', {k})"
    return f"CASE WHEN {part(year)} <> '' THEN concat_ws('-', {part(year)}, CASE {_MONTH_CASES.format(part(month))} END, lpad({part(day)}, 2, '0')) END"


_MONTHS = "|".join(D.MONTHS)
_DMY = r"\b(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})\b"
_FIRST_DATE = f"CASE WHEN regexp_extract(text, '{_DMY}', 3) <> '' THEN concat_ws('-', regexp_extract(text, '{_DMY}', 3), lpad(regexp_extract(text, '{_DMY}', 2), 2, '0'), lpad(regexp_extract(text, '{_DMY}', 1), 2, '0')) END"
_DAY_NAMED, _MONTH_NAMED = rf"\b(\d{{1,2}})\s+({_MONTHS})\s+(\d{{4}})\b", rf"\b({_MONTHS})\s+(\d{{1,2}})\s*,?\s*(\d{{4}})\b"
_CASE = r"\b((?:[A-Z]+\s*/\s*)*[A-Z]{2,8})\s*(\d{4,6})\s*/\s*(\d{4})\s*/\s*([A-Z]{2,3}(?:/[A-Z]{2,4})?)\b"
_COURTS = " ".join(f"WHEN '{code}' THEN '{court}'" for code, court in C.COURT_BY_CODE.items())
_COURT_NAMES = " ".join(f"WHEN regexp_matches(court, '(?i){pattern.replace(chr(39), chr(39) * 2)}') THEN '{court}'" for court, pattern in C.COURT_BY_NAME)
ORACLES = {
    "prose_dates": f"SELECT doc_id, {_FIRST_DATE} AS first_date, coalesce({_named(_DAY_NAMED, 1, 2, 3)}, {_named(_MONTH_NAMED, 2, 1, 3)}) AS named FROM documents WHERE text IS NOT NULL",
    "question_lists": r"""SELECT id, array_to_string(list_filter(list_transform(string_split(concat_ws(chr(10), '- ' || question, answer), chr(10)), lambda s: trim(regexp_replace(s, '^\s*(?:[-*•]|\d+[.)])\s*', ''))), lambda s: length(s) > 12 AND length(s) < 240 AND contains(s, '?'))[1:3], '|') AS questions FROM (SELECT DISTINCT id, question, answer FROM history)""",
    "case_numbers": rf"""SELECT id, CASE WHEN regexp_extract(case_number, '{_CASE}', 2) <> '' THEN regexp_replace(regexp_extract(case_number, '{_CASE}', 1), '\s+', '', 'g') || ' ' || regexp_extract(case_number, '{_CASE}', 2) || '/' || regexp_extract(case_number, '{_CASE}', 3) || '/' || regexp_extract(case_number, '{_CASE}', 4) END AS canonical,
 coalesce(CASE regexp_extract(case_number, '/([A-Z]{{2,3}})(?:/[A-Z]{{2,4}})?$', 1) {_COURTS} END, CASE {_COURT_NAMES} END) AS court FROM (SELECT DISTINCT id, case_number, court FROM cases)""",
    "cited_laws": f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?i)\\b(law number|loi numéro|itegeko nimero) ', 'Law N° ', 'g'), '(?i)\\bN\\s*[°ºo]\\s*(\\d{{1,4}})\\s*(bis|ter)?\\s*/\\s*(\\d{{2,4}})\\b')) AS law_number FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, {_CANON} AS law FROM (SELECT doc_id, law_number, regexp_extract(law_number, '{_LAW}', 1) AS a, regexp_extract(law_number, '{_LAW}', 2) AS b, regexp_extract(law_number, '{_LAW}', 3) AS c, regexp_extract(law_number, '{_LAW}', 4) AS d FROM m)) SELECT law, count(DISTINCT doc_id) AS n FROM c WHERE law IS NOT NULL GROUP BY law""",
    "fnv_labels": f"SELECT id, {T.fnv1a_sql('law_number')} AS hash FROM (SELECT DISTINCT id, law_number FROM laws)",
    "classify_language": f"SELECT doc_id, {_n(C.MARKERS['rw'])} AS n_rw, {_n(C.MARKERS['en'])} AS n_en, {_n(C.MARKERS['fr'])} AS n_fr, {_argmax(C.MARKERS)} AS language, CASE WHEN {_n(C.MARKERS['en'])} > {_n(C.MARKERS['fr'])} THEN 'en' WHEN {_n(C.MARKERS['fr'])} > {_n(C.MARKERS['en'])} THEN 'fr' END AS latin FROM documents WHERE text IS NOT NULL",
    "judgment_language": f"SELECT doc_id, {_argmax(C.JUDGMENT_MARKERS)} AS language FROM documents WHERE text IS NOT NULL",
    "status_words": f"SELECT id, {_case(list(C.STATUS_WORDS), 'status')} AS status FROM (SELECT DISTINCT * FROM laws)",
    "law_number_normalise": f"SELECT law_number, {_CANON} AS canonical FROM (SELECT DISTINCT law_number, regexp_extract(law_number, '{_LAW}', 1) AS a, regexp_extract(law_number, '{_LAW}', 2) AS b, regexp_extract(law_number, '{_LAW}', 3) AS c, regexp_extract(law_number, '{_LAW}', 4) AS d FROM case_statute_citations WHERE law_number IS NOT NULL)",
    "instrument_kinds": f"SELECT {_case(_INSTRUMENT, 'body')} AS kind, {_case(_ORIGIN, 'body')} AS origin, count(*) AS n FROM {_T} WHERE heading IS NOT NULL GROUP BY ALL",
    "heading_grammar": "SELECT id, CASE WHEN ordinal % 2 = 0 THEN 'und' ELSE 'rw' END AS lang, ordinal AS number, 'Title ' || trim(regexp_replace(article_number, '\\s+', ' ', 'g')) AS heading FROM (SELECT DISTINCT * FROM articles)",
    "word_counts": r"SELECT id, len(list_filter(string_split(regexp_replace(lower(coalesce(body, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) > 2)) AS words, len(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(body, '')), '[^\p{L}\p{N}\s''’]+', ' ', 'g'), '\s+'), lambda w: length(w) >= 5)) AS content, greatest(length(regexp_replace(lower(coalesce(body, '')), '[^\p{L}\p{N}]+', '', 'g')) - 3, 0) AS grams FROM (SELECT DISTINCT * FROM article_texts)",
    "digests": f"SELECT id, left(sha256(heading), 12) AS heading, left(sha256(body), 12) AS body, length(body) AS n FROM {_T}",
    "excerpts": "SELECT doc_id, CASE WHEN length(text) > 160 THEN rtrim(substring(text, 1, 160), ' ') || '…' ELSE text END AS excerpt, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS title FROM documents WHERE text IS NOT NULL",
    "slugs": f"SELECT id, regexp_replace(regexp_replace(regexp_replace(trim(lower(heading), ' '), '[^A-Za-z0-9_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g') AS slug, lower(regexp_replace(regexp_replace(heading, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS file FROM {_T} WHERE heading IS NOT NULL",
    "chunk_text": f"""WITH d AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, t, unnest(range(0, length(t), {_STEP})) AS i FROM d),
 p AS (SELECT doc_id, i, length(t) AS n, substring(t, i + 1, 301) AS piece FROM s), b AS (SELECT *, length(piece) - instr(reverse(piece), ' ') AS last, instr(reverse(piece), ' ') AS back FROM p)
 SELECT doc_id, i // {_STEP} AS n, trim(substring(piece, 1, CASE WHEN i + 300 < n AND back > 0 AND last > 0 THEN last ELSE 300 END), ' ') AS chunk FROM b""",
    "caps_ratios": "SELECT doc_id, CASE WHEN length(l) < 4 THEN 0.0 ELSE round(length(regexp_replace(l, '[^A-ZÀ-Þ]', '', 'g')) / length(l), 6) END AS ratio FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g') AS l FROM documents WHERE text IS NOT NULL)",
    "cleaned": "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{A0}\\x{0B}]+', ' ', 'g'), ' ')) AS digest FROM documents WHERE text IS NOT NULL",
    "vector_lengths": "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square FROM embeddings",
    "carried_headings": "WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL), h AS (SELECT id, last_value(CASE WHEN regexp_matches(text, '^[A-Z]') AND NOT regexp_matches(text, '[.!?]\\s*$') THEN line_no END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INT AS head_no FROM l) SELECT id, head_no, count(*) AS n_lines FROM h GROUP BY ALL",
    "line_spans": "WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10)))))::INT AS line_no FROM documents WHERE text IS NOT NULL), s AS (SELECT id, line_no, lower(substring(text, 1, 1)) AS key FROM l WHERE text <> ''), c AS (SELECT * FROM (SELECT *, lag(key) OVER (PARTITION BY id ORDER BY line_no) AS before FROM s) WHERE key IS DISTINCT FROM before), e AS (SELECT id, max(line_no) + 1 AS n FROM l GROUP BY id) SELECT c.id, key, line_no AS from_line, coalesce(lead(line_no) OVER (PARTITION BY c.id ORDER BY line_no), n) AS to_line FROM c JOIN e ON c.id = e.id",
    "furniture_lines": f"SELECT id, count(*) FILTER (WHERE regexp_matches(t, '(?i){C.FURNITURE}') OR regexp_matches(t, '^\\d{{1,3}}$')) AS furniture, count(*) AS n_lines FROM (SELECT id, trim(unnest(string_split(body, chr(10))), ' ') AS t FROM {_T} WHERE body IS NOT NULL) GROUP BY id",
    "warning_triage": """WITH w AS (SELECT unnest(list_filter([CASE WHEN gazette_ref IS NULL THEN 'no text layer on 3 pages' END, CASE WHEN published_at IS NULL THEN 'no promulgation date found' END, CASE WHEN coverage = 'partial' THEN 'missing articles 2-' || length(law_number) END], lambda x: x IS NOT NULL)) AS warning FROM (SELECT DISTINCT * FROM laws)),
 f AS (SELECT CASE WHEN starts_with(warning, 'no text layer') THEN 'no text layer (needs OCR)' WHEN starts_with(warning, 'missing articles') THEN 'missing articles' ELSE warning END AS family, warning FROM w)
 SELECT family, count(*) AS n, array_to_string(list_sort(list_distinct(list(warning)))[1:3], ';') AS examples, CASE family WHEN 'no text layer (needs OCR)' THEN 'needs OCR' ELSE 'incomplete' END AS severity FROM f GROUP BY family""",
}
