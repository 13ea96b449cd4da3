"""From positioned lines to parsed documents: layout choice, metadata, warnings, judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataquill.functions.classify import JUDGMENT_MARKERS, MARKERS, ON_PUBLICATION, SECTIONS, any_match, court_of, first_match, instrument_kind, instrument_origin, language_by_markers, marker_counts
from strataquill.functions.dates import date_without_year, day_month_year, effective_date, named_date
from strataquill.functions.lawnumbers import canonical_case_number, cited_cases, cited_statutes, normalise_law_number
from strataquill.functions.text import clean, marker_text, rlike_ascii
from strataquill.operators.lines import articles_of, assemble_lines, carry_forward, column_bands, dry_run_end

# What opens the recitals of an instrument, and what looks like an entry of a citation list.
RECITALS = r"(?iu)(Twebwe|We,|Nous,|Inteko Ishinga Amategeko|The Parliament|Le Parlement)"
LOOKS_CITED = r"(\b[A-Z]{2,8}(?:\s*/\s*[A-Z]+)*\s*\d{4,6}\s*/\s*\d{4}\b)|(\b(?:law|itegeko|loi)\b[^.]{0,40}\bn\s*[°ºo0]?\s*\d)|(\b(?:article|articles|ingingo)\b)|(\bdecided on\b|\binvolving\b|\brwaciwe\b|\bhagati ya\b)"


def classify_streams(lines: DataFrame, keys: list[str], first: int = 400) -> DataFrame:
    """(keys, language, margin) of line streams: markers in the first ``first`` lines decide; the margin is
    the lead over the second language as a share of all markers."""
    sample = lines.where(F.col("line_no") < first)
    sums = sample.groupBy(*keys).agg(*(F.sum(c).alias(k) for k, c in marker_counts(F.col("text")).items()))
    ordered = F.sort_array(F.array(*MARKERS), asc=False)
    total = sum((F.col(k) for k in MARKERS), F.lit(0))
    language = F.lit(None).cast("string")
    for k in reversed(list(MARKERS)):
        language = F.when(F.col(k) == ordered[0], F.lit(k)).otherwise(language)
    return sums.select(*keys, F.when(ordered[0] > 0, language).alias("language"), F.when(total > 0, (ordered[0] - ordered[1]) / total).otherwise(0.0).alias("margin"))


def choose_layout(items: DataFrame, candidates: tuple[int, ...] = (3, 1)) -> DataFrame:
    """(doc, columns, margin): the column count whose streams are coherent languages. A split counts if
    every stream has a language of its own; of these the highest mean margin wins, ties in the order
    of ``candidates``; without any, the last candidate stays."""
    scored = None
    for place, columns in enumerate(candidates):
        lines = assemble_lines(column_bands(items, columns)).select("doc", "band", F.row_number().over(Window.partitionBy("doc", "band").orderBy("page", "line_no")).alias("line_no"), "text")
        streams = classify_streams(lines, ["doc", "band"])
        one = streams.groupBy("doc").agg((F.countDistinct("language") == F.count(F.lit(1))).alias("valid"), F.avg("margin").alias("margin")).withColumns({"columns": F.lit(columns), "place": F.lit(place)})
        scored = one if scored is None else scored.unionByName(one)
    order = Window.partitionBy("doc").orderBy(F.desc("valid"), F.when(F.col("valid"), -F.col("margin")).otherwise(-F.col("place")), "place")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").select("doc", "columns", "margin")


def heading_faces(lines: DataFrame, is_head: Column, most: float = 0.5) -> DataFrame:
    """Lines (id, line_no, text, fonts) with ``wrapped``: one of the two lines behind a heading that are set
    in heading faces only and start no new one. Faces that more than ``most`` of all lines are set in
    tell nothing, so then no line wraps."""
    head = F.coalesce(is_head, F.lit(False))
    marked = carry_forward(lines.withColumn("head", head), F.col("head"))
    faces = marked.where("head").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("fonts"))).alias("faces"))
    joined = marked.join(faces, "id", "left").withColumn("fits", F.forall("fonts", lambda f: F.array_contains(F.col("faces"), f)))
    share = F.avg(F.when(F.col("fits"), 1.0).otherwise(0.0)).over(Window.partitionBy("id"))
    since = F.col("line_no") - F.col("head_no")
    ok = F.col("fits") & ~F.col("head") & ~F.col("text").rlike(r"^\(\d+\)")
    running = F.min(F.when(F.col("head") | ok, 1).otherwise(0)).over(Window.partitionBy("id", "head_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    wrapped = F.coalesce((since > 0) & (since <= 2) & ok & (running == 1) & (share <= most), F.lit(False))
    return joined.withColumn("wrapped", wrapped).select("id", "line_no", "text", "fonts", "wrapped")


def metadata(lines: DataFrame, first: int = 12) -> DataFrame:
    """(id, title, law_number, kind, origin, promulgated_at) from the first ``first`` lines; the title is
    the first four of them before the recitals."""
    top = lines.where(F.col("line_no") < first).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    block = F.array_join(F.transform("l", lambda s: s["text"]), " ")
    head = F.split(block, RECITALS)[0]
    title = clean(F.split(F.array_join(F.transform(F.slice("l", 1, 4), lambda s: s["text"]), " "), RECITALS)[0])
    kind = instrument_kind(head)
    dated = day_month_year(block)
    number = normalise_law_number(block, F.left(F.coalesce(dated, F.lit("")), F.lit(4)), kind)
    return top.select("id", title.alias("title"), number.alias("law_number"), kind.alias("kind"), instrument_origin(head).alias("origin"), F.coalesce(dated, named_date(block)).alias("promulgated_at"))


def parse_instruments(lines: DataFrame) -> DataFrame:
    """One row per document: metadata, number of articles, missing ones, effective date and warnings. A
    document without text gives that one warning; an instrument without parts gives all that apply."""
    found = articles_of(lines)
    numbers = found.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.array_except(F.sequence(F.lit(1), F.max("number")), F.collect_set("number")).alias("missing"),
        F.bool_or(any_match(F.col("body"), ON_PUBLICATION)).alias("on_publication"),
    )
    size = lines.groupBy("id").agg(F.sum(F.length("text")).alias("n_chars"))
    joined = size.join(metadata(lines), "id", "left").join(numbers, "id", "left").withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))
    empty = F.coalesce(F.col("n_chars"), F.lit(0)) < 20
    each = F.array_compact(F.array(
        F.when(F.col("n_articles") == 0, "no articles parsed"), F.when(F.col("law_number").isNull(), "no law number found"), F.when(F.col("kind").isNull(), "instrument type not recognised"),
        F.when(F.size("missing") > 0, F.concat(F.lit("missing articles "), F.array_join(F.transform("missing", lambda n: n.cast("string")), ", "))),
        F.when(F.col("promulgated_at").isNull(), "no promulgation date found"), F.when(F.coalesce("title", F.lit("")) == "", "no title"),
    ))
    warnings = F.when(empty, F.array(F.lit("no text layer"))).otherwise(each)
    effective = effective_date(F.coalesce("on_publication", F.lit(False)), F.lit(None).cast("string"), F.col("promulgated_at"))
    return joined.select("id", "title", "law_number", "kind", "origin", "promulgated_at", effective.alias("effective_from"), "n_articles", warnings.alias("warnings"))


def judgment_sections(lines: DataFrame) -> DataFrame:
    """(id, section, line_no, text) of the lines behind each section marker; lists of statutes and cases
    end where two lines in a row cite nothing. Blank lines are left out first."""
    filled = lines.where(F.trim("text") != "")
    numbered = filled.withColumn("line_no", F.row_number().over(Window.partitionBy("id").orderBy("line_no")))
    section = first_match(marker_text(F.col("text")), SECTIONS)
    carried = carry_forward(numbered.withColumn("marker", section), F.col("marker").isNotNull()).where(F.col("head_no").isNotNull())
    named = carried.withColumn("section", F.first("marker", ignorenulls=True).over(Window.partitionBy("id", "head_no").orderBy("line_no"))).where(F.col("marker").isNull())
    keyed = named.withColumn("key", F.concat_ws("#", F.col("id").cast("string"), F.col("head_no").cast("string")))
    ends = dry_run_end(keyed, "key", "line_no", rlike_ascii(F.col("text"), LOOKS_CITED))
    listed = F.col("section").isin("statutes_cited", "cases_cited")
    kept = keyed.join(ends, "key", "left").where(~listed | F.col("ended_at").isNull() | (F.col("line_no") < F.col("ended_at") - 1))
    return kept.select("id", "section", "line_no", "text")


def parse_judgments(lines: DataFrame, header: int = 40) -> DataFrame:
    """One row per judgment: number, court, date, whether its year is missing, language, statutes and cases cited."""
    top = lines.where(F.col("line_no") < header).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ").alias("head"))
    sections = judgment_sections(lines).groupBy("id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("t"))
    wide = sections.groupBy("id").pivot("section", ["facts", "held", "statutes_cited", "cases_cited"]).agg(F.first("t"))
    number = canonical_case_number(F.col("head"))
    near = F.left(F.col("head"), F.lit(320))
    joined = top.join(wide, "id", "left").withColumn("number", number)
    return joined.select(
        "id", "number", court_of(F.col("number"), F.col("head"))["court"].alias("court"), named_date(near).alias("decided_at"), date_without_year(near).alias("date_incomplete"),
        language_by_markers(F.left(F.concat_ws(" ", "head", "facts", "held"), F.lit(6000)), JUDGMENT_MARKERS).alias("language"), "facts", "held",
        cited_statutes(F.coalesce("statutes_cited", F.lit(""))).alias("statutes"), cited_cases(F.coalesce("cases_cited", F.lit("")), F.col("number")).alias("cases"),
    )


def peak_ratio(scores: DataFrame) -> DataFrame:
    """(q, ratio) of ranked scores (q, rank, score): the top over the mean of ranks 2 to 10; 99 where that
    is zero and the top is not."""
    per = scores.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.coalesce(F.avg(F.when(F.col("rank").between(2, 10), F.col("score"))), F.lit(0.0)).alias("rest"))
    return per.select("q", F.when(F.col("rest") > 0, F.col("top") / F.col("rest")).when(F.col("top") > 0, 99.0).otherwise(0.0).alias("ratio"))


def range_slice(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines with the key of the span (id, key, from_line, to_line) they lie in, by a running last start
    rather than a range join."""
    starts = spans.select("id", F.col("from_line").alias("line_no"), "key", "to_line")
    joined = lines.join(starts, ["id", "line_no"], "left")
    order = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = joined.withColumns({"key": F.last("key", ignorenulls=True).over(order), "to_line": F.last("to_line", ignorenulls=True).over(order)})
    return held.where(F.col("line_no") < F.col("to_line")).drop("to_line")


def preview(messages: DataFrame, longest: int = 100) -> DataFrame:
    """(conversation, preview): the first message of the user, else the first at all, cut to ``longest``."""
    first = messages.groupBy("conversation").agg(F.min_by("content", F.struct(F.col("role") != "user", F.col("turn"))).alias("content"))
    return first.select("conversation", F.when(F.length("content") > longest, F.concat(F.left("content", F.lit(longest)), F.lit("..."))).otherwise(F.col("content")).alias("preview"))
