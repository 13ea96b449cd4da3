"""Operators on ordered lines: boundaries, carried headings, spans, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataquill.functions.classify import FURNITURE, INDEX_ENTRY, INDEX_HEADING, INSTRUMENT_WORD, order_kind, parse_heading
from strataquill.functions.lawnumbers import LAW_NUMBER, normalise_law_number
from strataquill.functions.text import caps_ratio, clean, rlike_ascii


def lines_of(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, text) of the lines of each text, numbered from 0; null texts have none."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "text"))


def _in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("line_no")


def is_title_line(text: Column) -> Column:
    """A title block line: an instrument's word and number, mostly capitals, not of an index."""
    return ~rlike_ascii(text, INDEX_ENTRY) & ~rlike_ascii(text, INDEX_HEADING) & rlike_ascii(text, INSTRUMENT_WORD) & rlike_ascii(text, LAW_NUMBER) & (caps_ratio(text) >= 0.75)


def segment(lines: DataFrame, is_start: Column, key: Column) -> DataFrame:
    """Spans (id, key, from_line, to_line) that start where ``key`` changes from the start before; the
    last span of a text ends behind its last line."""
    starts = lines.withColumns({"key": F.when(is_start, key)}).where(F.col("key").isNotNull())
    changed = starts.withColumn("before", F.lag("key").over(_in_order("id"))).where(~F.col("key").eqNullSafe(F.col("before")))
    ends = lines.groupBy("id").agg((F.max("line_no") + 1).alias("n_lines"))
    spans = changed.withColumn("next", F.lead("line_no").over(_in_order("id"))).join(ends, "id")
    return spans.select("id", "key", F.col("line_no").alias("from_line"), F.coalesce("next", "n_lines").alias("to_line"))


def segment_issue(lines: DataFrame) -> DataFrame:
    """Spans of the instruments of an issue, by title lines."""
    return segment(lines, is_title_line(F.col("text")), normalise_law_number(F.col("text"), kind=order_kind(F.col("text"))))


def carry_forward(lines: DataFrame, is_head: Column) -> DataFrame:
    """Every line with ``head_no``, the number of the last line at or before it that is a head."""
    head = F.last(F.when(is_head, F.col("line_no")), ignorenulls=True).over(_in_order("id").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("head_no", head)


def articles_of(lines: DataFrame, least: int = 10) -> DataFrame:
    """(id, number, heading, body) of the articles in a stream of lines; of articles with one number
    the last with a body longer than ``least`` characters stays, which skips contents pages."""
    parsed = lines.withColumn("h", parse_heading(F.col("text")))
    carried = carry_forward(parsed, F.col("h").isNotNull()).where(F.col("head_no").isNotNull())
    body = clean(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("line_no", "text")))), lambda s: s["text"]), " "))
    built = carried.groupBy("id", "head_no").agg(F.max(F.col("h")["number"]).alias("number"), F.max(F.col("h")["heading"]).alias("heading"), body.alias("body"))
    kept = built.where(F.length("body") > least)
    return kept.groupBy("id", "number").agg(F.max_by("heading", "head_no").alias("heading"), F.max_by("body", "head_no").alias("body"))


def indexed_instruments(lines: DataFrame, look_back: int = 3) -> DataFrame:
    """(id, law_number) of the entries of an index: the number stands on the line of the leaders or one
    of the ``look_back`` lines before it; the nearest counts."""
    number = F.when(rlike_ascii(F.col("text"), INSTRUMENT_WORD), normalise_law_number(F.col("text"), kind=order_kind(F.col("text"))))
    near = F.last(number, ignorenulls=True).over(_in_order("id").rowsBetween(-look_back, 0))
    return lines.withColumn("law_number", near).where(rlike_ascii(F.col("text"), INDEX_ENTRY) & F.col("law_number").isNotNull()).select("id", "law_number").distinct()


def dry_run_end(rows: DataFrame, key: str, order: str, is_wet: Column, length: int = 2) -> DataFrame:
    """(key, ended_at): the order of the first row that completes ``length`` rows in a row without
    ``is_wet``; null where none does."""
    window = Window.partitionBy(key).orderBy(order).rowsBetween(-(length - 1), 0)
    dry = F.when(is_wet, 0).otherwise(1)
    return rows.withColumn("dry", F.sum(dry).over(window)).groupBy(key).agg(F.min(F.when(F.col("dry") == length, F.col(order))).alias("ended_at"))


def missing_runs(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, n_missing, missing) of the numbers 1..max that a key lacks, as runs like ``1-3, 7``."""
    held = rows.where(F.col(number).isNotNull()).groupBy(key).agg(F.collect_set(number).alias("held"), F.max(number).alias("last"))
    gaps = held.select(key, F.explode_outer(F.array_except(F.sequence(F.lit(1), F.col("last").cast("int")), F.col("held"))).alias("n"))
    island = F.col("n") - F.row_number().over(Window.partitionBy(key).orderBy("n"))
    runs = gaps.withColumn("island", island).groupBy(key, "island").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("n").alias("size"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).when(F.col("a").isNotNull(), F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    listed = runs.groupBy(key).agg(F.sum("size").alias("n_missing"), F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("a", text.alias("t"))))).alias("l"))
    return listed.select(key, "n_missing", F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("missing"))


def is_furniture(text: Column) -> Column:
    """A running header of a page, or a bare page number."""
    return rlike_ascii(text, FURNITURE) | text.rlike(r"^\d{1,3}$")


def column_bands(items: DataFrame, columns: int) -> DataFrame:
    """Items (doc, page, x, ...) with ``band``, one of ``columns`` bands of equal width on their page."""
    page = Window.partitionBy("doc", "page")
    low, high = F.min("x").over(page), F.max("x").over(page)
    band = F.when(high > low, F.least(F.lit(columns - 1), F.floor((F.col("x") - low) / ((high - low) / columns)))).otherwise(0)
    return items.withColumn("band", band.cast("int"))


def assemble_lines(items: DataFrame, tolerance: float = 3.0, gap: float = 1.0) -> DataFrame:
    """(doc, page, band, line_no, text, fonts) from items (doc, page, band, x, y, width, text, font).

    A line takes every item at most ``tolerance`` below its first; a gap wider than ``gap`` is a blank.
    Anchoring on the first item needs state, so each page's band is one bounded group folded in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "width", "text", "font")))
    pages = items.groupBy("doc", "page", "band").agg(ordered.alias("items"))
    empty = F.array().cast("array<struct<anchor:double,items:array<struct<x:double,width:double,text:string,font:string>>>>")

    def add(lines: Column, item: Column) -> Column:
        part = F.struct(item["x"].cast("double").alias("x"), item["width"].cast("double").alias("width"), item["text"].alias("text"), item["font"].alias("font"))
        last = F.try_element_at(lines, F.lit(-1))
        joined = F.array(F.struct(last["anchor"].alias("anchor"), F.concat(last["items"], F.array(part)).alias("items")))
        opened = F.array(F.struct(item["y"].cast("double").alias("anchor"), F.array(part).alias("items")))
        near = (F.size(lines) > 0) & (F.abs(last["anchor"] - item["y"]) <= tolerance)
        return F.when(near, F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), joined)).otherwise(F.concat(lines, opened))

    folded = pages.select("doc", "page", "band", F.posexplode(F.aggregate("items", empty, add)).alias("line_no", "line"))

    def write(state: Column, part: Column) -> Column:
        spaced = F.when(state["end"].isNotNull() & (part["x"] - state["end"] > gap), F.lit(" ")).otherwise(F.lit(""))
        return F.struct(F.concat(state["text"], spaced, part["text"]).alias("text"), (part["x"] + part["width"]).alias("end"))

    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))
    text = clean(F.aggregate(F.array_sort(F.col("line")["items"]), start, write)["text"])
    lines = folded.select("doc", "page", "band", "line_no", text.alias("text"), F.array_distinct(F.transform(F.col("line")["items"], lambda p: p["font"])).alias("fonts"))
    return lines.where((F.col("text") != "") & ~is_furniture(F.col("text")))
