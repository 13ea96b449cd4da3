"""Files out: one JSON a document, manifests, pairs, status maps, floors, logs, content-keyed caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataquill.functions.text import digest12, file_slug


def file_names(documents: DataFrame, title_col: str, id_col: str) -> DataFrame:
    """Documents with ``file``: the slug of their title, with -2, -3, ... behind repeats in id order."""
    slugged = documents.withColumn("slug", file_slug(title_col))
    place = F.row_number().over(Window.partitionBy("slug").orderBy(id_col))
    return slugged.withColumn("file", F.when(place == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", place.cast("string")))).drop("slug")


def write_documents(documents: DataFrame, folder: str) -> None:
    """One JSON file set per ``file`` (a folder each), replacing what was there."""
    documents.write.mode("overwrite").partitionBy("file").json(folder)


def write_manifest(parsed: DataFrame, folder: str) -> None:
    """One JSON line a parsed document (file, kind, law_number, n_articles, warnings), replacing what was there."""
    parsed.select("file", "kind", F.col("source.lawNumber").alias("law_number"), F.coalesce(F.size("articles"), F.lit(0)).cast("long").alias("n_articles"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings")).write.mode("overwrite").json(folder)


def write_provisions(provisions: DataFrame, folder: str) -> None:
    """The provisions report as JSON lines, replacing what was there."""
    provisions.write.mode("overwrite").json(folder)


def aligned_pairs(texts: DataFrame) -> DataFrame:
    """(article_id, from, to, source, target) of articles held in both languages: en-rw, fr-rw, en-fr."""
    wide = texts.groupBy("article_id").pivot("language", ["rw", "en", "fr"]).agg(F.first("body"))
    pairs = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.col(a).alias("source"), F.col(b).alias("target")) for a, b in (("en", "rw"), ("fr", "rw"), ("en", "fr"))))
    return wide.select("article_id", F.inline(pairs)).where("source IS NOT NULL AND target IS NOT NULL")


def write_status_map(statuses: DataFrame, laws: DataFrame, folder: str, least: float = 0.5) -> float:
    """Write (law_number, status) if it covers at least ``least`` of the laws, else refuse; the share."""
    counts = laws.select("law_number").distinct().join(statuses.select("law_number", F.lit(1).alias("hit")).distinct(), "law_number", "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k")).first()
    share = counts["k"] / counts["n"] if counts["n"] else 0.0
    if share < least:
        raise ValueError(f"the status map covers {share:.0%} of the laws")
    statuses.select("law_number", "status").write.mode("overwrite").json(folder)
    return share


def status_map(records: DataFrame, row_no: str = "row_no") -> DataFrame:
    """(law_number, status, conflicting): the first status of each law, and whether others differ."""
    return records.where("law_number IS NOT NULL AND status IS NOT NULL").groupBy("law_number").agg(F.min_by("status", row_no).alias("status"), (F.countDistinct("status") > 1).alias("conflicting"))


def write_floors(floors: DataFrame, fingerprint: Column, folder: str) -> None:
    """(language, floor) with the fingerprint they were derived against."""
    floors.select("language", F.col("floor").cast("double"), fingerprint.alias("derived_against")).coalesce(1).write.mode("overwrite").json(folder)


def append_audit(rows: DataFrame, folder: str) -> None:
    """Rows added to a log partitioned by day; question texts are refused."""
    if {"question", "query", "body"} & set(rows.columns):
        raise ValueError("an audit log holds no question text")
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(folder)


def cache_key(*parts: Column) -> Column:
    """First 12 digits of a digest over the parts in order: a name for what was computed from them."""
    return digest12(F.concat_ws("\u0001", *parts))


def review_lines(rows: DataFrame) -> DataFrame:
    """(line) of a markdown list of (id, title, body), in order of id."""
    return rows.select("id", F.explode(F.array(F.concat(F.lit("## "), F.col("id")), F.col("title"), F.concat(F.lit("> "), F.col("body")), F.lit("- [ ] approve"), F.lit("- [ ] reject"))).alias("line")).select("line")
