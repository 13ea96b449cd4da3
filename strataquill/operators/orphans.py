"""References to records that do not exist.

The references are pre-aggregated per (law, article) key and month, so the key tables are met by one row
per distinct key however often it is cited. Keys that every reference may use drop out at once. The
others go back to the references in two ways: all keys holding more than 1/``heavy_share`` of the
references are at most ``heavy_share`` many, which bounds their broadcast, and their rows never enter a
shuffle; all other rows are joined by a shuffle in which no key holds more than that share. The counts
per table, reason and month come from the pre-aggregated months; only months in which a record came
into being between two references are counted row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.functions.keys import article_key, law_key
from strataquill.session import checkpoint

_NO_ARTICLE = "\u0000"


def _usable(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.when(F.col("deleted_at").isNull(), F.col("created_at"))).alias("first_live"),
        F.count(F.when(F.col("deleted_at").isNull(), 1)).alias("n_live"),
    )


def _reason(n_rows: str, n_live: str) -> F.Column:
    return F.when(F.coalesce(F.col(n_rows), F.lit(0)) == 0, "missing").when(F.col(n_live) == 0, "deleted").otherwise("late")


def _references(citations: DataFrame) -> DataFrame:
    return citations.where(F.col("law_number").isNotNull()).select(
        F.col("id").alias("citation_id"),
        law_key("law_number").alias("law"),
        F.coalesce(article_key("article_number"), F.lit(_NO_ARTICLE)).alias("article"),
        F.coalesce("created_at", F.lit("9999-01-01").cast("timestamp")).alias("at"),
        F.date_trunc("month", "created_at").alias("month"),
    )


def _with_state(keys: DataFrame, laws: DataFrame, articles: DataFrame) -> DataFrame:
    """``keys`` (law, article, ...) with the time from which law and article are usable, and why they are not."""
    epoch, far = F.lit("0001-01-01").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")
    law_rows = laws.select("id", law_key("law_number").alias("law"), F.coalesce("created_at", epoch).alias("created_at"), "deleted_at").dropDuplicates(["id"])
    article_rows = articles.select("id", "law_id", article_key("article_number").alias("article"), F.coalesce("created_at", epoch).alias("created_at"), "deleted_at").dropDuplicates(["id"])
    article_rows = article_rows.join(law_rows.select(F.col("id").alias("law_id"), "law"), "law_id")
    law_state = _usable(law_rows, "law").select("law", *(F.col(c).alias(f"law_{c}") for c in ("n_rows", "first_live", "n_live")))
    article_state = _usable(article_rows, "law", "article").select("law", "article", *(F.col(c).alias(f"article_{c}") for c in ("n_rows", "first_live", "n_live")))
    joined = keys.join(law_state, "law", "left").join(article_state, ["law", "article"], "left")
    return joined.select(
        *keys.columns,
        F.coalesce("law_first_live", far).alias("law_first"),
        F.when(F.col("article") == _NO_ARTICLE, epoch).otherwise(F.coalesce("article_first_live", far)).alias("article_first"),
        _reason("law_n_rows", "law_n_live").alias("law_reason"),
        _reason("article_n_rows", "article_n_live").alias("article_reason"),
    )


def _orphans(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (with ``at`` and the state of their key) that are orphans, with target and reason."""
    target = F.when(F.col("law_first") > F.col("at"), "laws").when(F.col("article_first") > F.col("at"), "articles")
    found = rows.withColumn("target", target).where(F.col("target").isNotNull())
    return found.select("citation_id", "target", F.when(F.col("target") == "laws", F.col("law_reason")).otherwise(F.col("article_reason")).alias("reason"), "month")


def _heavy(keys: DataFrame, names: list[str], heavy_share: int) -> DataFrame:
    """The keys holding more than 1/``heavy_share`` of the sum of ``n``: fewer than ``heavy_share``."""
    return keys.where(F.col("n") * heavy_share > keys.agg(F.sum("n")).scalar()).select(*names)


def _skew_join(refs: DataFrame, state: DataFrame, heavy: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``refs`` with the state of their key: rows of heavy keys by a broadcast, the rest by a shuffle."""
    by_heavy = refs.join(F.broadcast(state.join(F.broadcast(heavy), names, "left_semi")), names)
    rest = refs.join(F.broadcast(heavy), names, "left_anti")
    return by_heavy, rest.join(state.join(F.broadcast(heavy), names, "left_anti").hint("shuffle_hash"), names)


def orphan_references(citations: DataFrame, laws: DataFrame, articles: DataFrame, heavy_share: int = 200) -> DataFrame:
    """One row (citation_id, target, reason, month) per reference without a usable record.

    ``target`` is ``laws`` where no live law of that number existed at the time of the citation,
    else ``articles`` where the law has no such article. A record is usable if it has no
    ``deleted_at`` and its ``created_at`` is not after the citation's. Redelivered rows count once.
    A null law number refers to nothing; a null or blank article number refers to the law only. A
    citation with a null ``created_at`` is compared as if made now: it is never ``late``. Rows with
    a null live ``created_at`` are usable at any time. Other columns are ignored; empty tables give
    ``missing`` for all references, and no references give no rows.
    """
    refs = _references(citations)
    keys = refs.groupBy("law", "article").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    state = _with_state(keys.drop("n"), laws, articles)
    suspect = state.where((F.col("law_first") > F.col("first_at")) | (F.col("article_first") > F.col("first_at"))).drop("first_at")
    by_heavy, by_light = _skew_join(refs, suspect, _heavy(keys, ["law", "article"], heavy_share), ["law", "article"])
    return _orphans(by_heavy).unionByName(_orphans(by_light)).dropDuplicates(["citation_id"])


def orphan_counts(citations: DataFrame, laws: DataFrame, articles: DataFrame, heavy_share: int = 200, most_mixed: int = 1_000_000) -> DataFrame:
    """Orphans (target, reason, month, n_orphans) per table, reason and month of the reference; the
    references are those of ``orphan_references``, counted once however often they were delivered."""
    refs = _references(citations)
    names = ["law", "article", "month"]
    # Redelivered rows are equal, so they stand in one month of one key.
    periods = refs.groupBy(*names).agg(F.count_distinct("citation_id").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    state = _with_state(periods, laws, articles)
    latest = F.greatest("law_first", "article_first")
    target = F.when(F.col("law_first") > F.col("last_at"), "laws").when((F.col("law_first") <= F.col("first_at")) & (F.col("article_first") > F.col("last_at")), "articles")
    suspect = checkpoint(state.where(latest > F.col("first_at")).withColumn("target", target))
    reason = F.when(F.col("target") == "laws", F.col("law_reason")).otherwise(F.col("article_reason"))
    whole = suspect.where(F.col("target").isNotNull()).groupBy("target", reason.alias("reason"), "month").agg(F.sum("n").alias("n_orphans"))
    # A month in which the record came into being between two references is looked at row by row: there
    # are few such months (counted before they are broadcast), so the references need no shuffle.
    mixed = suspect.where(F.col("target").isNull()).drop("target", "n", "first_at", "last_at")
    dated = refs.where(F.col("month").isNotNull())
    if mixed.count() <= most_mixed:
        found = _orphans(dated.join(F.broadcast(mixed), names))
    else:
        parts = [_orphans(p) for p in _skew_join(dated, mixed, _heavy(periods, names, heavy_share), names)]
        found = parts[0].unionByName(parts[1])
    single = found.dropDuplicates(["citation_id"]).groupBy("target", "reason", "month").agg(F.count(F.lit(1)).alias("n_orphans"))
    return whole.unionByName(single).groupBy("target", "reason", "month").agg(F.sum("n_orphans").alias("n_orphans"))
