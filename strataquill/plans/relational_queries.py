"""Relational queries over the legal and the commercial tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataquill.functions import dates as D
from strataquill.functions.keys import law_key
from strataquill.operators import lines as L
from strataquill.operators import loads, paging
from strataquill.functions.labels import label_sql
from strataquill.sources.tables import records, table

_LANGUAGES = ("rw", "en", "fr")


def statute_reach(spark: SparkSession, folder: str) -> DataFrame:
    cited = records(spark, folder, "case_statute_citations").select(law_key("law_number").alias("law")).where("law IS NOT NULL").groupBy("law").agg(F.count(F.lit(1)).alias("n"))
    known = records(spark, folder, "laws").select(law_key("law_number").alias("law"), F.lit(1).alias("known")).distinct()
    return cited.join(known, "law", "left").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("resolved"))


def law_reliance(spark: SparkSession, folder: str) -> DataFrame:
    cited = records(spark, folder, "case_statute_citations").withColumn("law", law_key("law_number")).where("law IS NOT NULL")
    # Two steps, so that a law cited by a tenth of all rows is combined before it is shuffled.
    return cited.groupBy("law", "case_id").agg(F.count(F.lit(1)).alias("n")).groupBy("law").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("n").alias("n_citations"))


def partial_law_rollup(spark: SparkSession, folder: str) -> DataFrame:
    laws = records(spark, folder, "laws").where("coverage = 'partial'").select(F.col("id").alias("law_id"), "law_number")
    articles = records(spark, folder, "articles").select(F.col("id").alias("article_id"), "law_id")
    texts = records(spark, folder, "article_texts").groupBy("article_id").agg(F.count(F.lit(1)).alias("n_texts"))
    joined = laws.join(articles, "law_id", "left").join(texts, "article_id", "left")
    return joined.groupBy("law_id", "law_number").agg(F.count("article_id").alias("articles"), F.coalesce(F.sum("n_texts"), F.lit(0)).alias("texts"))


def cited_laws_known(spark: SparkSession, folder: str) -> DataFrame:
    cited = records(spark, folder, "case_statute_citations").select(law_key("law_number").alias("law")).where("law IS NOT NULL").distinct()
    known = records(spark, folder, "laws").where("deleted_at IS NULL").select(law_key("law_number").alias("law"))
    return cited.join(known, "law", "left_semi").withColumn("state", F.lit("present")).unionByName(cited.join(known, "law", "left_anti").withColumn("state", F.lit("missing")))


def heading_pivot(spark: SparkSession, folder: str) -> DataFrame:
    texts = records(spark, folder, "article_texts")
    return texts.groupBy("article_id").agg(*(F.max(F.when(F.col("language") == c, F.col("heading"))).alias(f"heading_{c}") for c in _LANGUAGES), F.count(F.lit(1)).alias("n"))


def body_map(spark: SparkSession, folder: str) -> DataFrame:
    texts = records(spark, folder, "article_texts").where(F.col("language").isin(*_LANGUAGES)).groupBy("article_id", "language").agg(F.max("body").alias("body"))
    mapped = texts.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("language", "body"))).alias("m"))
    return mapped.select("article_id", *(F.length(F.col("m")[c]).cast("long").alias(f"n_{c}") for c in _LANGUAGES))


def language_alignment(spark: SparkSession, folder: str) -> DataFrame:
    texts = records(spark, folder, "article_texts").where(F.col("language").isin(*_LANGUAGES)).groupBy("article_id").pivot("language", list(_LANGUAGES)).agg(F.count(F.lit(1)))
    articles = records(spark, folder, "articles").select(F.col("id").alias("article_id"), "law_id", "article_number")
    aligned = articles.join(texts, "article_id", "left").groupBy("law_id", "article_number").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _LANGUAGES))
    return aligned


def usable_everywhere(spark: SparkSession, folder: str) -> DataFrame:
    good = records(spark, folder, "article_texts").where(F.col("language").isin(*_LANGUAGES) & (F.length("heading") > 6) & (F.length("body") > 200))
    return good.groupBy("article_id").agg(F.countDistinct("language").alias("languages")).where("languages = 3").select("article_id")


def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return L.missing_runs(records(spark, folder, "articles").where("deleted_at IS NULL").select("law_id", "ordinal").distinct(), "law_id", "ordinal")


def field_discovery(spark: SparkSession, folder: str) -> DataFrame:
    laws = records(spark, folder, "laws")
    columns = ["law_number", "origin", "status", "coverage", "gazette_ref"]
    long = laws.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.field", "x.value")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("value").rlike(r"\d{1,4}(bis|ter)?/\d{2,4}"), 1.0).otherwise(0.0)), 6).alias("share"))


def agreement_by_law(spark: SparkSession, folder: str) -> DataFrame:
    texts = records(spark, folder, "article_texts").join(records(spark, folder, "articles").select(F.col("id").alias("article_id"), "law_id"), "article_id")
    return texts.groupBy("law_id").agg(F.countDistinct("source").alias("n_sources"), (F.countDistinct("source") <= 1).alias("agree"), F.min("source").alias("first_source"))


def health_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = [records(spark, folder, t).agg(F.count(F.lit(1)).alias("n")) for t in ("laws", "articles", "article_texts")]
    return spark.range(1).select(*(c.scalar().alias(n) for c, n in zip(counts, ("laws", "articles", "texts"))))


def loadable_laws(spark: SparkSession, folder: str) -> DataFrame:
    laws = records(spark, folder, "laws")
    _, bad = loads.quarantine(laws, {"no number": F.col("law_number").rlike(r"\d/\d"), "no date": F.col("published_at").isNotNull(), "no reference": F.col("gazette_ref").isNotNull(), "deleted": F.col("deleted_at").isNull()})
    return bad.select("id", F.array_join("reasons", ",").alias("reasons"))


def source_lengths(spark: SparkSession, folder: str) -> DataFrame:
    texts = records(spark, folder, "article_texts")
    return texts.groupBy("source", "is_official").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("body"))).cast("long").alias("mean_chars"))


def vocabulary_size(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select("source", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-zà-ÿ]+"), F.lit(0))).alias("w"))
    return words.groupBy("source", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_tokens"))


def combo_histogram(spark: SparkSession, folder: str) -> DataFrame:
    combos = records(spark, folder, "article_texts").where(F.col("language").isin(*_LANGUAGES)).groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_set("language")), "+").alias("combo"))
    return combos.groupBy("combo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "combo").limit(8)


def sections_union(spark: SparkSession, folder: str) -> DataFrame:
    t = records(spark, folder, "article_texts")
    heads = t.where("heading IS NOT NULL").select("id", F.lit("heading").alias("kind"), F.length("heading").cast("long").alias("n"))
    return heads.unionByName(t.where("body IS NOT NULL").select("id", F.lit("body").alias("kind"), F.length("body").cast("long").alias("n")))


def floor_pairing(spark: SparkSession, folder: str) -> DataFrame:
    laws = records(spark, folder, "articles").select("law_id", "id", "ordinal")
    order = Window.partitionBy("law_id").orderBy("ordinal", "id")
    return laws.select("id", F.coalesce(F.lead("id").over(order), F.first("id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("other"))


def article_order(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("law_id").orderBy("article_number", "id")
    return records(spark, folder, "articles").select("id", F.row_number().over(order).alias("place"))


def newest_laws(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("origin").orderBy(F.desc_nulls_first("published_at"), "id")
    return records(spark, folder, "laws").withColumn("place", F.row_number().over(order)).where("place <= 3").select("origin", "place", "id")


def golden_diff(spark: SparkSession, folder: str) -> DataFrame:
    laws = records(spark, folder, "laws").select("id", "law_number", "status", "coverage")
    fresh = laws.where("status <> 'repealed' OR status IS NULL").withColumn("coverage", F.when(F.col("status") == "amended", F.lit("complete")).otherwise(F.col("coverage")))
    return loads.full_diff(laws, fresh, "id")


def upsert_coalesce_laws(spark: SparkSession, folder: str) -> DataFrame:
    laws = records(spark, folder, "laws").select("id", "law_number", "gazette_ref", "coverage")
    incoming = laws.where("coverage = 'partial'").select("id", "law_number", F.lit(None).cast("string").alias("gazette_ref"), F.lit("complete").alias("coverage"))
    return loads.upsert_coalesce(laws, incoming, ["id"])


def upsert_newest(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    old, new = o.where("o_orderdate < '1998-01-01'"), o.where("o_orderdate >= '1998-01-01'")
    current = old.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return loads.upsert(current, new.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


def insert_ignore_edges(spark: SparkSession, folder: str) -> DataFrame:
    c = records(spark, folder, "case_statute_citations")
    early, late = c.where("created_at < '2021-01-01'"), c.where("created_at >= '2021-01-01'")
    keys = ["case_id", "law_number", "article_number"]
    return loads.insert_ignore(early.select(*keys).distinct(), late.select(*keys), keys).groupBy("law_number").agg(F.count(F.lit(1)).alias("n_edges"))


def cascade_delete_laws(spark: SparkSession, folder: str) -> DataFrame:
    laws, articles = records(spark, folder, "laws"), records(spark, folder, "articles")
    kept, (articles_kept,) = loads.cascade_delete(laws, [(articles, "law_id")], "id", F.col("coverage") == "partial")
    return kept.join(articles_kept.withColumnRenamed("id", "a_id"), kept["id"] == articles_kept["law_id"], "left").groupBy(kept["id"].alias("law_id")).agg(F.count("a_id").alias("n_articles"))


def replaced_edges(spark: SparkSession, folder: str) -> DataFrame:
    c = records(spark, folder, "case_statute_citations").select("case_id", "law_number", "created_at")
    fresh = c.where("created_at >= '2024-01-01'")
    return loads.replace_edges(c, fresh, "case_id").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def soft_deleted_counts(spark: SparkSession, folder: str) -> DataFrame:
    articles = loads.soft_delete(records(spark, folder, "articles"), F.col("article_number").contains("bis"), F.lit("2025-01-01").cast("timestamp"))
    return articles.groupBy("law_id").agg(F.count("deleted_at").alias("n_deleted"), F.count_if(F.col("deleted_at").isNull()).alias("n_visible"))


def case_tree(spark: SparkSession, folder: str) -> DataFrame:
    cases = records(spark, folder, "cases").select("id", "case_number", "court")
    tree = paging.nest(cases, records(spark, folder, "case_statute_citations").select("case_id", "law_number", "article_number"), "id", "case_id", "citations", ["law_number", "article_number"])
    return tree.select("id", "case_number", F.size("citations").cast("long").alias("n_citations"), F.size(F.array_distinct(F.transform("citations", lambda c: c["law_number"]))).cast("long").alias("n_laws"))


def order_tree(spark: SparkSession, folder: str) -> DataFrame:
    orders, items = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    tree = paging.nest(orders.select("o_orderkey", "o_custkey"), items.select("l_orderkey", "l_linenumber", "l_partkey"), "o_orderkey", "l_orderkey", "items", ["l_linenumber", "l_partkey"])
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return tree.join(customers, "o_custkey", "left").select("o_orderkey", "c_name", F.size("items").cast("long").alias("n_items"))


def page_ilike(spark: SparkSession, folder: str) -> DataFrame:
    found = paging.matching(table(spark, folder, "customer"), [F.col("c_name").ilike("%1%"), F.col("c_acctbal") > 0, None])
    return paging.page(found, [F.desc("c_acctbal"), F.asc("c_custkey")], 2, 50).select("c_custkey", "c_name")


def page_totals(spark: SparkSession, folder: str) -> DataFrame:
    return paging.page_totals(table(spark, folder, "customer").where(F.col("c_name").ilike("%1%")), 2, 50)


def dashboard_pct(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive"))
    return by.select("c_mktsegment", "n", paging.whole_percent(F.col("positive"), F.col("n")).alias("percent"))


def role_names(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left")
    return table(spark, folder, "supplier").join(named, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


def last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))


def dry_run_end(spark: SparkSession, folder: str) -> DataFrame:
    return L.dry_run_end(table(spark, folder, "events"), "user_id", "event_id", F.col("event_type") == "click")


def every_nth(spark: SparkSession, folder: str) -> DataFrame:
    numbered = paging.numbered(table(spark, folder, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey")
    return numbered.where((F.col("n") - 1) % 7 == 0).select("o_orderkey")


def audit_stats_30d(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    now = events.agg(F.max("ts"))
    recent = events.where(F.col("ts") > now.scalar() - F.expr("INTERVAL 30 DAYS"))
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_large"), F.round(F.avg("value"), 1).alias("mean"))


def audit_json_nonserved(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.where(~F.col("k").isin(0, 1, 2)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def rate_limit_window(spark: SparkSession, folder: str) -> DataFrame:
    counted = table(spark, folder, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 2").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def rolling_30d(spark: SparkSession, folder: str) -> DataFrame:
    daily = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("event_type").orderBy(F.unix_date("day")).rangeBetween(-29, 0)
    return daily.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.sum("n").over(window).alias("n_30d"))


def age_buckets(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    now = events.agg(F.max("ts").cast("timestamp"))
    return events.groupBy(D.age_bucket(F.col("ts").cast("timestamp"), now.scalar()).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def law_ages(spark: SparkSession, folder: str) -> DataFrame:
    laws = records(spark, folder, "laws")
    return laws.select("id", F.date_format(D.effective_date(F.col("coverage") == "complete", F.col("published_at"), F.col("effective_from")), "yyyy-MM-dd").alias("effective"), F.date_format(D.expiry(F.col("created_at"), F.lit(400)), "yyyy-MM-dd").alias("expires"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    sessions = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


_NAMES = (
    statute_reach, law_reliance, partial_law_rollup, cited_laws_known, heading_pivot, body_map, language_alignment, usable_everywhere, coverage_gaps, field_discovery, agreement_by_law, health_counts, loadable_laws,
    source_lengths, vocabulary_size, combo_histogram, sections_union, floor_pairing, article_order, newest_laws, golden_diff, upsert_coalesce_laws, upsert_newest, insert_ignore_edges, cascade_delete_laws, replaced_edges,
    soft_deleted_counts, case_tree, order_tree, page_ilike, page_totals, dashboard_pct, role_names, last_wins, dry_run_end, every_nth, audit_stats_30d, audit_json_nonserved, rate_limit_window, rolling_30d, age_buckets,
    law_ages, event_sessions, pricing_summary,
)
QUERIES = {f.__name__: f for f in _NAMES}
_KEY = r"regexp_replace(regexp_replace(lower(law_number), '[\s\p{Z}.]+', '', 'g'), '^[^0-9]*0*([0-9]+[a-z]*/[0-9]+[a-z]*)[^a-z0-9]*$', '\1')"
_C = "(SELECT DISTINCT * FROM case_statute_citations)"
_L = "(SELECT DISTINCT * FROM laws)"
_A = "(SELECT DISTINCT * FROM articles)"
_T = f"(SELECT DISTINCT * REPLACE ({label_sql('language')} AS language) FROM article_texts)"
_MISSING = """SELECT law_id, n - row_number() OVER (PARTITION BY law_id ORDER BY n) AS island, n FROM (SELECT law_id, unnest(range(1, max(ordinal) + 1)) AS n FROM a GROUP BY law_id) x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.law_id = x.law_id AND a.ordinal = x.n)"""
ORACLES = {
    "statute_reach": f"SELECT count(*) AS total, count(*) FILTER (WHERE {_KEY} IN (SELECT {_KEY} FROM laws)) AS resolved FROM {_C} WHERE law_number IS NOT NULL",
    "law_reliance": f"SELECT {_KEY} AS law, count(DISTINCT case_id) AS n_cases, count(*) AS n_citations FROM {_C} WHERE law_number IS NOT NULL GROUP BY 1",
    "partial_law_rollup": f"SELECT l.id AS law_id, l.law_number, count(DISTINCT a.id) AS articles, count(t.id) AS texts FROM {_L} l LEFT JOIN {_A} a ON a.law_id = l.id LEFT JOIN {_T} t ON t.article_id = a.id WHERE l.coverage = 'partial' GROUP BY l.id, l.law_number",
    "cited_laws_known": f"SELECT law, CASE WHEN law IN (SELECT {_KEY} FROM laws WHERE deleted_at IS NULL) THEN 'present' ELSE 'missing' END AS state FROM (SELECT DISTINCT {_KEY} AS law FROM case_statute_citations WHERE law_number IS NOT NULL)",
    "heading_pivot": f"SELECT article_id, max(heading) FILTER (WHERE language = 'rw') AS heading_rw, max(heading) FILTER (WHERE language = 'en') AS heading_en, max(heading) FILTER (WHERE language = 'fr') AS heading_fr, count(*) AS n FROM {_T} GROUP BY article_id",
    "body_map": f"SELECT article_id, length(max(body) FILTER (WHERE language = 'rw')) AS n_rw, length(max(body) FILTER (WHERE language = 'en')) AS n_en, length(max(body) FILTER (WHERE language = 'fr')) AS n_fr FROM {_T} WHERE language IN ('rw', 'en', 'fr') GROUP BY article_id",
    "language_alignment": f"SELECT law_id, article_number, count(t.id) FILTER (WHERE language = 'rw') AS rw, count(t.id) FILTER (WHERE language = 'en') AS en, count(t.id) FILTER (WHERE language = 'fr') AS fr FROM {_A} a LEFT JOIN {_T} t ON t.article_id = a.id GROUP BY law_id, article_number",
    "usable_everywhere": f"SELECT article_id FROM {_T} WHERE language IN ('rw', 'en', 'fr') AND length(heading) > 6 AND length(body) > 200 GROUP BY article_id HAVING count(DISTINCT language) = 3",
    "coverage_gaps": f"WITH a AS (SELECT DISTINCT law_id, ordinal FROM articles WHERE deleted_at IS NULL), m AS ({_MISSING}), r AS (SELECT law_id, min(n) AS f, max(n) AS t, count(*) AS size FROM m GROUP BY law_id, island) SELECT l.law_id, coalesce(sum(size), 0)::BIGINT AS n_missing, coalesce(string_agg(CASE WHEN f = t THEN f::VARCHAR ELSE f || '-' || t END, ', ' ORDER BY f), '') AS missing FROM (SELECT DISTINCT law_id FROM a) l LEFT JOIN r ON r.law_id = l.law_id GROUP BY l.law_id",
    "field_discovery": f"SELECT field, count(*) AS n, round(avg(CASE WHEN regexp_matches(value, '\\d{{1,4}}(bis|ter)?/\\d{{2,4}}') THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT unnest(['law_number', 'origin', 'status', 'coverage', 'gazette_ref']) AS field, unnest([law_number, origin, status, coverage, gazette_ref]) AS value FROM {_L}) GROUP BY field",
    "agreement_by_law": f"SELECT law_id, count(DISTINCT source) AS n_sources, count(DISTINCT source) <= 1 AS agree, min(source) AS first_source FROM {_T} t JOIN {_A} a ON t.article_id = a.id GROUP BY law_id",
    "health_counts": f"SELECT (SELECT count(*) FROM {_L}) AS laws, (SELECT count(*) FROM {_A}) AS articles, (SELECT count(*) FROM {_T}) AS texts",
    "loadable_laws": f"SELECT id, concat_ws(',', CASE WHEN NOT coalesce(regexp_matches(law_number, '\\d/\\d'), false) THEN 'no number' END, CASE WHEN published_at IS NULL THEN 'no date' END, CASE WHEN gazette_ref IS NULL THEN 'no reference' END, CASE WHEN deleted_at IS NOT NULL THEN 'deleted' END) AS reasons FROM {_L} WHERE NOT coalesce(regexp_matches(law_number, '\\d/\\d'), false) OR published_at IS NULL OR gazette_ref IS NULL OR deleted_at IS NOT NULL",
    "source_lengths": f"SELECT source, is_official, count(*) AS n, round(avg(length(body)))::BIGINT AS mean_chars FROM {_T} GROUP BY ALL",
    "vocabulary_size": "SELECT source, count(DISTINCT w) AS n_words, count(*) AS n_tokens FROM (SELECT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]+')) AS w FROM documents) GROUP BY source",
    "combo_histogram": f"SELECT combo, count(*) AS n FROM (SELECT article_id, string_agg(DISTINCT language, '+' ORDER BY language) AS combo FROM {_T} WHERE language IN ('rw', 'en', 'fr') GROUP BY article_id) GROUP BY combo ORDER BY n DESC, combo LIMIT 8",
    "sections_union": f"SELECT id, 'heading' AS kind, length(heading) AS n FROM {_T} WHERE heading IS NOT NULL UNION ALL SELECT id, 'body' AS kind, length(body) AS n FROM {_T} WHERE body IS NOT NULL",
    "floor_pairing": f"SELECT id, coalesce(lead(id) OVER w, first(id) OVER (PARTITION BY law_id ORDER BY ordinal, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM {_A} WINDOW w AS (PARTITION BY law_id ORDER BY ordinal, id)",
    "article_order": f"SELECT id, row_number() OVER (PARTITION BY law_id ORDER BY article_number, id) AS place FROM {_A}",
    "newest_laws": f"SELECT origin, place, id FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY published_at DESC NULLS FIRST, id) AS place FROM {_L}) WHERE place <= 3",
    "golden_diff": f"SELECT id, CASE WHEN status = 'repealed' THEN 'missing' ELSE 'changed' END AS change, CASE WHEN status = 'repealed' THEN '' ELSE 'coverage' END AS columns FROM {_L} WHERE status = 'repealed' OR status = 'amended' AND coverage IS DISTINCT FROM 'complete'",
    "upsert_coalesce_laws": f"SELECT id, law_number, gazette_ref, CASE WHEN coverage = 'partial' THEN 'complete' ELSE coverage END AS coverage FROM {_L}",
    "upsert_newest": "SELECT o_custkey, coalesce(max(o_orderkey) FILTER (WHERE o_orderdate >= '1998-01-01'), max(o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
    "insert_ignore_edges": "SELECT law_number, count(*) AS n_edges FROM (SELECT DISTINCT case_id, law_number, article_number FROM case_statute_citations) GROUP BY law_number",
    "cascade_delete_laws": f"SELECT l.id AS law_id, count(a.id) AS n_articles FROM {_L} l LEFT JOIN {_A} a ON a.law_id = l.id WHERE l.coverage IS DISTINCT FROM 'partial' GROUP BY l.id",
    "replaced_edges": f"WITH f AS (SELECT DISTINCT case_id FROM case_statute_citations WHERE created_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00') SELECT case_id, count(*) AS n FROM {_C} c WHERE case_id NOT IN (SELECT case_id FROM f) OR created_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00' GROUP BY case_id",
    "soft_deleted_counts": f"SELECT law_id, count(*) FILTER (WHERE deleted_at IS NOT NULL OR contains(article_number, 'bis')) AS n_deleted, count(*) FILTER (WHERE NOT (deleted_at IS NOT NULL OR coalesce(contains(article_number, 'bis'), false))) AS n_visible FROM {_A} GROUP BY law_id",
    "case_tree": f"SELECT k.id, k.case_number, count(c.id) AS n_citations, count(DISTINCT coalesce(c.law_number, '~')) FILTER (WHERE c.id IS NOT NULL) AS n_laws FROM (SELECT DISTINCT id, case_number FROM cases) k LEFT JOIN {_C} c ON c.case_id = k.id GROUP BY k.id, k.case_number",
    "order_tree": "SELECT o_orderkey, c_name, count(l_orderkey) AS n_items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey, c_name",
    "page_ilike": "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%1%' AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 50",
    "page_totals": "SELECT count(*) AS total, ceil(count(*) / 50.0)::BIGINT AS pages, 2 < ceil(count(*) / 50.0) AS has_next, true AS has_previous FROM customer WHERE c_name ILIKE '%1%'",
    "dashboard_pct": "SELECT c_mktsegment, count(*) AS n, floor(100.0 * count(*) FILTER (WHERE c_acctbal > 0) / count(*) + 0.5)::BIGINT AS percent FROM customer GROUP BY c_mktsegment",
    "role_names": "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "last_wins": "SELECT o_custkey, max(o_orderkey) AS last_order, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey",
    "dry_run_end": "SELECT user_id, min(event_id) FILTER (WHERE d = 2) AS ended_at FROM (SELECT user_id, event_id, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS d FROM events) GROUP BY user_id",
    "every_nth": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE (n - 1) % 7 = 0",
    "audit_stats_30d": "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_large, round(avg(value), 1) AS mean FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAYS GROUP BY event_type",
    "audit_json_nonserved": "SELECT event_type, count(*) AS n FROM events WHERE json_extract_string(props, '$.k')::INT NOT IN (0, 1, 2) GROUP BY event_type",
    "rate_limit_window": "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2",
    "rolling_30d": "WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)::BIGINT AS n_30d FROM d",
    "age_buckets": "SELECT CASE WHEN a <= 1 THEN 'today' WHEN a <= 7 THEN 'week' WHEN a <= 30 THEN 'month' ELSE 'older' END AS bucket, count(*) AS n FROM (SELECT ceil((epoch_ms((SELECT max(ts) FROM events)) - epoch_ms(ts)) / 86400000.0) AS a FROM events) GROUP BY 1",
    "law_ages": f"SELECT id, strftime((CASE WHEN coverage = 'complete' THEN published_at ELSE coalesce(published_at, effective_from) END) AT TIME ZONE 'UTC', '%Y-%m-%d') AS effective, strftime((created_at + INTERVAL 365 DAYS) AT TIME ZONE 'UTC', '%Y-%m-%d') AS expires FROM {_L}",
    "event_sessions": "WITH s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL",
}
