"""Lookups, reconciliations and roll-ups over rankings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataquill.functions import text as T
from strataquill.functions.keys import article_key, law_key
from strataquill.functions.labels import label_sql
from strataquill.operators import retrieval as R
from strataquill.operators.lines import column_bands
from strataquill.operators.paging import numbered
from strataquill.operators.parsing import peak_ratio
from strataquill.operators.skew import hot_key_join
from strataquill.plans.retrieval_queries import _DOCS, _ITEMS, _bm25, _documents, _items, _words
from strataquill.sources.tables import records, table

_LANGUAGES = ("rw", "en", "fr")


def cited_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Every citation with the English heading it leads to, whatever the status of the law."""
    laws = records(spark, folder, "laws").select(F.col("id").alias("law_id"), law_key("law_number").alias("law"))
    articles = records(spark, folder, "articles").select(F.col("id").alias("article_id"), "law_id", article_key("article_number").alias("article"))
    texts = records(spark, folder, "article_texts").where("language = 'en'").select("article_id", "heading")
    named = laws.join(articles, "law_id").join(texts, "article_id").groupBy("law", "article").agg(F.min("heading").alias("heading"))
    cited = records(spark, folder, "case_statute_citations").select("id", law_key("law_number").alias("law"), article_key("article_number").alias("article")).where("law IS NOT NULL AND article IS NOT NULL")
    return hot_key_join(cited, named, ["law", "article"]).select("id", "heading")


def visible_articles(spark: SparkSession, folder: str) -> DataFrame:
    laws = records(spark, folder, "laws").where("deleted_at IS NULL").select(F.col("id").alias("law_id"), "law_number")
    articles = records(spark, folder, "articles").where("deleted_at IS NULL")
    return articles.join(laws, "law_id", "left").groupBy("law_id", "law_number").agg(F.count(F.lit(1)).alias("n"))


def numeric_article_order(spark: SparkSession, folder: str) -> DataFrame:
    numbers = records(spark, folder, "articles").where(~F.col("article_number").contains(" ")).groupBy("law_id").agg(F.collect_set("article_number").alias("n"))
    return numbers.select("law_id", F.array_join(T.numeric_order("n"), ",").alias("numbers"))


def languages_reconciled(spark: SparkSession, folder: str) -> DataFrame:
    texts = records(spark, folder, "article_texts").join(records(spark, folder, "articles").select(F.col("id").alias("article_id"), "law_id", "article_number"), "article_id")
    held = texts.groupBy("law_id").agg(*(F.collect_set(F.when(F.col("language") == c, F.col("article_number"))).alias(c) for c in _LANGUAGES))
    gap = lambda a, b: F.size(F.array_except(a, b)).cast("long")
    return held.select("law_id", gap("rw", "en").alias("rw_only"), gap("en", "fr").alias("en_not_fr"), F.size(F.array_union(F.array_union("rw", "en"), "fr")).cast("long").alias("all_numbers"), F.size(F.array_intersect("rw", "fr")).cast("long").alias("rw_and_fr"))


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    laws = records(spark, folder, "laws").select(law_key("law_number").alias("law"), "status", "created_at")
    per = laws.groupBy("law").agg(F.countDistinct("status").alias("n_statuses"), F.min_by("status", F.struct("created_at", "status")).alias("first"))
    return per.groupBy("first").agg(F.count(F.lit(1)).alias("n_laws"), F.count_if(F.col("n_statuses") > 1).alias("conflicting"))


def severity_ranked(spark: SparkSession, folder: str) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, ("repealed", "amended", "active"))), F.col("status"))
    place = Window.partitionBy("origin").orderBy(order, "id")
    return records(spark, folder, "laws").select("id", F.row_number().over(place).alias("place"))


def audit_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Each citation as JSON with its place among those of its case: no case is gathered in one cell."""
    cited = records(spark, folder, "case_statute_citations").where("law_number IS NOT NULL").select("case_id", "id", "law_number", "article_number")
    placed = numbered(cited, "case_id", "id", "place")
    return placed.select("case_id", "id", F.col("place").cast("long").alias("place"), F.to_json(F.struct(F.col("law_number").alias("law"), F.coalesce("article_number", F.lit("")).alias("article"))).alias("cited"))


def best_per_source(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "source")
    top = R.search(_documents(spark, folder), _items(spark, folder), 10, T.word_tokens)
    return top.join(docs, "doc").groupBy("q", "source").agg(F.max("score").alias("score"))


def peak_ratios(spark: SparkSession, folder: str) -> DataFrame:
    top = R.search(_documents(spark, folder), _items(spark, folder), 10, T.word_tokens)
    return peak_ratio(top).select("q", F.round("ratio", 6).alias("ratio"))


def mixed_index(spark: SparkSession, folder: str) -> DataFrame:
    """Top documents when all languages share one index."""
    docs = _documents(spark, folder).withColumn("language", F.lit("all"))
    return R.search(docs, _items(spark, folder).withColumn("language", F.lit("all")), 3, T.word_tokens).select("q", "doc", "score", "rank")


def label_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean inner product of unit vectors between labels, from one mean vector a label."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    unit = F.transform("embedding", lambda x: x.cast("double") / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))))
    parts = e.select("label", F.posexplode(unit).alias("axis", "x")).groupBy("label", "axis").agg(F.avg("x").alias("x"))
    other = parts.select(F.col("label").alias("other"), "axis", F.col("x").alias("y"))
    return parts.join(other, "axis").groupBy("label", "other").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("mean"))


def duplicate_uploads(spark: SparkSession, folder: str) -> DataFrame:
    uploads = table(spark, folder, "uploaded_documents").select("id", "filename", "content").dropDuplicates(["id"])
    return uploads.groupBy(T.digest12("content").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")


def item_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of an order as items on pages, in three bands of equal width."""
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_extendedprice").cast("double").alias("x"))
    return column_bands(items, 3).groupBy("doc", "page", "band").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 2).alias("first"))


_NAMES = (item_bands, cited_headings, visible_articles, numeric_article_order, languages_reconciled, status_counts, severity_ranked, audit_projection, best_per_source, peak_ratios, mixed_index, label_similarity, duplicate_uploads)
QUERIES = {f.__name__: f for f in _NAMES}
_LAW = r"regexp_replace(regexp_replace(lower(law_number), '[\s\p{Z}.]+', '', 'g'), '^[^0-9]*0*([0-9]+[a-z]*/[0-9]+[a-z]*)[^a-z0-9]*$', '\1')"
_ARTICLE = r"nullif(regexp_replace(regexp_replace(lower(article_number), '[\s\p{Z}.]+', '', 'g'), '^[^0-9]*0*([0-9]+[a-z]*)[^a-z0-9]*$', '\1'), '')"
_ALL_DOCS = "SELECT 'all' AS language, doc_id AS doc, text FROM documents"
_ALL_ITEMS = _ITEMS.replace("language,", "'all' AS language,")
ORACLES = {
    "item_bands": "WITH i AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS page, l_extendedprice::DOUBLE AS x FROM lineitem), b AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM i WINDOW w AS (PARTITION BY doc, page)) SELECT doc, page, CASE WHEN hi > lo THEN least(2, floor((x - lo) / ((hi - lo) / 3)))::INT ELSE 0 END AS band, count(*) AS n, round(min(x), 2) AS first FROM b GROUP BY ALL",
    "cited_headings": f"WITH n AS (SELECT law, article, min(heading) AS heading FROM (SELECT DISTINCT id, {_LAW} AS law FROM laws) l JOIN (SELECT DISTINCT id, law_id, {_ARTICLE} AS article FROM articles) a ON a.law_id = l.id JOIN (SELECT DISTINCT article_id, id, heading FROM article_texts WHERE {label_sql('language')} = 'en') t ON t.article_id = a.id GROUP BY law, article) SELECT c.id, n.heading FROM (SELECT DISTINCT id, {_LAW} AS law, {_ARTICLE} AS article FROM case_statute_citations) c JOIN n ON n.law = c.law AND n.article = c.article",
    "visible_articles": "SELECT a.law_id, l.law_number, count(*) AS n FROM (SELECT DISTINCT * FROM articles WHERE deleted_at IS NULL) a LEFT JOIN (SELECT DISTINCT * FROM laws WHERE deleted_at IS NULL) l ON l.id = a.law_id GROUP BY ALL",
    "numeric_article_order": "SELECT law_id, string_agg(n::VARCHAR, ',' ORDER BY n) AS numbers FROM (SELECT DISTINCT law_id, article_number::INT AS n FROM articles WHERE NOT contains(article_number, ' ')) GROUP BY law_id",
    "languages_reconciled": "WITH t AS (SELECT DISTINCT a.law_id, a.article_number AS n, " + label_sql("t.language") + """ AS language FROM article_texts t JOIN articles a ON a.id = t.article_id), p AS (SELECT law_id, n, bool_or(language = 'rw') AS rw, bool_or(language = 'en') AS en, bool_or(language = 'fr') AS fr FROM (SELECT law_id, n, coalesce(language, '') AS language FROM t) GROUP BY law_id, n)
 SELECT law_id, count(*) FILTER (WHERE rw AND NOT en) AS rw_only, count(*) FILTER (WHERE en AND NOT fr) AS en_not_fr, count(*) FILTER (WHERE rw OR en OR fr) AS all_numbers, count(*) FILTER (WHERE rw AND fr) AS rw_and_fr FROM p GROUP BY law_id""",
    "status_counts": f"WITH p AS (SELECT law, count(DISTINCT status) AS k, first(status ORDER BY created_at, status) AS first FROM (SELECT DISTINCT id, {_LAW} AS law, status, created_at FROM laws) GROUP BY law) SELECT first, count(*) AS n_laws, count(*) FILTER (WHERE k > 1) AS conflicting FROM p GROUP BY first",
    "severity_ranked": "SELECT id, row_number() OVER (PARTITION BY origin ORDER BY CASE status WHEN 'repealed' THEN 1 WHEN 'amended' THEN 2 WHEN 'active' THEN 3 ELSE 0 END, id) AS place FROM (SELECT DISTINCT * FROM laws)",
    "audit_projection": "SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY id) AS place, to_json({'law': law_number, 'article': coalesce(article_number, '')})::VARCHAR AS cited FROM (SELECT DISTINCT * FROM case_statute_citations) WHERE law_number IS NOT NULL",
    "best_per_source": f"WITH {_bm25(_DOCS, _ITEMS, _words, 10)} SELECT q, source, max(score) AS score FROM top JOIN documents ON doc_id = doc GROUP BY q, source",
    "peak_ratios": f"WITH {_bm25(_DOCS, _ITEMS, _words, 10)}, pk AS (SELECT q, max(score) FILTER (WHERE rank = 1) AS t, coalesce(avg(score) FILTER (WHERE rank BETWEEN 2 AND 10), 0) AS r FROM top GROUP BY q) SELECT q, round(CASE WHEN r > 0 THEN t / r WHEN t > 0 THEN 99 ELSE 0 END, 6) AS ratio FROM pk",
    "mixed_index": f"WITH {_bm25(_ALL_DOCS, _ALL_ITEMS, _words, 3)} SELECT q, doc, score, rank FROM top",
    "label_similarity": "WITH u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings) SELECT a.label, b.label AS other, round(avg(list_dot_product(a.v, b.v)), 6) AS mean FROM u a JOIN u b ON true GROUP BY a.label, b.label",
    "duplicate_uploads": "SELECT left(sha256(content), 12) AS digest, count(*) AS n, min(id) AS first FROM (SELECT DISTINCT id, content FROM uploaded_documents) GROUP BY digest HAVING count(*) > 1",
}
