"""Queries of the orphan reference operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataquill.operators.orphans import orphan_counts, orphan_references
from strataquill.sources.tables import table


_TABLES = ("case_statute_citations", "laws", "articles")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(*(table(spark, folder, t) for t in _TABLES)).drop("month")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(*(table(spark, folder, t) for t in _TABLES))


_STATE = r"""
WITH l AS (SELECT DISTINCT id, regexp_replace(regexp_replace(lower(law_number), '[\s\p{Z}.]+', '', 'g'), '^[^0-9]*0*([0-9]+[a-z]*/[0-9]+[a-z]*)[^a-z0-9]*$', '\1') AS law, created_at, deleted_at FROM laws),
a AS (SELECT DISTINCT x.id, l.law, nullif(regexp_replace(regexp_replace(lower(x.article_number), '[\s\p{Z}.]+', '', 'g'), '^[^0-9]*0*([0-9]+[a-z]*)[^a-z0-9]*$', '\1'), '') AS article, x.created_at, x.deleted_at FROM articles x JOIN l ON x.law_id = l.id),
ls AS (SELECT law, count(*) AS n, count(*) FILTER (WHERE deleted_at IS NULL) AS live, min(created_at) FILTER (WHERE deleted_at IS NULL) AS first FROM l GROUP BY law),
s AS (SELECT law, article, count(*) AS n, count(*) FILTER (WHERE deleted_at IS NULL) AS live, min(created_at) FILTER (WHERE deleted_at IS NULL) AS first FROM a GROUP BY law, article),
c AS (SELECT DISTINCT id, created_at, regexp_replace(regexp_replace(lower(law_number), '[\s\p{Z}.]+', '', 'g'), '^[^0-9]*0*([0-9]+[a-z]*/[0-9]+[a-z]*)[^a-z0-9]*$', '\1') AS law, nullif(regexp_replace(regexp_replace(lower(article_number), '[\s\p{Z}.]+', '', 'g'), '^[^0-9]*0*([0-9]+[a-z]*)[^a-z0-9]*$', '\1'), '') AS article FROM case_statute_citations WHERE law_number IS NOT NULL),
f AS (SELECT c.id AS citation_id, date_trunc('month', c.created_at) AS month,
  CASE WHEN ls.first IS NULL OR ls.first > c.created_at THEN 'laws' WHEN c.article IS NOT NULL AND (s.first IS NULL OR s.first > c.created_at) THEN 'articles' END AS target,
  CASE WHEN ls.n IS NULL THEN 'missing' WHEN ls.live = 0 THEN 'deleted' ELSE 'late' END AS lr,
  CASE WHEN s.n IS NULL THEN 'missing' WHEN s.live = 0 THEN 'deleted' ELSE 'late' END AS ar
  FROM c LEFT JOIN ls ON c.law = ls.law LEFT JOIN s ON c.law = s.law AND c.article = s.article)
"""
_FOUND = "SELECT citation_id, target, CASE target WHEN 'laws' THEN lr ELSE ar END AS reason{0} FROM f WHERE target IS NOT NULL"

QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
ORACLES = {
    "p3_found": _STATE + _FOUND.format(""),
    "p3_report": _STATE + "SELECT target, reason, month, count(*) AS n_orphans FROM (" + _FOUND.format(", month") + ") GROUP BY target, reason, month",
}
