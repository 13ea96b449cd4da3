"""Retrieval and evaluation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import text as T
from strataquill.operators import evaluation as E
from strataquill.operators import retrieval as R
from strataquill.functions.labels import label_language, label_sql
from strataquill.session import checkpoint
from strataquill.sources.tables import records, table

_AS_OF = "2015-01-01"
_LANGUAGES = ("rw", "en", "fr")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", spread=True)
    return d.select(F.coalesce(label_language("lang"), F.lit("und")).alias("language"), F.col("doc_id").alias("doc"), "text")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("q"), "language", "text")


def _served(spark: SparkSession, folder: str) -> DataFrame:
    return R.served_corpus(*(records(spark, folder, t) for t in ("article_texts", "articles", "laws")))


def _served_texts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("body", F.lit("")))
    return _served(spark, folder).where(F.col("language").isin(*_LANGUAGES)).select("language", F.col("id").alias("doc"), text.alias("text"))


def _floors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("rw", 120.0), ("en", 150.0), ("fr", 150.0)], "language string, floor double")


def char_ngrams_tf(spark: SparkSession, folder: str) -> DataFrame:
    grams = _documents(spark, folder).select("language", F.explode(T.char_ngrams("text")).alias("term"))
    return grams.groupBy("language", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index_terms(spark: SparkSession, folder: str) -> DataFrame:
    return R.build_index(_documents(spark, folder)).terms().select("language", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_index_docs(spark: SparkSession, folder: str) -> DataFrame:
    index = R.build_index(_documents(spark, folder))
    return index.docs.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("n_terms"), F.round(F.avg("dl"), 6).alias("avgdl"))


def bm25_char_topk(spark: SparkSession, folder: str) -> DataFrame:
    return R.search(_documents(spark, folder), _items(spark, folder)).select("q", "doc", "score", "rank")


def bm25_word_topk(spark: SparkSession, folder: str) -> DataFrame:
    return R.search(_documents(spark, folder), _items(spark, folder), tokenizer=T.word_tokens).select("q", "doc", "score", "rank")


def served_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _served(spark, folder).select("id", "law_number", "article_number", "ordinal", "language", "status", F.length("body").cast("long").alias("n_chars"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    hits = R.search(_served_texts(spark, folder), _items(spark, folder))
    return R.ask(hits, _served(spark, folder), _floors(spark), F.lit(_AS_OF).cast("timestamp"))


def ask_shortlist(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).where("kept").select("q", F.col("doc").alias("text_id"), "law_number", "article_number", "score", "rank", F.date_format("effective_from", "yyyy-MM-dd").alias("effective_from"))


def ask_limitations(spark: SparkSession, folder: str) -> DataFrame:
    return R.limitations(_asked(spark, folder))


def unanswered_guard(spark: SparkSession, folder: str) -> DataFrame:
    best = R.search(_served_texts(spark, folder), _items(spark, folder), 1)
    above = best.join(F.broadcast(_floors(spark)), "language").where("score >= floor").select("q")
    return _items(spark, folder).join(above, "q", "left_anti").select("q", "language")


def corpus_shape(spark: SparkSession, folder: str) -> DataFrame:
    return _served(spark, folder).groupBy("law_number", "language").agg(F.count(F.lit(1)).alias("texts"))


def corpus_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    shape = corpus_shape(spark, folder).where(F.col("language").isin(*_LANGUAGES))
    order = F.struct("law_number", F.array_position(F.array(*map(F.lit, _LANGUAGES)), F.col("language")).alias("at"), F.concat_ws(":", "law_number", "language", F.col("texts").cast("string")).alias("text"))
    # One short line per law and language: each law is folded on its own, and the laws' digests again.
    per_law = shape.groupBy("law_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["text"]), "|").alias("shape"), F.sum("texts").alias("texts"))
    return per_law.select("law_number", "texts", T.fnv1a("shape").alias("fingerprint"))


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = _documents(spark, folder), _items(spark, folder)
    fused = R.fuse(R.search(docs, items, 10), R.search(docs, items, 10, T.word_tokens))
    return R.top_k(fused, 5, 9).select("q", "doc", F.round("score", 9).alias("score"), "rank")


def _headed(spark: SparkSession, folder: str) -> DataFrame:
    # Redelivered rows are equal, so the lengths are asked before any text is shuffled.
    long = table(spark, folder, "article_texts").where((F.length("heading") > 6) & (F.length("body") > 200))
    texts = long.withColumn("language", label_language("language")).where(F.col("language").isin(*_LANGUAGES))
    return R.served_corpus(texts, *(records(spark, folder, t) for t in ("articles", "laws")))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """The served texts with their heading as the question they answer."""
    return _headed(spark, folder).select(F.col("id").alias("q"), "language", F.col("heading").alias("question"), F.col("body").alias("text"))


def _heading_ranks(spark: SparkSession, folder: str, tokenizer) -> DataFrame:
    return R.own_ranks(checkpoint(_questions(spark, folder)), 5, tokenizer)  # joined once, read several times


def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return E.recall_at(_heading_ranks(spark, folder, T.char_ngrams))


def tokenizer_mcnemar(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (_heading_ranks(spark, folder, t).where("rank = 1").select("q") for t in (T.char_ngrams, T.word_tokens))
    return E.mcnemar(a, b).withColumn("p", F.round("p", 6))


def _contained(spark: SparkSession, folder: str) -> DataFrame:
    """Best score of each item, and whether the document of that score holds it word for word."""
    docs, items = _documents(spark, folder), _items(spark, folder)
    whole = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", "")
    best = R.search(docs, items, 1).join(items.select("q", whole.alias("t")), "q").join(docs.select("doc", whole.alias("d")), "doc")
    return best.select("language", "q", "score", F.contains("d", F.col("t")).alias("signal"))


def best_cut_floor(spark: SparkSession, folder: str) -> DataFrame:
    return E.best_cut(_contained(spark, folder)).select("language", "cut", F.round("value", 6).alias("value"))


def noise_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    noise = _contained(spark, folder).where("NOT signal")
    return noise.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("peak"), F.round(F.avg("score"), 6).alias("mean"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")
    return e.where(F.col("doc") % 100 == 0).select(F.col("doc").alias("q"), "vector", "label"), e


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    queries, vectors = _vectors(spark, folder)
    return R.dense_search(queries, vectors).select("q", "doc", "score", "rank")


def inner_product_topk(spark: SparkSession, folder: str) -> DataFrame:
    queries, vectors = _vectors(spark, folder)
    return R.dense_search(queries, vectors, measure="inner").select("q", "doc", "score", "rank")


def dense_label_recall(spark: SparkSession, folder: str) -> DataFrame:
    queries, vectors = _vectors(spark, folder)
    top = R.dense_search(queries, vectors)
    labelled = top.join(queries.select("q", F.col("label").alias("ql")), "q").join(vectors.select("doc", "label"), "doc")
    return labelled.groupBy("ql").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ql") == F.col("label")).alias("same"))


def rag_context(spark: SparkSession, folder: str) -> DataFrame:
    top = R.search(_documents(spark, folder), _items(spark, folder), 5)
    joined = top.join(_documents(spark, folder).select("doc", "text"), "doc")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"])
    return joined.groupBy("q").agg(F.sha2(F.array_join(parts, "\n\n---\n\n"), 256).alias("context"))


def chrf_official_rough(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "article_texts").dropDuplicates(["id"])
    rough = t.where("NOT is_official").select("article_id", F.col("id"), F.col("body").alias("hypothesis"))
    pairs = rough.join(t.where("is_official").select("article_id", F.col("body").alias("reference")), "article_id").select("id", "hypothesis", "reference")
    return E.chrf(pairs).select("id", F.round("chrf", 4).alias("chrf"))


def grounding_rate(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "history").dropDuplicates(["id"])
    rates = E.grounding(h.select("id", F.col("answer").alias("text")), h.select("id", F.col("question").alias("text")), T.content_words("text"))
    return rates.select("id", F.round("rate", 6).alias("rate"))


def score_medians(spark: SparkSession, folder: str) -> DataFrame:
    best = R.search(_documents(spark, folder), _items(spark, folder), 1)
    return best.groupBy("language").agg(E.upper_median("score").alias("median"), E.lower_quantile("score", 0.1).alias("p10"))


def _grams(text: str) -> str:
    split = f"string_split(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"
    return f"list_transform([{split}], lambda c: list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3]))[1]"


def _words(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 2)"


_DOCS = f"SELECT {label_sql('lang')} AS language, doc_id AS doc, text FROM documents"
_ITEMS = "SELECT item_id AS q, language, text FROM benchmark"
_SERVED = f"""SELECT t.id, t.language, t.heading, t.body, a.article_number, a.ordinal, l.law_number, l.status, l.coverage, l.effective_from
 FROM (SELECT DISTINCT id, article_id, {label_sql('language')} AS language, heading, body FROM article_texts) t
 JOIN (SELECT DISTINCT id, law_id, article_number, ordinal FROM articles WHERE deleted_at IS NULL) a ON t.article_id = a.id
 JOIN (SELECT DISTINCT id, law_number, status, coverage, effective_from FROM laws WHERE deleted_at IS NULL AND status IN ('active', 'amended')) l ON a.law_id = l.id"""
_SERVED_TEXTS = f"SELECT language, id AS doc, coalesce(heading, '') || ' ' || coalesce(body, '') AS text FROM ({_SERVED}) WHERE language IN ('rw', 'en', 'fr')"


def _bm25(docs: str, queries: str, tokens, k: int, prefix: str = "") -> str:
    p = prefix
    return f"""{p}d AS ({docs}), {p}q AS ({queries}),
{p}dt AS (SELECT language, doc, {tokens('text')} AS t FROM {p}d), {p}st AS (SELECT language, count(*) AS n, avg(len(t)) AS avgdl FROM {p}dt GROUP BY language),
{p}p AS (SELECT language, doc, term, count(*) AS tf FROM (SELECT language, doc, unnest(t) AS term FROM {p}dt) GROUP BY ALL), {p}df AS (SELECT language, term, count(*) AS df FROM {p}p GROUP BY ALL),
{p}qt AS (SELECT q, language, term, count(*) AS qtf FROM (SELECT q, language, unnest({tokens('text')}) AS term FROM {p}q) GROUP BY ALL),
{p}sc AS (SELECT qt.q, qt.language, p.doc, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS score
  FROM {p}qt qt JOIN {p}p p ON p.language = qt.language AND p.term = qt.term JOIN {p}df df ON df.language = qt.language AND df.term = qt.term JOIN {p}st st ON st.language = qt.language JOIN {p}dt dt ON dt.language = p.language AND dt.doc = p.doc GROUP BY ALL),
{p}top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM {p}sc) WHERE rank <= {k})"""


_FLOORS = "(VALUES ('rw', 120.0), ('en', 150.0), ('fr', 150.0)) f(language, floor)"
_ASKED = f"WITH {_bm25(_SERVED_TEXTS, _ITEMS, _grams, 5)}, c AS (SELECT top.*, s.law_number, s.article_number, s.status, s.coverage, s.effective_from, s.effective_from IS NOT NULL AND s.effective_from <= TIMESTAMPTZ '{_AS_OF} 00:00:00+00' AS kept FROM top JOIN {_FLOORS} ON f.language = top.language AND top.score >= f.floor JOIN ({_SERVED}) s ON s.id = top.doc)"
_HEADED = f"SELECT * FROM ({_SERVED}) WHERE language IN ('rw', 'en', 'fr') AND length(heading) > 6 AND length(body) > 200"


def _ranks(tokens, prefix: str = "") -> str:
    return _bm25(f"SELECT language, id AS doc, body AS text FROM ({_HEADED})", f"SELECT id AS q, language, heading AS text FROM ({_HEADED})", tokens, 5, prefix)


_CONTAINED = f"""WITH {_bm25(_DOCS, _ITEMS, _grams, 1)}, norm AS (SELECT doc, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t FROM d),
x AS (SELECT top.language, top.q, top.score, contains(norm.t, regexp_replace(lower(q.text), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS signal FROM top JOIN q ON q.q = top.q JOIN norm ON norm.doc = top.doc)"""
_DENSE = """WITH e AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT a.doc AS q, a.label AS ql, b.doc, b.label, round({0}, 6) AS score FROM e a JOIN e b ON a.doc <> b.doc WHERE a.doc % 100 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5)"""
_COS = "list_dot_product(a.v, b.v) / coalesce(nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 1)"

_NAMES = (
    char_ngrams_tf, bm25_index_terms, bm25_index_docs, bm25_char_topk, bm25_word_topk, served_corpus, ask_shortlist, ask_limitations, unanswered_guard, corpus_shape, corpus_fingerprint, rrf_fusion, recall_at_k,
    tokenizer_mcnemar, best_cut_floor, noise_ceiling, dense_topk, inner_product_topk, dense_label_recall, rag_context, chrf_official_rough, grounding_rate, score_medians,
)
QUERIES = {f.__name__: f for f in _NAMES}
ORACLES = {
    "char_ngrams_tf": f"SELECT language, term, count(*) AS tf FROM (SELECT language, unnest({_grams('text')}) AS term FROM ({_DOCS})) GROUP BY ALL",
    "bm25_index_terms": f"WITH {_bm25(_DOCS, _ITEMS, _grams, 1)} SELECT df.language, term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df JOIN st ON st.language = df.language",
    "bm25_index_docs": f"SELECT language, count(*) AS n, sum(len({_grams('text')}))::BIGINT AS n_terms, round(avg(len({_grams('text')})), 6) AS avgdl FROM ({_DOCS}) GROUP BY language",
    "bm25_char_topk": f"WITH {_bm25(_DOCS, _ITEMS, _grams, 5)} SELECT q, doc, score, rank FROM top",
    "bm25_word_topk": f"WITH {_bm25(_DOCS, _ITEMS, _words, 5)} SELECT q, doc, score, rank FROM top",
    "served_corpus": f"SELECT id, law_number, article_number, ordinal, language, status, length(body) AS n_chars FROM ({_SERVED})",
    "ask_shortlist": _ASKED + " SELECT q, doc AS text_id, law_number, article_number, score, rank, strftime(effective_from AT TIME ZONE 'UTC', '%Y-%m-%d') AS effective_from FROM c WHERE kept",
    "ask_limitations": _ASKED
    + """ SELECT q, CASE WHEN count(*) FILTER (WHERE kept) > 0 THEN 'shortlist' ELSE 'none' END AS kind, count(*) FILTER (WHERE kept) AS n_kept,
 concat_ws(',', max(CASE WHEN kept AND status = 'amended' THEN 'amended_law' END), max(CASE WHEN kept AND coverage = 'partial' THEN 'partial_coverage' END), max(CASE WHEN effective_from IS NULL THEN 'undated_law' END)) AS limitations FROM c GROUP BY q""",
    "unanswered_guard": f"WITH {_bm25(_SERVED_TEXTS, _ITEMS, _grams, 1)} SELECT q, language FROM q WHERE NOT EXISTS (SELECT 1 FROM top JOIN {_FLOORS} ON f.language = top.language AND top.score >= f.floor WHERE top.q = q.q)",
    "corpus_shape": f"SELECT law_number, language, count(*) AS texts FROM ({_SERVED}) GROUP BY ALL",
    "corpus_fingerprint": f"SELECT law_number, texts, {T.fnv1a_sql('shape')} AS fingerprint FROM (SELECT law_number, string_agg(law_number || ':' || language || ':' || n, '|' ORDER BY list_position(['rw', 'en', 'fr'], language)) AS shape, sum(n)::BIGINT AS texts FROM (SELECT law_number, language, count(*) AS n FROM ({_SERVED}) WHERE language IN ('rw', 'en', 'fr') GROUP BY ALL) GROUP BY law_number)",
    "rrf_fusion": f"WITH {_bm25(_DOCS, _ITEMS, _grams, 10, 'u')}, {_bm25(_DOCS, _ITEMS, _words, 10, 'v')}, f AS (SELECT q, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT q, doc, rank FROM utop UNION ALL SELECT q, doc, rank FROM vtop) GROUP BY q, doc) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 5",
    "recall_at_k": f"WITH {_ranks(_grams)} SELECT count(*) AS n, round(100 * avg(CASE WHEN top.rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(100 * avg(CASE WHEN top.rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5 FROM q LEFT JOIN top ON top.q = q.q AND top.doc = q.q",
    "tokenizer_mcnemar": f"WITH {_ranks(_grams, 'u')}, {_ranks(_words, 'v')}, x AS (SELECT q FROM utop WHERE q = doc AND rank = 1), y AS (SELECT q FROM vtop WHERE q = doc AND rank = 1) SELECT count(*) FILTER (WHERE y.q IS NULL) AS only_a, count(*) FILTER (WHERE x.q IS NULL) AS only_b, count(*) FILTER (WHERE x.q IS NOT NULL AND y.q IS NOT NULL) AS both, round(CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0))))) END, 6) AS p FROM x FULL JOIN y ON x.q = y.q",
    "best_cut_floor": _CONTAINED
    + """, cuts AS (SELECT DISTINCT language, score FROM x), v AS (SELECT c.language, c.score, round(count(*) FILTER (WHERE x.signal AND x.score >= c.score) / greatest(count(*) FILTER (WHERE x.signal), 1) + 2.0 * count(*) FILTER (WHERE NOT x.signal AND x.score < c.score) / greatest(count(*) FILTER (WHERE NOT x.signal), 1), 9) AS value
 FROM cuts c JOIN x ON x.language = c.language GROUP BY c.language, c.score) SELECT language, score AS cut, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY value DESC, score) AS n FROM v) WHERE n = 1""",
    "noise_ceiling": _CONTAINED + " SELECT language, count(*) AS n, max(score) AS peak, round(avg(score), 6) AS mean FROM x WHERE NOT signal GROUP BY language",
    "dense_topk": _DENSE.format(_COS) + " SELECT q, doc, score, rank FROM t",
    "inner_product_topk": _DENSE.format("list_dot_product(a.v, b.v)") + " SELECT q, doc, score, rank FROM t",
    "dense_label_recall": _DENSE.format(_COS) + " SELECT ql, count(*) AS n, count(*) FILTER (WHERE ql = label) AS same FROM t GROUP BY ql",
    "rag_context": f"WITH {_bm25(_DOCS, _ITEMS, _grams, 5)} SELECT q, sha256(string_agg(d.text, '\n\n---\n\n' ORDER BY rank)) AS context FROM top JOIN d ON d.doc = top.doc GROUP BY q",
    "grounding_rate": r"""WITH h AS (SELECT DISTINCT id, question, answer FROM history), w AS (SELECT id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(answer, '')), '[^\p{L}\p{N}\s''’]+', ' ', 'g'), '\s+'), lambda w: length(w) >= 5)) AS w FROM h),
 k AS (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(question, '')), '[^\p{L}\p{N}\s''’]+', ' ', 'g'), '\s+'), lambda w: length(w) >= 5)) AS w FROM h)
 SELECT w.id, round(avg(CASE WHEN k.w IS NULL THEN 0.0 ELSE 1.0 END), 6) AS rate FROM w LEFT JOIN k ON w.id = k.id AND w.w = k.w GROUP BY w.id""",
    "score_medians": f"WITH {_bm25(_DOCS, _ITEMS, _grams, 1)}, l AS (SELECT language, list_sort(list(score)) AS s FROM top GROUP BY language) SELECT language, s[(len(s) // 2) + 1] AS median, s[least(len(s) - 1, floor(0.1 * len(s))::BIGINT) + 1] AS p10 FROM l",
}
