"""Composed retrieval, evaluation and load queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import text as T
from strataquill.functions.keys import law_key
from strataquill.functions.labels import label_sql
from strataquill.operators import evaluation as E
from strataquill.operators import loads
from strataquill.operators import retrieval as R
from strataquill.plans.retrieval_queries import _CONTAINED, _DOCS, _HEADED, _ITEMS, _bm25, _contained, _documents, _grams, _headed, _items, _questions, _served, _words
from strataquill.session import checkpoint, shared_folder
from strataquill.sources.tables import records, table

#: Concepts of the test texts with a phrasing that no text uses, in each language.
_CONCEPTS = {"tenant": {"en": ("the tenant", "the lessee"), "fr": ("le locataire", "le preneur"), "rw": ("umukodesha", "umupangayi")}, "bank": {"en": ("the bank", "the lender"), "fr": ("la banque", "le prêteur"), "rw": ("banki", "umugurizi")}}


def bm25_stored_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Top documents of each item from an index that is written once and read by the terms asked for."""
    path = f"{shared_folder(spark)}/index-{spark.sparkContext.applicationId}-{abs(hash(folder))}"
    R.store_index(R.build_index(_documents(spark, folder), T.word_tokens), path, buckets=16)
    return R.top_k(R.score(R.load_index(spark, path, T.word_tokens), _items(spark, folder))).select("q", "doc", "score", "rank")


def hybrid_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion of the dense and the word ranking of uploads, for every hundredth upload against all."""
    uploads = records(spark, folder, "uploaded_documents").where(F.size("embedding") == 64)
    asked = uploads.where(F.col("id") % 100 == 0)
    dense = R.dense_search(asked.select(F.col("id").alias("q"), F.col("embedding").alias("vector")), uploads.select(F.col("id").alias("doc"), F.col("embedding").alias("vector")), 10)
    sparse = R.search(uploads.select(F.lit("all").alias("language"), F.col("id").alias("doc"), F.col("content").alias("text")), asked.select(F.col("id").alias("q"), F.lit("all").alias("language"), F.col("content").alias("text")), 10, T.word_tokens)
    return R.top_k(R.fuse(dense, sparse), 5, 9).select("q", "doc", "score", "rank")


def bank_lift(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of articles by their heading from prose, from a bank of one phrasing an article (its first
    sentence), from prose with the bank added, and from the fusion of prose and bank."""
    served = _headed(spark, folder)
    phrased = served.select("language", F.col("id").alias("doc"), F.col("body"), F.regexp_extract("body", r"^[^.!?]*[.!?]?", 0).alias("phrasing"))
    queries = served.select(F.col("id").alias("q"), "language", F.col("heading").alias("text"))
    texts = {"prose": F.col("body"), "bank": F.col("phrasing"), "augmented": F.concat_ws(" ", "body", "phrasing")}
    found = {name: R.search(phrased.select("language", "doc", text.alias("text")), queries, 10, T.word_tokens) for name, text in texts.items()}
    found["fused"] = R.top_k(R.fuse(found["prose"], found["bank"]), 10, 9)
    result = None
    for name, ranking in found.items():
        ranked = queries.select("q").join(ranking.where(F.col("q") == F.col("doc")).select("q", "rank"), "q", "left")
        part = E.recall_at(ranked).withColumn("source", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


def derived_floors(spark: SparkSession, folder: str) -> DataFrame:
    return E.floors(_contained(spark, folder)).select("language", F.col("floor").cast("long").alias("floor"))


def _reworded(spark: SparkSession, folder: str) -> DataFrame:
    """Items that mention a concept, with that phrasing replaced by the one no text uses."""
    items = _items(spark, folder)
    text = F.lower("text")
    for phrasings in _CONCEPTS.values():
        for language, (usual, other) in phrasings.items():
            text = F.when(F.col("language") == language, F.replace(text, F.lit(usual), F.lit(other))).otherwise(text)
    return items.withColumn("reworded", text).where(F.col("reworded") != F.lower("text"))


def expansion_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of the expected document of reworded items before and after their concepts are expanded."""
    items, docs = _reworded(spark, folder), _documents(spark, folder)
    expected = R.search(docs, items.select("q", "language", "text"), 1, T.word_tokens).select("q", "doc")
    asked = {"before": F.col("reworded"), "after": T.expand_query("reworded", "language", _CONCEPTS)}
    for name, text in asked.items():
        found = R.search(docs, items.select("q", "language", text.alias("text")), 10, T.word_tokens)
        expected = expected.join(found.select("q", "doc", F.col("rank").cast("long").alias(name)), ["q", "doc"], "left")
    return expected


def tokenizer_table(spark: SparkSession, folder: str) -> DataFrame:
    """Recall by heading with each of the four tokenizers, and how it splits from character 4-grams."""
    # Roots are worked out once and shared by two of the tokenizers; as lines, which are half as large as arrays.
    rows = checkpoint(_questions(spark, folder).select("*", *(F.array_join(T.stem_tokens(c), " ").alias(f"{c}_stems") for c in ("question", "text"))))
    stems = rows.select("q", "language", *(F.struct(F.col(c).alias("text"), F.col(f"{c}_stems").alias("stems")).alias(c) for c in ("question", "text")))
    stemmed = lambda c: F.filter(F.split(c["stems"], " "), lambda w: w != "")
    ranks = {name: R.own_ranks(rows, 5, t) for name, t in (("chars", T.char_ngrams), ("words", T.word_tokens))}
    ranks |= {name: R.own_ranks(stems, 5, t) for name, t in (("stems", stemmed), ("stems_chars", lambda c: F.concat(stemmed(c), T.char_ngrams(c["text"]))))}
    ranks = {name: checkpoint(r) for name, r in ranks.items()}  # each is read three times or more
    first = {name: r.where("rank = 1").select("q") for name, r in ranks.items()}
    result = None
    for name, r in ranks.items():
        part = E.recall_at(r).crossJoin(E.mcnemar(first[name], first["chars"])).withColumn("tokenizer", F.lit(name))  # one row each
        result = part if result is None else result.unionByName(part)
    return result.select("tokenizer", "n", "recall_1", "recall_5", "only_a", "only_b", F.round("p", 6).alias("p"))


def _fingerprint(texts: DataFrame) -> DataFrame:
    """One value for a corpus (law_number, language): a digest of the digests of its laws' shapes."""
    shape = texts.groupBy("law_number", "language").agg(F.count(F.lit(1)).alias("n"))
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "language", F.col("n").cast("string"))))
    laws = shape.groupBy("law_number").agg(T.fnv1a(F.concat_ws("|", "law_number", F.array_join(lines, "|"))).alias("digest"), F.sum("n").alias("n"))
    # The laws' digests are counted by their first two digits and folded there, so no task holds all of them.
    slices = laws.groupBy(F.left("digest", F.lit(2)).alias("slice")).agg(F.bit_xor(F.conv("digest", 16, 10).cast("long")).alias("x"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("laws"))
    folded = T.fnv1a(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "x"))), lambda s: F.concat_ws(":", s["slice"], s["x"].cast("string"))), "|"))
    return slices.agg(folded.alias("fingerprint"), F.sum("laws").alias("laws"), F.sum("n").alias("texts"))


def retrieval_fingerprint(config: dict) -> str:
    """A digest of a retrieval configuration, whatever the order of its keys."""
    import json

    value = 2166136261
    for char in json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")):
        value = (value ^ ord(char)) * 16777619 % 2**32
    return f"{value:08x}"


def corpus_staleness(spark: SparkSession, folder: str) -> DataFrame:
    """Whether floors derived in 2022 are stale: the fingerprint of the served corpus then and now."""
    served = _served(spark, folder).select("law_number", "language", "id")
    dated = served.join(records(spark, folder, "article_texts").select("id", "created_at"), "id")
    then, now = _fingerprint(dated.where("created_at < '2022-01-01'")), _fingerprint(dated)
    both = then.select(F.col("fingerprint").alias("then"), F.col("laws").alias("laws_then")).crossJoin(now.select(F.col("fingerprint").alias("now"), F.col("laws").alias("laws_now")))  # one row each
    return both.withColumn("stale", F.col("then") != F.col("now"))


def load_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Laws per origin: clean ones as a share of all and of those with a text layer, and the sum of the
    load-blocking weights of their faults."""
    laws = records(spark, folder, "laws")
    scanned, undated = F.col("gazette_ref").isNull(), F.col("published_at").isNull()
    weights = spark.createDataFrame([("scanned", 2), ("undated", 1), ("partial", 0)], "fault string, weight long")
    faults = laws.select("origin", F.explode(F.array_compact(F.array(F.when(scanned, "scanned"), F.when(undated, "undated"), F.when(F.col("coverage") == "partial", "partial")))).alias("fault"))
    blocked = faults.join(F.broadcast(weights), "fault").groupBy("origin").agg(F.sum("weight").alias("blocked"))
    counted = laws.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count_if(~scanned).alias("n_text"), F.count_if(~scanned & ~undated).alias("n_clean"))
    share = lambda whole: F.round(F.col("n_clean") / F.coalesce(F.nullif(F.col(whole), F.lit(0)), F.lit(1)), 6)
    return counted.join(blocked, "origin", "left").select("origin", "n", "n_text", "n_clean", share("n").alias("of_all"), share("n_text").alias("of_text"), F.coalesce("blocked", F.lit(0)).alias("blocked"))


def field_argmax(spark: SparkSession, folder: str) -> DataFrame:
    """The column of ``laws`` whose values most often parse as a law number; the first of equals."""
    laws = records(spark, folder, "laws")
    columns = ["law_number", "origin", "status", "coverage", "gazette_ref"]
    long = laws.select(F.inline(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("field"), F.col(c).alias("value")) for k, c in enumerate(columns)))))
    shares = long.groupBy("place", "field").agg(F.avg(F.when(F.col("value").rlike(r"\d{1,4}(bis|ter)?/\d{2,4}"), 1.0).otherwise(0.0)).alias("share"))
    return shares.agg(F.max_by("field", F.struct("share", -F.col("place"))).alias("field"), F.round(F.max("share"), 6).alias("share"))


def phrasings_per_language(spark: SparkSession, folder: str) -> DataFrame:
    texts = records(spark, folder, "article_texts").where("heading IS NOT NULL AND trim(heading) <> ''")
    return texts.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("article_id").alias("n_articles"))


def first_cases(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, "cases").where("decided_at IS NOT NULL").orderBy("decided_at", "id").limit(4).select("id", "case_number")


def number_taken(spark: SparkSession, folder: str) -> DataFrame:
    """Live articles whose next number is taken in their law already."""
    articles = records(spark, folder, "articles").where("deleted_at IS NULL")
    taken = articles.select("law_id", F.col("ordinal").alias("next")).distinct()
    return articles.select("id", "law_id", (F.col("ordinal") + 1).alias("next")).join(taken, ["law_id", "next"], "left_semi").select("id", "next")


def resolved_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Each law with the status that a case list gives its number, the default where none does."""
    laws = records(spark, folder, "laws").select("id", law_key("law_number").alias("law"))
    statuses = records(spark, folder, "laws").where("deleted_at IS NOT NULL").select(law_key("law_number").alias("law"), "status")
    return loads.resolve_status(laws, statuses, "law", "active").select("id", "status", "assumed")


def deleted_by_handle(spark: SparkSession, folder: str) -> DataFrame:
    uploads = records(spark, folder, "uploaded_documents")
    doomed = uploads.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("filename")
    return loads.delete_keys(uploads, doomed, "filename").select("id", "filename")


def pending_versions(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("version"), F.col("n_name").alias("name"), "n_regionkey")
    wanted = n.where("version > 2").select("version", "name", F.sha2("name", 256).alias("digest"))
    ledger = n.where("n_regionkey < 3").select("version", "name", F.sha2(F.when(F.col("version") % 10 == 0, F.lower("name")).otherwise(F.col("name")), 256).alias("digest"))
    return loads.pending_migrations(wanted, ledger).select("version", "name", "state")


def rough_with_official(spark: SparkSession, folder: str) -> DataFrame:
    """Each unofficial text beside the official one of its article and language, where there is one."""
    texts = records(spark, folder, "article_texts")
    official = texts.where("is_official").groupBy("article_id", "language").agg(F.min("id").alias("official_id"))
    return texts.where("NOT is_official").select("id", "article_id", "language").join(official, ["article_id", "language"], "left").select("id", "official_id")


def segment_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of a segment, without the columns that are nobody's business."""
    return table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").drop("c_acctbal", "c_mktsegment")


_NAMES = (
    bm25_stored_topk, hybrid_uploads, bank_lift, derived_floors, expansion_gain, tokenizer_table, corpus_staleness, load_ratios, field_argmax, phrasings_per_language, first_cases, number_taken, resolved_statuses,
    deleted_by_handle, pending_versions, rough_with_official, segment_lists,
)
QUERIES = {f.__name__: f for f in _NAMES}


def _reworded_sql(text: str) -> str:
    for phrasings in _CONCEPTS.values():
        for language, (usual, other) in phrasings.items():
            text = f"CASE WHEN language = '{language}' THEN replace({text}, '{usual}', '{other}') ELSE {text} END"
    return text


def _expanded_sql(text: str) -> str:
    parts = []
    for phrasings in _CONCEPTS.values():
        for language, phrases in phrasings.items():
            there = [f"contains(lower({text}), '{p}')" for p in phrases]
            others = ", ".join(f"CASE WHEN NOT {t} THEN '{p}' END" for p, t in zip(phrases, there))
            parts.append(f"CASE WHEN language = '{language}' AND ({' OR '.join(there)}) THEN [{others}] ELSE [] END")
    return f"array_to_string(list_filter(flatten([[{text}], {', '.join(parts)}]), lambda x: x IS NOT NULL), ' ')"


_UPLOADS = "(SELECT DISTINCT ON (id) id, content, embedding FROM uploaded_documents WHERE len(embedding) = 64)"
_RECALL = "SELECT '{0}' AS source, count(*) AS n, round(100 * avg(CASE WHEN t.rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(100 * avg(CASE WHEN t.rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5 FROM uq q LEFT JOIN {1} t ON t.q = q.q AND t.doc = q.q"
_HEAD_QUERIES = f"SELECT id AS q, language, heading AS text FROM ({_HEADED})"
_PHRASE = "regexp_extract(body, '^[^.!?]*[.!?]?', 0)"
_AT = f"(SELECT DISTINCT * REPLACE ({label_sql('language')} AS language) FROM article_texts)"
_SHAPE = f"""shape AS (SELECT w, law_number, language, count(*) AS n FROM served GROUP BY ALL),
laws_ AS (SELECT w, {T.fnv1a_sql("law_number || '|' || lines")} AS digest, n FROM (SELECT w, law_number, string_agg(language || ':' || n, '|' ORDER BY language || ':' || n) AS lines, sum(n) AS n FROM shape GROUP BY w, law_number)),
slices AS (SELECT w, left(digest, 2) AS slice, bit_xor(('0x' || digest)::BIGINT) AS x, count(*) AS laws FROM laws_ GROUP BY ALL),
f AS (SELECT w, {T.fnv1a_sql("all_")} AS fingerprint, laws FROM (SELECT w, string_agg(slice || ':' || x, '|' ORDER BY slice) AS all_, sum(laws)::BIGINT AS laws FROM slices GROUP BY w))"""
_SERVED_DATED = f"""served AS (SELECT w, l.law_number, {label_sql('t.language')} AS language, t.id FROM (SELECT DISTINCT id, article_id, language, created_at FROM article_texts) t
 JOIN (SELECT DISTINCT id, law_id FROM articles WHERE deleted_at IS NULL) a ON t.article_id = a.id JOIN (SELECT DISTINCT id, law_number FROM laws WHERE deleted_at IS NULL AND status IN ('active', 'amended')) l ON a.law_id = l.id
 JOIN (VALUES ('then'), ('now')) v(w) ON w = 'now' OR t.created_at < TIMESTAMPTZ '2022-01-01 00:00:00+00')"""
_LAW = r"regexp_replace(regexp_replace(lower(law_number), '[\s\p{Z}.]+', '', 'g'), '^[^0-9]*0*([0-9]+[a-z]*/[0-9]+[a-z]*)[^a-z0-9]*$', '\1')"
_FIELDS = ["law_number", "origin", "status", "coverage", "gazette_ref"]
ORACLES = {
    "bm25_stored_topk": f"WITH {_bm25(_DOCS, _ITEMS, _words, 5)} SELECT q, doc, score, rank FROM top",
    "hybrid_uploads": f"""WITH {_bm25(f"SELECT 'all' AS language, id AS doc, content AS text FROM {_UPLOADS}", f"SELECT id AS q, 'all' AS language, content AS text FROM {_UPLOADS} WHERE id % 100 = 0", _words, 10)}, e AS (SELECT id, embedding::DOUBLE[] AS v FROM {_UPLOADS}),
 s AS (SELECT a.id AS q, b.id AS doc, round(list_dot_product(a.v, b.v) / coalesce(nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 1), 6) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
 dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10), f AS (SELECT q, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT q, doc, rank FROM dn UNION ALL SELECT q, doc, rank FROM top) GROUP BY q, doc)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 5""",
    "bank_lift": f"""WITH {_bm25(f"SELECT language, id AS doc, body AS text FROM ({_HEADED})", _HEAD_QUERIES, _words, 10, 'u')}, {_bm25(f"SELECT language, id AS doc, {_PHRASE} AS text FROM ({_HEADED})", _HEAD_QUERIES, _words, 10, 'v')}, {_bm25(f"SELECT language, id AS doc, body || ' ' || {_PHRASE} AS text FROM ({_HEADED})", _HEAD_QUERIES, _words, 10, 'w')},
 f AS (SELECT q, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT q, doc, rank FROM utop UNION ALL SELECT q, doc, rank FROM vtop) GROUP BY q, doc), ftop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 10)
 {_RECALL.format('prose', 'utop')} UNION ALL {_RECALL.format('bank', 'vtop')} UNION ALL {_RECALL.format('augmented', 'wtop')} UNION ALL {_RECALL.format('fused', 'ftop')}""",
    "derived_floors": _CONTAINED
    + """, cuts AS (SELECT DISTINCT language, score FROM x), v AS (SELECT c.language, c.score, round(count(*) FILTER (WHERE x.signal AND x.score >= c.score) / greatest(count(*) FILTER (WHERE x.signal), 1) + 2.0 * count(*) FILTER (WHERE NOT x.signal AND x.score < c.score) / greatest(count(*) FILTER (WHERE NOT x.signal), 1), 9) AS value
 FROM cuts c JOIN x ON x.language = c.language GROUP BY c.language, c.score), b AS (SELECT language, score AS cut FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY value DESC, score) AS n FROM v) WHERE n = 1)
 SELECT b.language, ceil(greatest(cut, coalesce(max(score) FILTER (WHERE NOT signal) * 1.02, 0)))::BIGINT AS floor FROM b JOIN x ON x.language = b.language GROUP BY b.language, cut""",
    "expansion_gain": f"""WITH i AS (SELECT * FROM (SELECT q, language, text, {_reworded_sql('lower(text)')} AS reworded FROM ({_ITEMS})) WHERE reworded <> lower(text)),
 {_bm25(_DOCS, 'SELECT q, language, text FROM i', _words, 1, 'u')}, {_bm25(_DOCS, 'SELECT q, language, reworded AS text FROM i', _words, 10, 'v')}, {_bm25(_DOCS, f"SELECT q, language, {_expanded_sql('reworded')} AS text FROM i", _words, 10, 'w')}
 SELECT u.q, u.doc, v.rank AS before, w.rank AS after FROM utop u LEFT JOIN vtop v ON u.q = v.q AND u.doc = v.doc LEFT JOIN wtop w ON u.q = w.q AND u.doc = w.doc""",
    "corpus_staleness": f"WITH {_SERVED_DATED}, {_SHAPE} SELECT a.fingerprint AS then, a.laws AS laws_then, b.fingerprint AS now, b.laws AS laws_now, a.fingerprint <> b.fingerprint AS stale FROM f a JOIN f b ON a.w = 'then' AND b.w = 'now'",
    "load_ratios": """WITH l AS (SELECT DISTINCT * FROM laws) SELECT origin, count(*) AS n, count(gazette_ref) AS n_text, count(*) FILTER (WHERE gazette_ref IS NOT NULL AND published_at IS NOT NULL) AS n_clean, round(count(*) FILTER (WHERE gazette_ref IS NOT NULL AND published_at IS NOT NULL) / count(*), 6) AS of_all,
 round(count(*) FILTER (WHERE gazette_ref IS NOT NULL AND published_at IS NOT NULL) / greatest(count(gazette_ref), 1), 6) AS of_text, (2 * count(*) FILTER (WHERE gazette_ref IS NULL) + count(*) FILTER (WHERE published_at IS NULL))::BIGINT AS blocked FROM l GROUP BY origin""",
    "field_argmax": "WITH l AS (SELECT DISTINCT * FROM laws), s AS (" + " UNION ALL ".join(f"SELECT {k} AS place, '{c}' AS field, avg(CASE WHEN regexp_matches(coalesce({c}, ''), '\\d{{1,4}}(bis|ter)?/\\d{{2,4}}') THEN 1.0 ELSE 0.0 END) AS share FROM l" for k, c in enumerate(_FIELDS)) + ") SELECT field, round(share, 6) AS share FROM s ORDER BY share DESC, place LIMIT 1",
    "phrasings_per_language": f"SELECT language, count(*) AS n, count(DISTINCT article_id) AS n_articles FROM {_AT} WHERE heading IS NOT NULL AND trim(heading) <> '' GROUP BY language",
    "first_cases": "SELECT id, case_number FROM (SELECT DISTINCT * FROM cases) WHERE decided_at IS NOT NULL ORDER BY decided_at, id LIMIT 4",
    "number_taken": "WITH a AS (SELECT DISTINCT * FROM articles WHERE deleted_at IS NULL) SELECT id, (ordinal + 1)::INT AS next FROM a WHERE EXISTS (SELECT 1 FROM a b WHERE b.law_id = a.law_id AND b.ordinal = a.ordinal + 1)",
    "resolved_statuses": f"WITH l AS (SELECT DISTINCT id, {_LAW} AS law, status, deleted_at FROM laws), s AS (SELECT law, min(status) AS status FROM l WHERE deleted_at IS NOT NULL GROUP BY law) SELECT l.id, coalesce(s.status, 'active') AS status, s.status IS NULL AS assumed FROM l LEFT JOIN s ON l.law = s.law",
    "deleted_by_handle": "WITH u AS (SELECT DISTINCT id, filename FROM uploaded_documents) SELECT id, filename FROM u WHERE filename IS NULL OR filename NOT IN (SELECT filename FROM u WHERE filename IS NOT NULL GROUP BY filename HAVING count(*) > 1)",
    "pending_versions": "WITH w AS (SELECT n_nationkey AS v, n_name FROM nation WHERE n_nationkey > 2), g AS (SELECT n_nationkey AS v, n_name, CASE WHEN n_nationkey % 10 = 0 THEN lower(n_name) ELSE n_name END AS d FROM nation WHERE n_regionkey < 3) SELECT coalesce(w.v, g.v)::BIGINT AS version, coalesce(w.n_name, g.n_name) AS name, CASE WHEN g.v IS NULL THEN 'pending' WHEN w.v IS NULL THEN 'unknown' ELSE 'changed' END AS state FROM w FULL JOIN g ON w.v = g.v WHERE g.v IS NULL OR w.v IS NULL OR g.d <> w.n_name",
    "rough_with_official": f"WITH t AS (SELECT * FROM {_AT}), o AS (SELECT article_id, language, min(id) AS official_id FROM t WHERE is_official GROUP BY ALL) SELECT t.id, o.official_id FROM t LEFT JOIN o ON o.article_id = t.article_id AND o.language = t.language WHERE NOT t.is_official",
    "segment_lists": "SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer WHERE c_mktsegment = 'BUILDING'",
}
