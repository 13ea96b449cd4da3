from __future__ import annotations

import datetime
import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataquill.functions.text import char_ngrams, content_words, word_tokens
from strataquill.operators import evaluation as E
from strataquill.operators import lines as L
from strataquill.operators import loads, orphans, paging, provisions
from strataquill.operators import retrieval as R
from strataquill.operators.skew import hot_key_join
from strataquill.sources import readers, sinks


def day(n):
    return datetime.datetime(2024, 1, n)


def test_pinned_score(spark):
    docs = spark.createDataFrame([("en", "a", "the right to due process of law"), ("en", "b", "the right to private property"), ("en", "c", "banana bread and grilled fish")], "language string, doc string, text string")
    queries = spark.createDataFrame([("q", "en", "due process"), ("z", "en", "zzzzqqqq"), ("e", "en", "")], "q string, language string, text string")
    got = {(r["q"], r["doc"]): r["score"] for r in R.search(docs, queries).collect()}
    assert got[("q", "a")] == pytest.approx(6.354979, abs=1e-6)
    assert ("q", "c") not in got and all(q == "q" for q, _ in got)
    whole = {(r["q"], r["doc"]): r["score"] for r in R.top_k(R.score(R.build_index(docs), queries)).collect()}
    assert whole == got


def test_ask_filters_after_the_limit(spark):
    hits = spark.createDataFrame([("q", "en", 1, 9.0, 1), ("q", "en", 2, 8.0, 2), ("q", "en", 3, 1.0, 3)], "q string, language string, doc long, score double, rank int")
    served = spark.createDataFrame([(1, "1/2000", "1", "active", "complete", None), (2, "2/2000", "1", "amended", "partial", day(1)), (3, "3/2000", "1", "active", "complete", day(1))], "id long, law_number string, article_number string, status string, coverage string, effective_from timestamp")
    floors = spark.createDataFrame([("en", 8.0)], "language string, floor double")
    asked = R.ask(hits, served, floors, F.lit(day(2)))
    assert [r["doc"] for r in asked.where("kept").collect()] == [2]
    assert R.limitations(asked).first().asDict() == {"q": "q", "kind": "shortlist", "n_kept": 1, "limitations": "amended_law,partial_coverage,undated_law"}


def test_fusion_and_dense(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "q string, doc long, rank int")
    b = spark.createDataFrame([("q", 2, 1)], "q string, doc long, rank int")
    assert R.top_k(R.fuse(a, b), 1).first()["doc"] == 2
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "doc long, vector array<double>")
    q = v.where("doc = 1").select(F.col("doc").alias("q"), "vector")
    assert [r["doc"] for r in R.dense_search(q, v, 2).orderBy("rank").collect()] == [2, 3]


def test_evaluation(spark):
    scores = spark.createDataFrame([("en", s, g) for s, g in ((1.0, False), (2.0, False), (3.0, True), (5.0, True))], "language string, score double, signal boolean")
    assert E.best_cut(scores).first()["cut"] == 3.0 and E.floors(scores).first()["floor"] == 3
    assert E.two_sided_binomial(10, 2) == pytest.approx(0.109375) and E.two_sided_binomial(0, 0) == 1
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "q int")
    assert tuple(E.mcnemar(ids(1, 2, 3), ids(3, 4)).first()) == (2, 1, 1, 1.0)
    pairs = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "the cat sits", "the cat sat"), (3, "", "the cat"), (4, None, "x"), (5, "zzz", "the cat sat")], "id int, hypothesis string, reference string")
    got = {r["id"]: r["chrf"] for r in E.chrf(pairs).collect()}
    assert got[1] == pytest.approx(100) and 50 < got[2] < 100 and got[3] == got[4] == 0 and got[5] < 25
    said = spark.createDataFrame([(1, "alpha beta gamma alpha")], "id int, text string")
    known = spark.createDataFrame([(1, "alpha words")], "id int, text string")
    assert E.grounding(said, known, content_words("text", 4)).first()["rate"] == 0.5
    assert E.recall_at(spark.createDataFrame([(1,), (3,), (None,), (9,)], "rank int")).first().asDict() == {"n": 4, "recall_1": 25.0, "recall_5": 50.0}
    row = spark.createDataFrame([(float(x),) for x in range(4)], "v double").agg(E.upper_median("v").alias("m"), E.lower_quantile("v", 0.5).alias("q")).first()
    assert row["m"] == 2 and row["q"] == 2


def test_segments_of_an_issue(spark):
    rows = ["ITEGEKO N° 05/2026 RYO KU WA 01/01/2026", "Ingingo ya mbere: A", "text of it", "ITEGEKO N° 05/2026", "more", "PRESIDENTIAL ORDER N° 10/01 OF 2026", "end"]
    lines = spark.createDataFrame([("i", k, t) for k, t in enumerate(rows)], "id string, line_no int, text string")
    got = [tuple(r)[1:] for r in L.segment_issue(lines).orderBy("from_line").collect()]
    assert got == [("05/2026", 0, 5), ("10/01", 5, 7)]
    index = spark.createDataFrame([("i", 0, "Itegeko n° 099/2099 ryo ku wa"), ("i", 1, "rigenga ikizamini………2")], "id string, line_no int, text string")
    assert [r["law_number"] for r in L.indexed_instruments(index).collect()] == ["99/2099"]


def test_articles_of_a_stream(spark):
    rows = ["Article one: Purpose", "Contents", "Article 2: Scope", "This is the long body of two.", "Article one: Purpose", "This is the real first article.", "It goes on."]
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(rows)], "id string, line_no int, text string")
    got = {r["number"]: (r["heading"], r["body"]) for r in L.articles_of(lines).collect()}
    assert got == {1: ("Purpose", "This is the real first article. It goes on."), 2: ("Scope", "This is the long body of two.")}


def test_line_assembly_anchors_on_the_first_item(spark):
    items = [("d", 1, 10.0, 100.0, 20.0, "Hel", "f"), ("d", 1, 30.2, 102.0, 10.0, "lo", "f"), ("d", 1, 60.0, 102.9, 10.0, "you", "g"), ("d", 1, 10.0, 104.0, 10.0, "next", "f"), ("d", 1, 10.0, 120.0, 10.0, "12", "f")]
    frame = spark.createDataFrame(items, "doc string, page int, x double, y double, width double, text string, font string")
    got = L.assemble_lines(L.column_bands(frame, 1)).orderBy("line_no").collect()
    assert [r["text"] for r in got] == ["Hello you", "next"] and got[0]["fonts"] == ["f", "g"]
    bands = {r["x"]: r["band"] for r in L.column_bands(frame, 3).collect()}
    assert bands[10.0] == 0 and bands[60.0] == 2


def test_gaps_and_dry_runs(spark):
    held = spark.createDataFrame([("a", n) for n in (1, 4, 6)] + [("b", 1)], "k string, n int")
    assert {tuple(r) for r in L.missing_runs(held, "k", "n").collect()} == {("a", 3, "2-3, 5"), ("b", 0, "")}
    rows = spark.createDataFrame([("u", k, w) for k, w in enumerate([True, False, True, False, False, False])], "k string, n int, wet boolean")
    assert L.dry_run_end(rows, "k", "n", F.col("wet")).first()["ended_at"] == 4


def test_loads(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "z")], "id int, v string, w string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(loads.upsert(old, new, ["id"]).fillna("-")) == [(1, "a", "x"), (2, "-", "y"), (3, "c", "z")]
    merged = loads.upsert_coalesce(old, new, ["id"])
    assert rows(merged) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")] and rows(loads.upsert_coalesce(merged, new, ["id"])) == rows(merged)
    edges = spark.createDataFrame([("c", None), ("c", "1")], "a string, b string")
    assert loads.insert_ignore(edges, edges, ["a", "b"]).count() == 2
    kept, (left,) = loads.cascade_delete(old, [(spark.createDataFrame([(1,), (2,)], "parent int"), "parent")], "id", F.col("v") == "a")
    assert [r["id"] for r in kept.collect()] == [2] and [r["parent"] for r in left.collect()] == [2]
    good, bad = loads.quarantine(old, {"has w": F.col("w").isNotNull()})
    assert good.count() == 1 and bad.first()["reasons"] == ["has w"]
    assert rows(loads.full_diff(old, new, "id")) == [(1, "missing", ""), (2, "changed", "v,w"), (3, "added", "")]
    assert rows(loads.replace_edges(old, new.where("id = 2"), "id").fillna("-")) == [(1, "a", "x"), (2, "-", "y")]


def test_paging(spark):
    rows = spark.range(1, 8).withColumn("p", F.col("id") % 2)
    assert [r["id"] for r in paging.page(rows, [F.desc("id")], 2, 3).collect()] == [4, 3, 2]
    assert paging.page_totals(rows, 3, 3).first().asDict() == {"total": 7, "pages": 3, "has_next": False, "has_previous": True}
    tree = paging.nest(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "b"), (1, "a")], "parent int, v string"), "k", "parent", "kids", ["v"])
    assert {r["k"]: [x["v"] for x in r["kids"]] for r in tree.collect()} == {1: ["a", "b"], 2: []}
    assert paging.matching(rows, [None, F.col("p") == 1]).count() == 4


def test_amendments(spark):
    titles = spark.createDataFrame([("01/2024", "LAW N° 01/2024 AMENDING LAW N° 17/2020 GOVERNING"), ("02/2024", "LAW N° 02/2024 GOVERNING")], "law_number string, title string")
    articles = spark.createDataFrame([("01/2024", "H", "Having reviewed Law n° 17/2020 especially in its articles 4 and 3;"), ("01/2024", None, "Having reviewed Law n° 01/2024")], "law_number string, heading string, body string")
    got = provisions.amendments(titles, articles).collect()
    assert [(r["law_number"], r["target"], r["articles"], r["source"]) for r in got] == [("01/2024", "17/2020", ["3", "4"], "title")]
    parsed = spark.createDataFrame([("01/2024", 1, "en", "Law N° 5/2001 is hereby repealed"), ("01/2024", 1, "fr", "autre"), ("01/2024", 2, "en", "x")], "law_number string, number int, language string, body string")
    found = provisions.provisions(parsed)
    assert found.first()["kind"] == "repeal" and found.first()["targets"] == ["05/2001"] and provisions.provision_totals(found).first()["resolvable"] == 1


def test_orphans(spark):
    laws = spark.createDataFrame([("l1", "01/2000", day(1), None), ("l2", "02/2000", day(1), day(2)), ("l3", "03/2000", day(20), None), ("l1", "01/2000", day(1), None), ("l4", "05/2000", None, None)], "id string, law_number string, created_at timestamp, deleted_at timestamp")
    articles = spark.createDataFrame([("a1", "l1", "1", day(1), None), ("a2", "l1", "2", day(1), day(3)), ("a3", "l1", "3 bis", day(25), None)], "id string, law_id string, article_number string, created_at timestamp, deleted_at timestamp")
    rows = [("c1", "Law No 1/2000", "Art. 01"), ("c2", "1/2000", None), ("c3", "1/2000", "2"), ("c4", "1/2000", "3BIS."), ("c5", "1/2000", "9"), ("c6", "02/2000", "1"), ("c7", "03/2000", "1"), ("c8", "4/2000", None), ("c9", None, "1"), ("c9b", "1/2000", " "), ("c8", "4/2000", None), ("ca", "5/2000", None)]
    cited = spark.createDataFrame([(i, law, a, day(10), "extra") for i, law, a in rows], "id string, law_number string, article_number string, created_at timestamp, target string")
    expected = {("c3", "articles", "deleted"), ("c4", "articles", "late"), ("c5", "articles", "missing"), ("c6", "laws", "deleted"), ("c7", "laws", "late"), ("c8", "laws", "missing")}
    for share in (200, 2, 1):  # all keys light, some heavy, none heavy
        got = orphans.orphan_references(cited, laws, articles, share)
        assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(expected)
        counted = {tuple(r) for r in orphans.orphan_counts(cited, laws, articles, share).collect()}
        assert counted == {(t, r, day(1), 1) for _, t, r in expected}
    empty = cited.limit(0)
    assert orphans.orphan_references(empty, laws, articles).count() == 0
    assert orphans.orphan_counts(empty, laws, articles).count() == 0
    assert orphans.orphan_references(cited, laws.limit(0), articles.limit(0)).where("reason <> 'missing'").count() == 0


def test_orphans_of_a_month_in_which_the_record_came(spark):
    laws = spark.createDataFrame([("l1", "1/2000", day(10), None)], "id string, law_number string, created_at timestamp, deleted_at timestamp")
    articles = spark.createDataFrame([], "id string, law_id string, article_number string, created_at timestamp, deleted_at timestamp")
    rows = [(f"c{k}", "1/2000", None, day(k)) for k in range(2, 20)] + [("c2", "1/2000", None, day(2)), ("cn", "1/2000", None, None), ("cm", "2/2000", None, None)]
    cited = spark.createDataFrame(rows, "id string, law_number string, article_number string, created_at timestamp")
    for share, most in ((1, 0), (200, 0), (200, 1000)):
        assert {tuple(r) for r in orphans.orphan_counts(cited, laws, articles, share, most).collect()} == {("laws", "late", day(1), 8), ("laws", "missing", None, 1)}


def test_rows_of_heavy_keys_never_enter_the_shuffle(spark):
    """One key with half of all rows: what is shuffled holds no row of it, and no task much more than another."""
    cited = spark.range(200_000).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") % 2 == 0, "9/1999").otherwise(F.concat((F.col("id") % 4001).cast("string"), F.lit("/2000"))).alias("law_number"), F.lit(None).cast("string").alias("article_number"), F.lit(day(5)).alias("created_at"))
    refs = orphans._references(cited)
    keys = refs.groupBy("law", "article").agg(F.count(F.lit(1)).alias("n"))
    hot, rest = orphans._skew_join(refs, keys.select("law", "article"), orphans._heavy(keys, ["law", "article"], 200), ["law", "article"])
    assert hot.count() == 100_000 and rest.count() == 100_000
    sizes = [r["count"] for r in rest.repartition(8, "law", "article").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]


def test_hot_key_join(spark):
    rows = spark.createDataFrame([(1, k) for k in range(90)] + [(k, k) for k in range(2, 12)] + [(None, 0)], "k int, v int")
    lookup = spark.createDataFrame([(k, f"n{k}") for k in range(1, 8)], "k int, name string")
    expected = sorted(tuple(r) for r in rows.join(lookup, "k").select("k", "v", "name").collect())
    assert sorted(tuple(r) for r in hot_key_join(rows, lookup, ["k"], 20).select("k", "v", "name").collect()) == expected


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "parsed").mkdir()
    (tmp_path / "parsed" / "a.json").write_text('{"kind": "gazette-parse", "source": {"lawNumber": "01/2000"}, "articles": [{"number": 1, "texts": {"en": {"heading": "H", "body": "B"}}}]}')
    (tmp_path / "parsed" / "b.json").write_text('{"kind": "other"}')
    (tmp_path / "parsed" / "c.json").write_text("{broken")
    parsed = readers.parsed_documents(spark, str(tmp_path / "parsed"), "gazette-parse")
    assert [tuple(r)[1:] for r in readers.article_rows(parsed).collect()] == [("01/2000", 1, "en", "H", "B")]
    for k, text in enumerate(('[{"n": "1", "s": "x"}]', '{"results": [{"n": "1", "s": "x"}]}')):
        path = tmp_path / f"status{k}.json"
        path.write_text(text)
        assert [tuple(r) for r in readers.status_export(spark, str(path), "n string, s string").collect()] == [("1", "x")]
    (tmp_path / "d.md").write_text("## q1\n- [x] Approve\n- [ ] reject\n## q2\ntext\n- [X] skip\n")
    assert [tuple(r) for r in readers.decisions(spark, str(tmp_path / "d.md")).orderBy("id").collect()] == [("q1", "approve"), ("q2", "skip")]
    sinks.write_floors(spark.createDataFrame([("en", 3.5)], "language string, floor double"), F.lit("abc"), str(tmp_path / "floors"))
    assert readers.floors(spark, str(tmp_path / "floors")) == {"en": 3.5}
    with pytest.raises(Exception):
        readers.floors(spark, str(tmp_path / "none"))
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "y.pdf").write_bytes(b"%PDF")
    (tmp_path / "x" / "z.txt").write_bytes(b"no")
    assert readers.pdf_files(spark, str(tmp_path / "x")).count() == 1
    named = sinks.file_names(spark.createDataFrame([(1, "A b"), (2, "a-B"), (3, "c")], "id int, t string"), "t", "id")
    assert sorted(r["file"] for r in named.collect()) == ["a-b", "a-b-2", "c"]
    sinks.write_documents(named, str(tmp_path / "docs"))
    laws = spark.createDataFrame([("1",), ("2",), ("3",)], "law_number string")
    statuses = sinks.status_map(spark.createDataFrame([("1", "active", 1), ("1", "repealed", 2), (None, "x", 3)], "law_number string, status string, row_no int"))
    assert tuple(statuses.first()) == ("1", "active", True)
    with pytest.raises(ValueError):
        sinks.write_status_map(statuses, laws, str(tmp_path / "map"))
    texts = spark.createDataFrame([("a", "en", "E"), ("a", "rw", "R"), ("b", "fr", "F")], "article_id string, language string, body string")
    assert [tuple(r) for r in sinks.aligned_pairs(texts).collect()] == [("a", "en", "rw", "E", "R")]
    log = spark.createDataFrame([(day(1), "none")], "created_at timestamp, kind string")
    sinks.append_audit(log, str(tmp_path / "log"))
    sinks.append_audit(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        sinks.append_audit(log.withColumn("question", F.lit("?")), str(tmp_path / "log"))


def test_word_index_is_the_same_whatever_the_partitions(spark):
    docs = spark.createDataFrame([("en", k, f"alpha beta{k % 3} gamma{k % 5}") for k in range(40)], "language string, doc long, text string")
    queries = spark.createDataFrame([("q", "en", "beta1 gamma2")], "q string, language string, text string")
    results = [[tuple(r) for r in R.search(docs.repartition(n), queries, 3, word_tokens).orderBy("rank").collect()] for n in (1, 7)]
    assert results[0] == results[1]


def test_stored_index_reads_only_the_buckets_of_the_terms(spark, tmp_path):
    docs = spark.createDataFrame([("en", k, f"alpha w{k % 7} w{k % 5} omega{k}") for k in range(60)] + [("fr", 100, None), (None, 101, "alpha")], "language string, doc long, text string")
    queries = spark.createDataFrame([(1, "en", "omega7 alpha alpha"), (2, "en", "absent"), (3, None, "alpha"), (4, "fr", "alpha")], "q long, language string, text string")
    index = R.build_index(docs, word_tokens)
    R.store_index(index, str(tmp_path), buckets=8)
    loaded = R.load_index(spark, str(tmp_path), word_tokens)
    scored = R.score(loaded, queries)
    assert "PartitionFilters" in scored._jdf.queryExecution().toString() and "bucket" in scored._jdf.queryExecution().toString()
    rows = {(r["q"], r["doc"], round(r["score"], 6)) for r in R.top_k(scored, 60).collect()}
    assert rows == {(r["q"], r["doc"], round(r["score"], 6)) for r in R.search(docs, queries, 60, word_tokens).collect()}
    assert {r[0] for r in rows} == {1} and len(rows) == 60


def test_search_in_blocks_of_queries(spark):
    docs = spark.createDataFrame([("en", k, f"common word{k % 3} with{k % 4}") for k in range(40)], "language string, doc long, text string")
    queries = spark.createDataFrame([(k, "en", f"common word{k % 3}") for k in range(9)], "q long, language string, text string")
    runs = [sorted(tuple(r) for r in R.search(docs, queries, 4, word_tokens, block=n).collect()) for n in (2, 100)]
    assert runs[0] == runs[1] and len(runs[0]) == 36
    assert [r[2] for r in runs[0] if r[0] == 1] == sorted(d for d in range(40) if d % 3 == 1)[:4]  # ties by document
    assert R.search(docs.limit(0), queries).count() == 0 and R.search(docs, queries.limit(0)).count() == 0


def test_dense_search(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 1.0, 1.0]), (7, [1.0, 1.0])], "doc long, vector array<float>")
    queries = vectors.where("doc IN (1, 5, 7)").withColumnRenamed("doc", "q")
    for block in (1, 10):
        got = {(r["q"], r["doc"], r["rank"]): r["score"] for r in R.dense_search(queries, vectors, 2, block=block).collect()}
        assert got == {(1, 2, 1): 1.0, (1, 7, 2): 0.707107, (7, 1, 1): 0.707107, (7, 2, 2): 0.707107}
    assert {(r["q"], r["doc"]): r["score"] for r in R.dense_search(queries, vectors, 1, "inner").collect()} == {(1, 2): 2.0, (7, 2): 2.0}
    assert R.dense_search(queries.limit(0), vectors).count() == 0


def test_numbers_over_ranges(spark):
    rows = spark.createDataFrame([("a" if k % 10 else "b", k, "x") for k in range(500)] + [(None, 1000, "y"), (None, 1001, "z")], "p string, o long, n0 string")
    got = {r["o"]: r["n"] for r in paging.numbered(rows.repartition(7), "p", "o").collect()}
    parts = {}
    for p, o in [("a" if k % 10 else "b", k) for k in range(500)] + [(None, 1000), (None, 1001)]:
        parts.setdefault(p, []).append(o)
    assert got == {o: i + 1 for values in parts.values() for i, o in enumerate(sorted(values))}
    assert paging.numbered(rows.limit(0), "p", "o").count() == 0


def test_even_odds(spark):
    rows = [(n, k) for n in (0, 1, 7, 10, 300, 3000) for k in (0, 1, n // 2, n) if k <= n]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", E.even_odds(F.col("n"), F.col("k")).alias("p")).collect()
    assert all(abs(r["p"] - E.two_sided_binomial(r["n"], r["k"])) < 1e-9 for r in got)


def test_status_resolution(spark):
    rows = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (3, None, "old")], "id long, law string, status string")
    statuses = spark.createDataFrame([("a", "repealed"), ("a", "repealed"), (None, "amended")], "law string, status string")
    got = {r["id"]: (r["status"], r["assumed"]) for r in loads.resolve_status(rows, statuses, "law", "active").collect()}
    assert got == {1: ("repealed", False), 2: ("active", True), 3: ("active", True)}
    assert {r["status"] for r in loads.resolve_status(rows, None, "law", "active").collect()} == {"active"}
    with pytest.raises(ValueError):
        loads.resolve_status(rows, None, "law")
    assert [r["id"] for r in loads.delete_keys(rows, statuses, "law").orderBy("id").collect()] == [2, 3]


def test_pending_migrations(spark):
    wanted = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "version long, name string, digest string")
    ledger = spark.createDataFrame([(1, "a", "x"), (2, "b", "other"), (9, "q", "w")], "version long, name string, digest string")
    assert {(r["version"], r["state"]) for r in loads.pending_migrations(wanted, ledger).collect()} == {(2, "changed"), (3, "pending"), (9, "unknown")}


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from types import SimpleNamespace

    from strataquill import session

    for master, fails in (("local", False), ("local[4]", False), ("local-cluster[2,1,512]", True), ("spark://x:7077", True)):
        folders = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda f=folders: f[0] if f else None, setCheckpointDir=folders.append)
        fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
        if fails:
            with pytest.raises(RuntimeError):
                session.shared_folder(fake)
        else:
            assert session.shared_folder(fake)


def test_no_views_are_left_behind(spark):
    from strataquill.session import run_sql

    before = {t.name for t in spark.catalog.listTables()}
    assert run_sql(spark, "SELECT count(*) AS n FROM @a@ JOIN @b@ USING (id)", a=spark.range(5), b=spark.range(3)).first()["n"] == 3
    assert {t.name for t in spark.catalog.listTables()} == before


def test_manifest(spark, tmp_path):
    from strataquill.sources import readers, sinks

    parsed = spark.createDataFrame([("a.json", "law", {"lawNumber": "1/2000"}, [{"number": 1}, {"number": 2}], ["w"]), ("b.json", "law", {"lawNumber": None}, None, None)], "file string, kind string, source struct<lawNumber:string>, articles array<struct<number:int>>, warnings array<string>")
    for _ in range(2):  # replaces what was there
        sinks.write_manifest(parsed, str(tmp_path / "m"))
    got = {r["file"]: (r["law_number"], r["n_articles"], r["n_warnings"]) for r in readers.manifest(spark, str(tmp_path / "m")).collect()}
    assert got == {"a.json": ("1/2000", 2, 1), "b.json": (None, 0, 0)}
    sinks.write_provisions(spark.range(3), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 3


def test_the_index_scores_as_worked_out_by_hand(spark):
    """Two texts of 8 and 4 four-grams: idf ln(1.2), and the share of a term in the shorter text."""
    docs = spark.createDataFrame([("en", 1, "abcdefghijk"), ("en", 2, "abcdxyz")], "language string, doc long, text string")
    got = {r["doc"]: r["score"] for r in R.search(docs, spark.createDataFrame([(1, "en", "abcd")], "q long, language string, text string")).collect()}
    import math

    idf = math.log((2 - 2 + 0.5) / (2 + 0.5) + 1)
    assert got == {d: round(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * n / 6)), 6) for d, n in ((1, 8), (2, 4))}


def test_batches_are_scanned_in_pieces_of_bounded_tokens():
    sizes = [3, 0, 4, 900, 1, 1, 1, 1, 0]
    batch = pa.RecordBatch.from_arrays([pa.array([["x"] * n for n in sizes], pa.list_(pa.string()))], ["tokens"])
    pieces = list(R._pieces(batch.slice(0), rows=3, tokens=7))
    assert [[len(t) for t in p.column("tokens").to_pylist()] for p in pieces] == [[3, 0, 4], [900], [1, 1, 1], [1, 0]]
    assert [p.num_rows for p in R._pieces(batch.slice(2, 3), tokens=4)] == [1, 1, 1] and not list(R._pieces(batch.slice(0, 0)))


def test_best_score_of_each_query_in_long_documents(spark):
    docs = spark.createDataFrame([("en", k, " ".join(["word", "term", "leaf"][k % 3 :] * 50_000 + [f"own{k}"])) for k in range(6)], "language string, doc long, text string").coalesce(1)
    queries = spark.createDataFrame([(k, "en", f"leaf term own{k}") for k in range(6)], "q long, language string, text string")
    got = {(r["q"], r["doc"], r["score"]) for r in R.search(docs, queries, 1, word_tokens).collect()}
    assert got == {(r["q"], r["doc"], r["score"]) for r in R.top_k(R.score(R.build_index(docs, word_tokens), queries), 1).collect()} and len(got) == 6


def test_queries_that_share_their_terms_are_scored_in_bounded_memory():
    # 60 documents x 100 terms x 400 queries: 2.4 million meetings, 19 MB for each number kept of all of them.
    asked = [(q, "en", t, 1) for q in range(400) for t in (*(f"w{j}" for j in range(100)), f"own{q}")]
    docs = [[f"w{j}" for j in range(100) for _ in range(1 + (d + j) % 3)] + [f"own{q}" for q in range(d, 400, 61)] for d in range(60)]
    block = R._block(pa.table(dict(zip(("q", "language", "term", "qtf"), map(list, zip(*asked))))), list(range(400)))
    df = {t: sum(t in set(d) for d in docs) for t in block.terms.to_pylist()}
    counted = {i: df[t] for i, t in enumerate(block.terms.to_pylist())} | {-1: 60, -2: sum(map(len, docs))}
    frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda scan, _: scan)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 60), pa.array(range(60)), pa.array(docs)], ["language", "doc", "tokens"])
    tracemalloc.start()
    found = pa.Table.from_batches(list(R._scored(frame, SimpleNamespace(value=block), counted, 1, 6, "long", "long")(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000

    def score(terms, doc):
        norm = 1.5 * (0.25 + 0.75 * len(doc) / (counted[-2] / 60))
        return sum(math.log((60 - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * 2.5 / (tf + norm) for t in terms if (tf := doc.count(t)))

    shared = [score([f"w{j}" for j in range(100)], d) for d in docs]
    best = [max(((round(shared[k] + score([f"own{q}"], d), 6), -k) for k, d in enumerate(docs))) for q in range(400)]
    assert {r["q"]: r["doc"] for r in found.to_pylist()} == {q: -k for q, (_, k) in enumerate(best)}
    assert {r["q"]: r["score"] for r in found.to_pylist()} == pytest.approx({q: s for q, (s, _) in enumerate(best)}, abs=2e-6)


@pytest.mark.parametrize("most", [1, 5, 100, 10**9])
def test_sums_of_documents_do_not_depend_on_where_they_are_cut(most):
    block = R._Queries(["a", "b", "c"], ["en"], np.zeros(3, int), pa.array(list("wxyz")), np.array([0, 3, 3, 5, 6]), np.array([0, 1, 2, 0, 2, 1]), np.array([1.0, 2, 1, 1, 3, 1]))
    row, slot, share = np.array([1, 1, 1, 2, 4, 4]), np.array([0, 2, 3, 1, 0, 2]), np.array([0.5, 2.0, 1.0, 7.0, 1.0, 0.25])
    want = [[0, 0, 0], [2.5, 2, 6.5], [0, 0, 0], [0, 0, 0], [1.25, 2, 1.75], [0, 0, 0]]
    assert R._sums(row, slot, share, block, 6, most).tolist() == want
    assert R._sums(row[:0], slot[:0], share[:0], block, 2, most).tolist() == [[0, 0, 0]] * 2
    empty = R._block(pa.table({"q": pa.array([], pa.int64()), "language": pa.array([], pa.string()), "term": pa.array([], pa.string()), "qtf": pa.array([], pa.int64())}), [])
    assert R._sums(row[:0], slot[:0], share[:0], empty, 2, most).shape == (2, 0)


@pytest.mark.parametrize("block", [7, 1000])
def test_own_ranks_are_those_of_a_search(spark, block):
    words = ["law", "court", "tax", "judge", "land", "lease", "road", "school", "permit", "notary"]
    rows = [(f"d{(k * 7) % 60}", ["en", "fr", None][k % 3 if k < 50 else 0], " ".join(words[(k * j) % 10] for j in (3, 7)), " ".join(words[(k * j + j) % 10] for j in range(1, 4 + k % 9))) for k in range(60)]
    rows += [("e1", "en", "nothing shared", "law court"), ("e2", "en", None, "law"), ("e3", "en", "law", None), ("e4", "fr", "tax tax road", "tax road tax")] + [(f"t{k}", "fr", "tax road", "tax road") for k in range(9)]
    frame = spark.createDataFrame(rows, "q string, language string, question string, text string").repartition(3)
    found = R.search(frame.select("language", F.col("q").alias("doc"), "text"), frame.select("q", "language", F.col("question").alias("text")), 5, word_tokens)
    want = {r[0]: None for r in rows} | {r["q"]: r["rank"] for r in found.where("q = doc").collect()}
    got = R.own_ranks(frame, 5, word_tokens, block=block)
    assert {r["q"]: r["rank"] for r in got.collect()} == want and got.count() == len(rows) and len({*want.values()}) == 6
    assert R.own_ranks(frame.limit(0), 5, word_tokens).count() == 0


def test_own_ranks_of_lines_of_roots(spark):
    rows = [(k, "en", ("", ["law law", "tax", "", "road law"][k % 4]), ("", ["law", "tax law", "road", ""][k % 4])) for k in range(16)]
    frame = spark.createDataFrame(rows, "q long, language string, question struct<text:string,stems:string>, text struct<text:string,stems:string>")
    got = {r["q"]: r["rank"] for r in R.own_ranks(frame, 3, lambda c: F.filter(F.split(c["stems"], " "), lambda w: w != "")).collect()}
    assert got == {k: {0: k // 4 + 1, 1: k // 4 + 1}.get(k % 4) if k // 4 < 3 else None for k in range(16)}


def test_slices_of_texts_are_found_without_making_them(spark):
    texts = ["", None, "abc", "abcd", "\U00010400bcd\U00010428\U00010428ef", "Éàb cdé 中文字符串", "aaaaaaa", "xyz!abcd0abcd", "bcda"]
    docs = spark.createDataFrame([("en", k, t) for k, t in enumerate(texts)] + [(None, 90, "abcd"), ("fr", 91, "abcd")], "language string, doc long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "en", "abcd abcd"), (2, "en", "\U00010428bcd\U00010428"), (3, "fr", "aaaa中文字符"), (4, "en", "aaaa中文字符"), (5, "en", "?bc")], "q long, language string, text string")
    tokens = docs.where("language IS NOT NULL").select(F.col("doc"), char_ngrams("text").alias("t")).collect()
    assert all(r["t"] == [b[i : i + 4] for i in range(len(b) - 3)] for r in tokens for b in ["".join(c for c in (dict(enumerate(texts)) | {91: "abcd"}).get(r["doc"]) or "" if c.isalnum()).lower()])
    assert R._points("a中\U00010428").tolist() == [97, 0x4E2D, 0x10428]
    for widest in (2_000_000, 0):  # by tables and by bisection
        places = R._Places(R.np.array([3, 70, 900]), widest)
        assert places.of(R.np.array([3, 4, 900, 901, 70, 10**15])).tolist() == [0, -1, 2, -1, 1, -1]
    found = {(r["q"], r["doc"], r["score"]) for r in R.search(docs, queries, 9).collect()}
    assert found == {(r["q"], r["doc"], r["score"]) for r in R.search(docs, queries, 9, lambda c: char_ngrams(c)).collect()} and {q for q, _, _ in found} == {1, 2, 4}
    assert found == {(r["q"], r["doc"], r["score"]) for r in R.top_k(R.score(R.build_index(docs), queries), 9).collect()}


def test_character_slices_do_not_pass_to_python_as_strings(spark, monkeypatch):
    kinds = []
    seen = R._scored
    monkeypatch.setattr(R, "_scored", lambda tokens, *rest: kinds.append(tokens.schema["tokens"].dataType.simpleString()) or seen(tokens, *rest))
    docs = spark.createDataFrame([("en", 1, "abcdef")], "language string, doc long, text string")
    R.search(docs, docs.select(F.col("doc").alias("q"), "language", "text"))
    assert kinds == ["string"]
