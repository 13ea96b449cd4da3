from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.operators import lines as L
from strataquill.operators import parsing as P


def as_lines(spark, texts, key="d"):
    return spark.createDataFrame([(key, k, t) for k, t in enumerate(texts)], "id string, line_no int, text string")


def test_instrument(spark):
    rows = ["LAW N° 05/2026 OF 03/02/2026", "GOVERNING THINGS", "We, the President", "Article one: Purpose", "This law governs things of all kinds.", "Article 3: Commencement", "This law comes into force on the day of its publication."]
    got = P.parse_instruments(as_lines(spark, rows).unionByName(as_lines(spark, ["x"], "e"))).collect()
    row = {r["id"]: r for r in got}
    d = row["d"]
    assert (d["title"], d["law_number"], d["kind"], d["origin"], d["promulgated_at"], d["n_articles"]) == ("LAW N° 05/2026 OF 03/02/2026 GOVERNING THINGS", "05/2026", "law", "parliamentary", "2026-02-03", 2)
    assert d["warnings"] == ["missing articles 2"] and row["e"]["warnings"] == ["no text layer"]


def test_judgment(spark):
    rows = ["SUPREME COURT", "RS/INJUST/RC 00012/2021/SC of 21 Ukwakira 2022", "Facts", "The court heard that the appeal was late.", "", "Held:", "Statutes referred to", "Law n0 22/2018 of 29/04/2018, article 158 and 20", "The judges wrote it.", "They signed it.", "More text", "Cases referred to", "RC 00001/2019/HC involving X"]
    row = P.parse_judgments(as_lines(spark, rows)).first()
    assert (row["number"], row["court"], row["decided_at"], row["language"]) == ("RS/INJUST/RC 00012/2021/SC", "supreme_court", "2022-10-21", "en")
    assert row["facts"].startswith("The court heard") and [tuple(s) for s in row["statutes"]] == [("22/2018", ["20", "158"])]
    assert row["cases"] == ["RC 00001/2019/HC"]


def test_layout(spark):
    words = {0: "itegeko mu ku kandi", 1: "the law of the court shall", 2: "le la les des loi du"}
    items = [("d", 1, 200.0 * band, 20.0 * n, 150.0, words[band], "f") for n in range(6) for band in words]
    items += [("one", 1, 10.0, 20.0 * n, 300.0, words[2], "f") for n in range(6)]
    frame = spark.createDataFrame(items, "doc string, page int, x double, y double, width double, text string, font string")
    got = {r["doc"]: r["columns"] for r in P.choose_layout(frame).collect()}
    assert got == {"d": 3, "one": 1} or got["d"] == 3


def test_wrapped_headings(spark):
    rows = [(0, "Article 1: A long", ["b"]), (1, "heading that wraps", ["b"]), (2, "(1) item", ["b"]), (3, "Body text", ["n"]), (4, "more body", ["n"]), (5, "more", ["n"]), (6, "more", ["n"])]
    lines = spark.createDataFrame([("d", *r) for r in rows], "id string, line_no int, text string, fonts array<string>")
    got = P.heading_faces(lines, F.col("text").startswith("Article")).where("wrapped").collect()
    assert [r["line_no"] for r in got] == [1]


def test_slices_and_ratios(spark):
    lines = as_lines(spark, list("abcdef"))
    spans = spark.createDataFrame([("d", "x", 1, 3), ("d", "y", 3, 6)], "id string, key string, from_line int, to_line int")
    assert [(r["key"], r["text"]) for r in P.range_slice(lines, spans).orderBy("line_no").collect()] == [("x", "b"), ("x", "c"), ("y", "d"), ("y", "e"), ("y", "f")]
    scores = spark.createDataFrame([("q", 1, 9.0), ("q", 2, 3.0), ("r", 1, 2.0)], "q string, rank int, score double")
    assert {r["q"]: r["ratio"] for r in P.peak_ratio(scores).collect()} == {"q": 3.0, "r": 99.0}
    talk = spark.createDataFrame([(1, 1, "bot", "hi"), (1, 2, "user", "u" * 120), (2, 1, "bot", "only")], "conversation int, turn int, role string, content string")
    assert {r["conversation"]: r["preview"] for r in P.preview(talk).collect()} == {1: "u" * 100 + "...", 2: "only"}
    assert L.lines_of(spark.createDataFrame([(1, None)], "i int, t string"), "i", "t").count() == 0
