from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquill.llm import bilingual, cut_text, encoding, languages, leaks, nearest, pairs, quality, scanned

EN = "the court may request the document in writing before the notary and the tenant pays a fine of the bank in accordance with this law".split()
FR = "le tribunal peut demander le document par écrit devant le notaire et le locataire paie une amende à la banque conformément à la présente loi".split()
RW = "urukiko rushobora gusaba inyandiko imbere ya noteri kandi umukodesha yishyura ihazabu ya banki hakurikijwe ibiteganywa n'iri tegeko".split()


def sentence(words, rng, n=9):
    text = " ".join(rng.choice(words) for _ in range(n))
    return text[0].upper() + text[1:] + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = [(lang, " ".join(sentence(words, rng) for _ in range(6))) for lang, words in (("en", EN), ("fr", FR), ("rw", RW)) for _ in range(60)]
    return spark.createDataFrame(rows, "language string, body string")


# 1 -----------------------------------------------------------------------------------------------


def brute(ids, vectors, k):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    cos = np.round(unit @ unit.T, 12)
    return {int(ids[i]): [int(ids[j]) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-cos[i, j], ids[j]))[:k]] for i in range(len(ids))}


def test_hilbert_curve_is_continuous():
    bits, side = 3, 8
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    order = cells[np.argsort(nearest.hilbert_keys(cells, bits))]
    assert sorted(nearest.hilbert_keys(cells, bits)) == list(range(64))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(90, 8)).astype(np.float32)
    vectors[10] = vectors[3]
    vectors[11] = 2 * vectors[3]
    vectors[40:70] = vectors[39]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [rows[5], (200, None), (201, [0.0] * 8), (202, [1.0] * 3), (None, [1.0] * 8), (203, [1.0] * 7 + [None])]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>").withColumn("gid", F.lit("clash"))
    got: dict[int, list[int]] = {}
    for r in nearest.nearest_vectors(frame, size=8, k=4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute(np.arange(90), vectors.astype(np.float64), 4)
    assert nearest.nearest_vectors(frame.limit(0), size=8).count() == 0
    assert nearest.nearest_vectors(frame.where("id = 1").limit(1), size=8).count() == 0


def test_nearest_recall_over_many_ranges(spark):
    """12,000 vectors of uneven density in ranges of about 2,000: a tight group of few
    degrees of freedom holds a third of them."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 64))
    vectors = (centres[rng.integers(0, 300, 12_000)] + 0.6 * rng.normal(size=(12_000, 64))).astype(np.float32)
    vectors[:4000] = centres[0] + 0.001 * rng.normal(size=(4000, 6)) @ rng.normal(size=(6, 64))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1)[:, None]
    asked = range(0, 12_000, 40)
    truth = {i: set(np.argsort(-np.where(np.arange(12_000) == i, -9, unit @ unit[i]), kind="stable")[:10].tolist()) for i in asked}
    got = nearest.nearest_vectors(frame, chunk=2000, sampled=4000).where("id % 40 = 0").collect()
    tight = [r["neighbour"] in truth[r["id"]] for r in got if r["id"] < 4000]
    loose = [r["neighbour"] in truth[r["id"]] for r in got if r["id"] >= 4000]
    assert len(tight) == 1000 and len(loose) == 2000
    assert np.mean(tight) >= 0.9 and np.mean(loose) >= 0.9


def test_nearest_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))], "id long, embedding array<float>")
    runs = [sorted(map(tuple, nearest.nearest_vectors(part, size=8, k=3, chunk=150, sampled=200).collect())) for part in (frame.repartition(1), frame.repartition(5, F.rand(1)))]
    assert runs[0] == runs[1]


# 2 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("answer", [None, "", " \n", "N/A", "(empty)", "<p></p>", "...", "​", "null"])
def test_empty(answer):
    assert pairs.says_nothing(answer)


@pytest.mark.parametrize("answer, copied", [("WHO EXAMINES IT?", True), ("Q: Who  examines it", True), ("You asked: who examines it?", True), ("Who examines it? Who examines it?", True), ("Who examines it? The court.", False), ("You asked: Who examines it? 30 days", False), ("The court examines it.", False)])
def test_copy(answer, copied):
    assert pairs.only_repeats("Who examines it?", answer) is copied


@pytest.mark.parametrize("answer, declined", [("I am sorry, but I cannot answer this question. Please consult a lawyer.", True), ("Malheureusement, mes sources ne contiennent rien à ce sujet.", True), ("Mbabarira, sinshobora gusubiza iki kibazo.", True), ("I am not a lawyer and cannot replace one, but here is what the text says. The bank pays a fine.", False), ("Sorry, the bank pays a fine of 30 francs within ten days of the notice given to it.", False)])
def test_refusal(answer, declined):
    assert pairs.only_declines(answer) is declined


@pytest.mark.parametrize("answer, declined", [
    ("This matter lies beyond my competence.", True), ("I have no knowledge about that topic.", True), ("Je ne saurais me prononcer sur ce point.", True), ("I'm afraid that is not something I know.", True), ("Sinzi igisubizo cy'iki kibazo.", True),
    ("We don't have any information on this. Please ask a lawyer.", True), ("Je n'ai aucune réponse à donner; adressez-vous au greffe.", True), ("The tenant cannot be made to answer for it.", False), ("I cannot give legal advice, but the deadline is 30 days.", False), ("No answer was found. The deadline is 8 days.", False),
    ("Le conseil ne donne pas son avis.", False),
])
def test_refusals_in_other_words(answer, declined):
    assert pairs.only_declines(answer) == declined


def test_beginnings_of_other_texts(spark):
    whole = [f"the court of place {k % 7} may request the document number {k} in writing before the notary" for k in range(400)]
    cut = {w[: 40 + k % 20] for k, w in enumerate(whole[:50]) if w[39 + k % 20].isalpha() and w[40 + k % 20].isalpha()}
    ends = ["the court may request it.", "the court may request it. And the bank pays.", "short", "short answer", "shorte", "yes", "yes sir"]
    frame = spark.createDataFrame([(t,) for t in [*whole, *cut, *ends, None, ""]], "answer string")
    brute = {t for t in {*whole, *cut, *ends} if t[-1] not in ".!?" and (more := [u for u in {*whole, *cut, *ends} if u != t and u.startswith(t)]) and (all(u[len(t)].isalpha() for u in more) if len(t) < 24 else any(pairs.goes_on(t, u[len(t) :], 8) for u in more))}
    assert cut <= brute
    for sampled in (0, 40, 1000):
        assert {r["text"] for r in pairs.shortened(frame, sampled=sampled).collect()} == brute


def test_defective_pairs(spark, labelled):
    rng = random.Random(4)
    whole = " ".join(sentence(EN, rng) for _ in range(4))
    q_en, q_fr = "What may the court request of the tenant before the notary?", "Que peut demander le tribunal au locataire devant le notaire?"
    rows = [(1, q_en, whole, "database"), (2, q_en, whole[:60].rstrip(), "web"), (3, q_en, " ".join(sentence(FR, rng) for _ in range(3)), "web"), (4, q_fr + " Merci de répondre en anglais.", whole, "web"), (5, q_en, None, "web"), (6, None, whole, None), (7, q_en, q_en.lower(), "web"), (8, q_en, "Nothing could be found.", "web"), (9, q_en, "30 days", "web"), (None, q_en, None, "web"), (5, q_en, None, "web"), (10, q_en, whole + " " + "x" * 50_000 + ".", "web")]
    frame = spark.createDataFrame(rows, "id long, question string, answer string, source string").withColumn("defect", F.lit("clash"))
    got = {r["id"]: r["defect"] for r in pairs.defective_pairs(frame, labelled).collect()}
    assert got == {2: "truncated", 3: "other_language", 5: "empty", 7: "copy", 8: "refusal"}
    assert pairs.defective_pairs(frame.limit(0), labelled).count() == 0


def test_short_answers_are_judged_by_evidence(spark, labelled):
    rng = random.Random(14)
    question = "What may the court request of the tenant before the notary?"
    rows = [(k, question, " ".join(sentence(EN, rng) for _ in range(4)) + " The tenant pays a fine of the bank.", "web") for k in range(200)]
    rows += [(300, question, "Guardians of an heir keep his inheritance for ten years.", "web"), (301, question, "Nobody pays anything.", "web")]
    cut = {400: "The court may request the docum", 401: "The tenant pays a fine of the", 402: "The tenant pays ...", 403: "Guardians of an heir k", 404: "G", 405: "Guardians o", 406: "Guardians of an heir keep his inh"}
    sound = ["30 days", "8 days", "Yes, within 8 days", "No", "No, 8 days is the limit", "Kigali", "The notary pays the bank"]
    rows += [(k, question, a, "web") for k, a in cut.items()] + [(500 + k, question, a, "web") for k, a in enumerate(sound)]
    got = {r["id"]: r["defect"] for r in pairs.defective_pairs(spark.createDataFrame(rows, "id long, question string, answer string, source string"), labelled).collect()}
    assert {k for k, defect in got.items() if defect == "truncated"} == set(cut)


# 4 -----------------------------------------------------------------------------------------------


def test_cut_values(spark):
    rng = random.Random(8)
    bodies = [" ".join(sentence(EN, rng, 12) for _ in range(5)) for _ in range(300)]
    rows = [(f"w{k}", "body", "s", b) for k, b in enumerate(bodies)]
    rows += [(f"l{k}", "body", "limited", b[:200] if b[199].isalnum() else b[:200].rstrip(". ") + "z" * (200 - len(b[:200].rstrip(". ")))) for k, b in enumerate(bodies[:30])]
    extra = [("e1", "body", "s", bodies[0][:90] + "..."), ("e2", "body", "s", bodies[0] + " The cour"), ("e3", "body", "s", bodies[1] + " Le �"), ("e4", "body", "s", bodies[2] + "\nDone at Kigali on 04/01/2016"), ("e5", "body", "s", bodies[3] + "\nTHE NOTARY"), ("e6", "body", "s", "  "), ("e7", "body", None, None), (None, "body", "s", "The cour"), ("e8", "heading", "s", "Definitions"), ("e9", "heading", "s", "Duties of the…"), ("e2", "body", "s", bodies[0] + " The cour"), ("ea", "body", "s", "w" * 30_000 + "."), ("eb", "body", "s", bodies[4] + " The cour" + "\n\u00a0\u200b\t" * 100), ("ec", "body", "s", bodies[5] + " The cour" + " ..." * 20), ("ed", "body", "s", bodies[6] + " The cour" + "\u00a0" * 300 + "\n"), ("ee", "body", "s", bodies[7] + "\n" * 500), ("ef", "body", "s", bodies[8][:-1] + " " + "x" * 400)]
    frame = spark.createDataFrame(rows + extra, "id string, field string, source string, value string").withColumn("w", F.lit("clash"))
    got = {(r["id"], r["field"]) for r in cut_text.cut_values(frame).collect()}
    assert {g for g in got if g[0][0] == "e"} == {("e1", "body"), ("e2", "body"), ("e3", "body"), ("e9", "heading"), ("eb", "body"), ("ec", "body"), ("ed", "body"), ("ef", "body")}
    assert sum(g[0][0] == "l" for g in got) >= 28 and not any(g[0][0] == "w" for g in got)
    assert cut_text.cut_values(frame.limit(0)).count() == 0


def test_headings_cut_often_at_the_same_place(spark):
    rng = random.Random(9)
    nouns = ["lease", "court", "notary", "budget", "school", "road", "permit", "tax"]
    rows = [(f"w{k}", "heading", "s", f"Duties of the {rng.choice(nouns)} and conditions for the {rng.choice(nouns)}") for k in range(2000)]
    rows += [(f"c{k}", "heading", "s", f"Duties of the {nouns[k % 8]} and condit") for k in range(16)]
    frame = spark.createDataFrame(rows, "id string, field string, source string, value string")
    assert {r["id"] for r in cut_text.cut_values(frame).collect()} == {f"c{k}" for k in range(16)}


# 5 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("label, language", [("EN", "en"), (" fra ", "fr"), ("rw-RW", "rw"), ("Français", "fr"), ("Kinyarwanda", "rw"), ("und", None), ("", None), (None, None), ("??", None)])
def test_labels(one, label, language):
    assert one(languages.label_language(F.lit(label).cast("string"))) == language


def test_kneser_ney_is_a_distribution():
    model = languages.CharModel(languages.Counter({"abba": 3, "baa": 2, "ab": 1}))
    letters = ["a", "b", "\x03"]
    codes = lambda text: np.array([ord(c) for c in text], np.uint64)
    for start in ("\x02", "\x02a", "\x02ab"):
        mass = sum(np.exp(model.score(codes(start + c), np.arange(len(start) + 1))[-1]) for c in letters)
        assert 0.8 < mass <= 1.0 + 1e-9


def test_language_accuracy_and_runs(spark, labelled):
    fitted = languages.fit_models(labelled, "body", "language")
    rng = random.Random(9)
    truth = [(k, lang, sentence(words, rng)) for k, (lang, words) in enumerate([("en", EN), ("fr", FR), ("rw", RW)] * 40)]
    found = languages.detect_languages(spark.createDataFrame(truth, "id long, l string, text string"), "id", "text", fitted)
    got = {r["id"]: r["language"] for r in found.collect()}
    assert sum(got[k] == lang for k, lang, _ in truth) >= 118
    en, fr, rw = (" ".join(sentence(w, rng) for _ in range(3)) for w in (EN, FR, RW))
    rows = [("a", "en", en), ("b", "fr", en), ("c", None, rw), ("d", "en", f"{en} {fr} {rw}"), ("e", "en", None), ("f", "en", ""), ("g", "en", "123 !"), ("b", "fr", en), (None, "fr", en), ("h", "fr", fr * 200)]
    faults = languages.label_faults(spark.createDataFrame(rows, "id string, language string, body string").unionByName(labelled.withColumn("id", F.lit("x"))))
    result = sorted((r["id"], r["segment"], r["language"]) for r in faults.collect() if r["id"] != "x")
    assert result == [("b", 0, "en"), ("c", 0, "rw"), ("d", 1, "en"), ("d", 2, "fr"), ("d", 3, "rw")]


def test_confidence_and_rejection_are_calibrated(spark, labelled):
    fitted = languages.fit_models(labelled, "body", "language")
    rng = random.Random(10)
    texts = [(k, lang, sentence(words, rng, 1 + k % 4)) for k, (lang, words) in enumerate([("en", EN), ("fr", FR), ("rw", RW)] * 120)]
    noise = [(10_000 + k, "en", "".join(rng.choice("qxzjvkw") for _ in range(40))) for k in range(20)]
    got = {r["id"]: r for r in languages.detect_languages(spark.createDataFrame(texts + noise, "id long, l string, text string"), "id", "text", fitted).collect()}
    assert all(got[k]["language"] is None for k, _, _ in noise)
    named = [(got[k]["confidence"], got[k]["language"] == lang) for k, lang, _ in texts if got[k]["language"]]
    assert len(named) >= 0.97 * len(texts) and all(1 / 3 <= c <= 1 for c, _ in named)
    assert abs(np.mean([c for c, _ in named]) - np.mean([right for _, right in named])) < 0.05
    empty = languages.fit_models(labelled.limit(0), "body", "language")
    assert languages.detect_languages(spark.createDataFrame(texts[:3], "id long, l string, text string"), "id", "text", empty).count() == 3


# 6 -----------------------------------------------------------------------------------------------


def test_restored_page():
    known = scanned.Vocabulary(dict.fromkeys("the court examines document of tenant vice-president and pays notary employer non-resident".split(), 50))
    page = "The court exa-\n— 7 —\n    Bulletin n° 2 du 01/02/2003\nmines the docurnent of the vice-\npresident and\n— 8 —\n    Bulletin n° 2 du 01/02/2003\nthe em¬\nployer pays."
    text, noise = scanned.restore_text(page, known, frozenset())
    assert text == "The court examines the document of the vice-president and the employer pays."
    assert set(noise) == {("page", "— 7 —"), ("page", "— 8 —"), ("header", "Bulletin n° 2 du 01/02/2003"), ("hyphen", "examines"), ("misread", "document"), ("hyphen", "vice-president"), ("hyphen", "employer")}
    plain = "The court examines\nthe document.\n\nThe notary pays."
    assert scanned.restore_text(plain, known, frozenset()) == ("The court examines the document.\n\nThe notary pays.", [])


def test_page_matter_at_the_edges():
    body = ["the court examines the document of the", "tenant and the vice-president pays the", "notary before the employer asks the", "court for the document of the tenant"]
    title = "THE OFFICIAL GAZETTE"
    text = [title, *body, "10432", title, *body, "10433", "THE 0FFICIAL GAZETTE", *body[:3], "court for it.", "10434"]
    assert scanned.page_matter(text, frozenset()) == {0: "header", 6: "header", 12: "header", 5: "page", 11: "page", 17: "page"}
    fees = ["Fees of the office", "CIVIL STATUS", "12", "LAND TITLES", "40", "Companies and associations", "13", "Notaries in the districts", "55"]
    assert scanned.page_matter(fees, frozenset({"9"})) == {}
    single = [*body, "7", *body[:3], "court for it."]
    assert scanned.page_matter(single, frozenset({"9"})) == {4: "page"} and scanned.page_matter(single, frozenset()) == {}
    refrain = ["The tenant pays the notary 3", "times a year.", "It is so.", "The tenant pays the notary 4", "times a year."]
    assert scanned.page_matter(refrain, frozenset()) == {}


def test_long_words_are_corrected():
    long = "incompatibilités-électroniques-interministérielles-extraordinairement"
    known = scanned.Vocabulary({long: 9, "court": 5})
    assert scanned.corrected(long.replace("m", "rn", 1).replace("l", "1", 1), known) == long
    assert scanned.corrected("x" * 5000, known) is None and known.begins("cou") and not known.begins("cow")


def test_every_text_is_restored(spark):
    frame = spark.createDataFrame([("a", "body", "The court\npays."), ("b", "body", "The notary."), ("c", "body", None)], "id string, field string, value string")
    assert {r["id"]: r["text"] for r in scanned.restore_pages(frame, everything=True).collect()} == {"a": "The court pays.", "b": "The notary."}


def test_restore_pages(spark):
    rng = random.Random(2)
    rows = [(f"w{k}", "body", " ".join(sentence(EN, rng) for _ in range(4))) for k in range(120)]
    rows += [("a", "body", "The court may request the doc-\nument in wri\xad\nting before the n0tary."), ("b", "heading", None), ("c", "body", ""), (None, "body", "The c0urt."), ("a", "body", "The court may request the doc-\nument in wri\xad\nting before the n0tary."), ("d", "body", "The court may request the docum"), ("e", "body", "the " * 20_000 + "c0urt.")]
    frame = spark.createDataFrame(rows, "id string, field string, value string").withColumn("noise", F.lit("clash"))
    got = {(r["id"], x["noise"], x["restored"]) for r in scanned.restore_pages(frame).collect() for x in r["noise"]}
    assert got == {("a", "hyphen", "document"), ("a", "hyphen", "writing"), ("a", "misread", "notary"), ("e", "misread", "court")}
    assert scanned.restore_pages(frame.limit(0)).count() == 0


# 7 -----------------------------------------------------------------------------------------------


def translated(spark):
    nouns = [("court", "tribunal"), ("bank", "banque"), ("seller", "vendeur"), ("buyer", "acheteur"), ("heir", "héritier"), ("judge", "juge"), ("tenant", "locataire"), ("builder", "constructeur")]
    verbs = [("examines", "étudie"), ("rejects", "refuse"), ("keeps", "conserve"), ("pays", "verse"), ("sells", "cède"), ("signs", "paraphe")]
    rng = random.Random(1)
    rows, truth = [], {}
    for k in range(150):
        made = [(rng.choice(nouns), rng.choice(verbs), rng.choice(nouns), rng.randint(2, 900)) for _ in range(5)]
        a = [f"The {s[0]} {v[0]} the {o[0]} within {n} days." for s, v, o, n in made]
        b = [f"Le {s[1]} {v[1]} le {o[1]} sous {n} jours." for s, v, o, n in made]
        order = list(range(5))
        if k % 3 == 0:
            order[1], order[3] = order[3], order[1]
        if k % 4 == 0:
            order.remove(2)
        truth[k] = {(i + 1, order.index(i) + 1) for i in order}
        rows += [(f"a{k}", f"t{k}", "en", " ".join(a), True), (f"b{k}", f"t{k}", "fr", " ".join(b[i] for i in order), False)]
    return spark.createDataFrame(rows, "id string, article_id string, language string, body string, is_official boolean"), truth


def test_long_texts_are_aligned_from_anchors():
    """3,000 sentences (30,000 words) a side: without chaining first, all pairs of words would be 9e8."""
    rng = random.Random(4)
    left = [f"{sentence(EN, rng)[:-1]} {1000 + k}." for k in range(3000)]
    right = [f"{sentence(FR, rng)[:-1]} {1000 + k}." for k in range(3000)]
    del right[700]
    pairs_ = bilingual.align(left, right, bilingual.Lexicon(), least=0.2)
    assert [p for p in pairs_ if p[0] < 700] == [(k, k) for k in range(700)] and (2999, 2998) in pairs_ and len(pairs_) == 2999


def test_coverage_is_the_same_in_parts():
    rng = random.Random(5)
    left, right = [sentence(EN, rng) for _ in range(9)], [sentence(EN, rng) for _ in range(7)]
    whole, parts = bilingual.Comparison(left, right, bilingual.Lexicon()), bilingual.Comparison(left, right, bilingual.Lexicon(), cells=200)
    assert whole.whole is not None and parts.whole is None
    for a, b in zip(whole.coverage(np.arange(9), np.arange(7)), parts.coverage(np.arange(9), np.arange(7))):
        assert np.allclose(a, b)


def test_alignment(spark):
    texts, truth = translated(spark)
    noise = spark.createDataFrame([("z1", "zz", "en", None, True), ("z2", "zz", "fr", "Le juge.", False), (None, "zy", "fr", "x.", False), ("b0", "t0", "fr", texts.where("id = 'b0'").first()["body"], False)], texts.schema)
    rows = bilingual.align_pairs(bilingual.document_pairs(texts.unionByName(noise).withColumn("text_a", F.lit("clash")))).collect()
    found: dict[int, set] = {}
    for r in rows:
        assert r["text_a"] < r["text_b"]
        found.setdefault(int(r["text_a"][1:]), set()).add((r["sentence_a"], r["sentence_b"]))
    right = sum(len(found.get(k, set()) & truth[k]) for k in truth)
    assert right / sum(map(len, truth.values())) > 0.97 and right / sum(map(len, found.values())) > 0.97
    assert bilingual.align_pairs(bilingual.document_pairs(texts.limit(0))).count() == 0
    assert bilingual.increasing_chain([(0, 2), (1, 0), (2, 1), (3, 3)]) == [(1, 0), (2, 1), (3, 3)]


def test_the_lexicon_counts_every_pair_of_documents(spark):
    """3,400 pairs; the words of the last 400 by hash, and those of texts over 20,000 characters, stand nowhere else."""
    ids = spark.range(3400).select(F.concat(F.lit("a"), "id").alias("text_a"), F.concat(F.lit("b"), "id").alias("text_b"))
    order = [(r[0], r[1]) for r in ids.orderBy(F.xxhash64("text_a", "text_b"), "text_a", "text_b").collect()]
    rng = random.Random(3)
    letters = lambda k: "".join("bcdfghjklm"[int(c)] + "aeiouaeiou"[int(c)] for c in str(k))
    rows, truth = [], set()
    for k, (a, b) in enumerate([*order, *((f"a{3400 + k}", f"b{3400 + k}") for k in range(20))]):
        words = range(100, 130) if k < 3000 else range(200, 230) if k < 3400 else range(300, 330)
        made = [rng.sample(words, 5) for _ in range(2)]
        left, right = ([" ".join(f"{side}{letters(w)}" for w in m) + "." for m in made] for side in "xz")
        swap = k % 2
        body = " " * (20_001 * (k >= 3400)) + " ".join(right[::-1] if swap else right)
        rows.append((a, " ".join(left), "en", b, body, "fr") if k % 3 else (a, body, "fr", b, " ".join(left), "en"))
        truth |= {(a, i, b, 3 - i if swap else i) for i in (1, 2)}
    pairs_ = spark.createDataFrame(rows, "text_a string, body_a string, language_a string, text_b string, body_b string, language_b string").repartition(3)
    found = {tuple(r) for r in bilingual.align_pairs(pairs_).collect()}
    late = {a for a, _ in order[3000:]} | {f"a{3400 + k}" for k in range(20)}
    for some in (found & truth, {t for t in found & truth if t[0] in late}, {t for t in found & truth if int(t[0][1:]) >= 3400}):
        assert len(some) > 0.95 * (2 * 3420 if some == found & truth else 840 if len(some) > 40 else 40)
    assert len(found & truth) > 0.97 * len(found)


def test_words_are_counted_together_whatever_is_held_at_once(spark):
    rng = np.random.default_rng(2)
    bags = [(int(rng.integers(2)), np.unique(rng.integers(9, size=rng.integers(6))), np.unique(rng.integers(9, size=rng.integers(6)))) for _ in range(60)]
    counted = []
    for cells in (24_000_000, 1):
        together, sums = bilingual._Together(9, 2, cells), {}
        batches = [batch for bag in bags for batch in together.add(*bag)]
        assert bool(batches) == (cells == 1)
        for batch in (*batches, *together.passed_on(), *together.totals()):
            for code, n in zip(*(batch.column(c).to_pylist() for c in ("code", "n"))):
                sums[code] = sums.get(code, 0) + n
        counted.append(sums)
    whole = {}
    for kind, left, right in bags:
        for code in [*((kind * 9 + i) * 9 + j for i in left for j in right), *(-1 - kind * 18 - i for i in left), *(-10 - kind * 18 - j for j in right), -37 - kind]:
            whole[code] = whole.get(code, 0) + 1
    assert counted[0] == counted[1] == whole


def test_a_lexicon_is_the_same_whatever_the_partitions(spark):
    pairs_ = bilingual.document_pairs(translated(spark)[0])
    one, many = (bilingual.fit_lexicon(pairs_.repartition(n)) for n in (1, 5))
    assert one.words == many.words and {"the", "le", "court", "tribunal"} <= one.words.keys()
    for name in ("weights", "rows", "columns", "values"):
        assert np.array_equal(getattr(one, name), getattr(many, name))
    strength = one.lexicon().strength
    assert strength[one.words["court"]].argmax() == one.words["tribunal"] and np.array_equal(strength, strength.T)


# 8 -----------------------------------------------------------------------------------------------


def test_encoding_equals_the_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = encoding.read_ranks(encoding.RANKS)
    public = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    texts = ["".join(rng.choice("abeé ß\n\t123<|endoftext|>中😀.,'sing") for _ in range(rng.randint(0, 300))) for _ in range(400)]
    texts += ["x" * 5000, "ab" * 3000, " ", "", None, "<|endoftext|>", "  \n", "".join(rng.choice("etaoin") for _ in range(4000))]
    got = {r["id"]: list(r["ids"]) for r in encoding.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))).collect()}
    assert all(got[k] == public.encode_ordinary(t or "") for k, t in enumerate(texts)) and len(got) == len(texts)
    assert all(public.decode(got[k]) == (t or "") for k, t in enumerate(texts))
    word = "".join(rng.choice("etaoins") for _ in range(700)).encode()
    assert encoding.merge_short(word, ranks) == encoding.merge_long(word, ranks)


# 9 -----------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}é" for _ in range(n)]
    items = {k: fresh(60) for k in range(4)}
    changed = [w if k % 12 else "other" for k, w in enumerate(items[0])]
    garbled = [w if k % 4 else "other" for k, w in enumerate(items[1])]
    docs = [(1, " ".join(fresh(40) + items[0] + fresh(40))), (2, " , ".join(w.upper().replace("É", "E") for w in changed)), (3, " ".join(garbled)), (4, " ".join(fresh(30) + items[2][10:45])), (5, " ".join(items[2][:25])), (6, None), (7, ""), (8, " ".join(items[3][::-1])), (9, " ".join(fresh(30_000) + items[3])), (1, " ".join(items[0])), (None, " ".join(items[0]))]
    tests = [(k, " ".join(v)) for k, v in items.items()] + [(90, None), (91, ""), (92, "two words"), (0, " ".join(items[0]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    found = leaks.find_leaks(frame, spark.createDataFrame(tests, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 0), (2, 0), (4, 2), (9, 3)}
    blocks = leaks.find_leaks(frame, spark.createDataFrame(tests, "item_id long, text string"), block=1)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == {(1, 0), (2, 0), (4, 2), (9, 3)}
    assert leaks.find_leaks(frame, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leaks.find_leaks(frame.limit(0), spark.createDataFrame(tests, "item_id long, text string")).count() == 0


def test_leaks_with_clustered_edits_short_items_and_repeated_parts(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
    long, short, twice, single = fresh(200), fresh(8), fresh(60), fresh(100)
    hole = long[:93] + fresh(15) + long[108:]
    broken = long[:93] + fresh(30) + long[123:]
    repeated = twice[:20] + fresh(50) + [w if k != 10 else "other" for k, w in enumerate(twice)][:35]
    comb = [w if not 40 <= k < 54 or k % 2 else "other" for k, w in enumerate(single)]
    docs = [(1, " ".join(hole)), (2, " ".join(broken[60:150])), (3, " ".join(fresh(9) + short[2:6] + fresh(9))), (4, " ".join(repeated)), (5, " ".join(comb[20:75])), (6, " ".join(short[:3]))]
    tests = [(0, " ".join(long)), (1, " ".join(short)), (2, " ".join(twice)), (3, " ".join(single))]
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 0), (3, 1), (4, 2)}
    # 55 words with 7 replaced are more than one in ten; all 100 words with the same 7 are a leak.
    assert leaks.best_stretch(leaks.word_codes(" ".join(single)), leaks.word_codes(" ".join(comb))) == 93


def test_least_seeds_hold_for_every_item_length():
    for n in range(5, 120):
        size = leaks.seed_size(n, 0.5, 0.1)
        assert leaks.least_seeds(n, size) >= 1
        for length in range(-(-n // 2), n + 1):
            edits = int(0.1 * length)
            assert length - size + 1 - size * edits >= leaks.least_seeds(n, size)


def test_tiles_do_not_overlap():
    item, text = np.array([1, 2, 3, 4, 5, 6], np.uint64), np.array([4, 5, 6, 9, 1, 2, 3, 4], np.uint64)
    assert leaks.greedy_tiles(item, text) == [(0, 4, 4), (4, 1, 2)]


# 10 ----------------------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(5)
    rows = [(k, "en", " ".join(sentence(EN, rng) for _ in range(rng.randint(3, 9)))) for k in range(150)]
    words = sorted(set(EN))
    made = {
        900: ("list", "\n".join(f"- the {rng.choice(words)}" for _ in range(12))), 901: ("table", "\n".join(f"{rng.choice(words)} | {rng.randint(1, 999)} | {rng.randint(1, 999)} | x" for _ in range(9))),
        902: ("junk", " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz01") for _ in range(6)) for _ in range(60))), 903: ("junk", "menu | " * 50), 904: ("prose", " ".join(sentence(EN, rng) for _ in range(5)).upper()),
        905: ("prose", "\n".join(" ".join(sentence(EN, rng) for _ in range(6)).split(" ", 6))), 906: ("prose", " ".join(sentence(EN, rng) for _ in range(4)) + "\n- the bank\n- the court\n"), 907: ("list", "\n".join(f"Duties of the {w} ........ {k}" for k, w in enumerate(words))),
        908: ("prose", "The court."), 909: ("junk", "<div class='a'><span id=1></span></div>" * 20),
    }
    rows += [(k, "en", t) for k, (_, t) in made.items()] + [(950, "en", None), (951, None, ""), (952, "en", " \n\t"), (None, "en", "x y z.")]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("kind", F.lit("clash"))
    got = {r["id"]: r for r in quality.quality(frame).collect()}
    assert {k: got[k]["kind"] for k in made} == {k: kind for k, (kind, _) in made.items()}
    assert sum(r["kind"] == "prose" for k, r in got.items() if k < 150) == 150 and not {950, 951, 952, None} & got.keys()
    row = got[0]
    assert row["distance"] == pytest.approx(sum(p["part"] for p in row["contributions"])) and row["words"] == len(rows[0][2].split())
    assert quality.quality(frame.limit(0)).count() == 0


def test_only_llm_modules_import_this_package():
    import pathlib

    root = pathlib.Path(quality.__file__).parents[1]
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "strataquill.llm" not in path.read_text(), path
