"""Text cut off by field limits, in pure SQL.

Every value is split into words once; the hashes of its word trigrams are counted inside texts
(followed by more of the sentence) and at ends (followed by a stop). The last trigrams of values
without a final stop meet these counts by a join: a trigram frequent inside and almost never at an
end, or a last word that no text uses inside, shows a cut. Piles of unfinished values at one length
of a source (in characters or bytes), with few longer ones, show its field limit. Nothing is broadcast but the limits, whose number is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.session import checkpoint, run_sql
from strataquill.sources.tables import table

# What a sender puts behind a cut, and what ends a sentence.
_MARK = r"(\\s*(\\.\\.+|…|&hellip;|[\\[(<](\\.\\.+|…|more|suite|cont[a-z.]*|truncated|cut|ibikurikira)[\\])>]))+$"
_STOP = r"[.!?][\"»”’)\\]]*$"
# All white space and invisible characters that may stand behind a value.
_BLANK = r"concat(' \t\n\r\u000c\u000b\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\ufeff')"
_STEPS = r"""
WITH prepared AS (
  SELECT id, field, source, value, rtrim(@blank@, value) AS whole FROM @values@ WHERE id IS NOT NULL AND value IS NOT NULL
), quick AS (
  SELECT id, field, source, length(rtrim(value)) AS chars, octet_length(rtrim(value)) AS bytes, value LIKE '%\n%' AS many_lines, whole, substring_index(whole, ' ', -12) AS behind FROM prepared
  WHERE whole <> '' AND (field = 'heading' OR NOT (endswith(whole, '.') AND NOT endswith(whole, '..') OR endswith(whole, '!') OR endswith(whole, '?')))
), ends AS ( -- each LATERAL VIEW keeps the optimizer from repeating the patterns above it
  SELECT id, field, source, chars, bytes, many_lines, kept, behind <> kept AS marked, stopped, tail FROM quick
  LATERAL VIEW inline(array(struct(regexp_replace(behind, '(?i)@mark@', '') AS short))) v2
  LATERAL VIEW inline(array(struct(if(short = '', regexp_replace(whole, '(?i)@mark@', ''), short) AS kept))) v2b -- nothing but marks in the last words
  LATERAL VIEW inline(array(struct(kept RLIKE '@stop@' AS stopped, if(kept LIKE '%\n%', substring_index(kept, '\n', -1), concat(left(substring_index(whole, '\n', -1), greatest(0, length(substring_index(whole, '\n', -1)) - length(behind))), kept)) AS tail))) v3
), tailed AS (
  SELECT * FROM ends
  LATERAL VIEW inline(array(struct(field <> 'heading' AND NOT stopped AND NOT marked AND many_lines AND (
      tail RLIKE '^\\s*\\(s\\)' OR length(tail) < 60 AND tail RLIKE '[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}$'
      OR upper(tail) = tail AND tail RLIKE '\\p{L}') AS signed))) v4
)
SELECT id, field, source, chars, bytes, marked, kept, w FROM tailed
LATERAL VIEW inline(array(struct(regexp_replace(trim(kept), '\\s+', ' ') AS value))) v5
LATERAL VIEW inline(array(struct(split(concat('^ ^ ', @words@), ' ') AS w))) v6
WHERE marked AND NOT (stopped AND field <> 'heading') OR NOT stopped AND NOT signed
"""
# The words of a value: lower case, digits alike, every stop a point, no commas and colons.
_WORDS = r"translate(lower(value), '0123456789!?;\n:,', '9999999999... ')"
_LIMITS = r"""
WITH lengths AS (
  SELECT source, field, unit, n, count(*) AS pile FROM (
    SELECT DISTINCT @one@ AS one, source, field, u.unit, u.n FROM @open@ LATERAL VIEW inline(array(named_struct('unit', 'chars', 'n', chars), named_struct('unit', 'bytes', 'n', bytes))) u)
  GROUP BY source, field, unit, n
), near AS (
  SELECT *, sum(pile) OVER (PARTITION BY source, field, unit ORDER BY n RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) - pile AS around,
    coalesce(sum(pile) OVER (PARTITION BY source, field, unit ORDER BY n RANGE BETWEEN 5 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS longer FROM lengths
)
SELECT source, field, unit, n AS at FROM near WHERE pile >= 8 AND pile * 8.0 >= 5 * around AND longer <= 2 * pile AND pile * 100000 >= (SELECT sum(pile) FROM lengths)
"""
_COUNTS = r"""
SELECT k3, k1, sum(1 - terminal - cut) AS inside, sum(terminal) AS terminal FROM (
  SELECT xxhash64(heading, a, b, if(stop, left(c, length(c) - 1), c)) AS k3, xxhash64(heading, if(stop, left(c, length(c) - 1), c)) AS k1,
    if(stop OR heading AND last AND NOT at_limit, 1, 0) AS terminal, if(NOT stop AND last AND (at_limit OR NOT heading), 1, 0) AS cut
  FROM (
    SELECT heading, at_limit, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, endswith(w[i + 2], '.') AS stop, i + 3 = n AS last FROM (
      SELECT heading, at_limit, w, size(w) AS n FROM (
        SELECT v.field = 'heading' AS heading, @at_limit@ AS at_limit, split(concat('^ ^ ', @words@), ' ') AS w FROM @values@ v WHERE value IS NOT NULL)
    ) LATERAL VIEW explode(sequence(0, n - 3)) e AS i))
GROUP BY k3, k1
"""
_DECIDE = r"""
WITH last AS (
  SELECT *, field = 'heading' AS heading, element_at(w, -3) AS a, element_at(w, -2) AS b, element_at(w, -1) AS c, @at_limit_cand@ AS at_limit
  FROM @open@ v LEFT JOIN @flags@ USING (source, field)
), cand AS (
  SELECT *, xxhash64(heading, a, b, if(endswith(c, '.'), left(c, length(c) - 1), c)) AS k3, xxhash64(heading, if(endswith(c, '.'), left(c, length(c) - 1), c)) AS k1 FROM last
)@settled@
SELECT c.id, c.field, c.source, heading, at_limit, marked, right(kept, 1) AS kept, brief, phrase, rtrim('.', c) AS ending, k3, k1 FROM settled c
"""
# What the counts say about each distinct ending, and back to the values: the endings of more than 1/200
# of all values, fewer than 200, are broadcast, and the others meet in a shuffle.
_VERDICT = r"""
WITH keys AS (SELECT k3, k1, min(ending) AS ending, count(*) AS n FROM @settled@ GROUP BY k3, k1),
endings AS (SELECT DISTINCT ending FROM @settled@ WHERE (heading OR brief) AND ending <> ''),
longer AS ( -- how often words begin with an ending; only lengths that endings have are cut off
  SELECT left(word, i) AS begin, sum(n) AS n FROM (
    SELECT rtrim('.', word) AS word, count(*) AS n FROM @values@ LATERAL VIEW explode(split(@words@, ' ')) e AS word GROUP BY 1)
  LATERAL VIEW explode(filter(array(@lengths@), l -> l < length(word))) l AS i GROUP BY 1
),
begun AS (SELECT ending, n AS n_begun FROM endings JOIN longer ON ending = begin),
by3 AS (SELECT k3, sum(inside) AS i3, sum(terminal) AS t3 FROM @counts@ GROUP BY k3),
by1 AS (SELECT k1, sum(inside) AS i1, sum(terminal) AS t1 FROM @counts@ GROUP BY k1),
evidence AS (
  SELECT k.k3, k.k1, coalesce(i3, 0) AS i3, coalesce(t3, 0) AS t3, coalesce(i1, 0) AS i1, coalesce(t1, 0) AS t1, coalesce(n_begun, 0) AS n_begun, n * 200 > (SELECT sum(n) FROM keys) AS hot
  FROM keys k LEFT JOIN by3 ON k.k3 = by3.k3 LEFT JOIN by1 ON k.k1 = by1.k1 LEFT JOIN begun ON k.ending = begun.ending
), hot AS (SELECT k3, k1 FROM keys WHERE n * 200 > (SELECT sum(n) FROM keys)), judged AS (
  SELECT /*+ BROADCAST(e) */ c.*, i3, t3, i1, t1, n_begun FROM @settled@ c JOIN (SELECT * FROM evidence WHERE hot) e ON c.k3 = e.k3 AND c.k1 = e.k1
  UNION ALL
  SELECT /*+ BROADCAST(h) */ c.*, i3, t3, i1, t1, n_begun FROM (SELECT c.* FROM @settled@ c LEFT ANTI JOIN hot h ON c.k3 = h.k3 AND c.k1 = h.k1) c JOIN (SELECT * FROM evidence WHERE NOT hot) e ON c.k3 = e.k3 AND c.k1 = e.k1
)
SELECT DISTINCT id, field, source FROM judged
WHERE marked OR kept RLIKE '\\x{FFFD}$' OR kept RLIKE '[,(«“]$' OR NOT heading AND (at_limit OR kept RLIKE '[;:]$')
  OR CASE WHEN phrase THEN false
          WHEN heading AND n_begun >= 5 AND i1 <= @share@ * t1 AND t1 < @share@ * n_begun THEN true -- shares only: cuts recur as the table grows
          WHEN i3 + t3 >= 5 THEN t3 < @share@ * (i3 + t3) AND (NOT heading OR at_limit OR i3 >= 20)
          WHEN i1 + t1 >= 5 THEN t1 < @share@ * (i1 + t1) AND (NOT heading OR at_limit OR i1 >= 100)
          WHEN heading AND NOT at_limit THEN i1 = 0 AND n_begun >= 5 AND t1 < 10 * @share@ * n_begun
          ELSE NOT brief OR n_begun > 0 AND i1 + t1 = 0 END
"""
# Short values that recur, digits alike, are set phrases, unless they are the beginnings of a text that is common in full.
_SETTLED = r"""
, alike AS (
  SELECT *, sum(int(brief)) OVER (PARTITION BY if(brief, xxhash64(w), xxhash64(id))) AS n_alike FROM (
    SELECT *, size(w) - 2 < @short@ AND NOT marked AND NOT at_limit AS brief FROM cand)
), going AS (
  SELECT xxhash64(slice(w, 1, i)) AS form, count(*) AS n_going FROM (SELECT split(concat('^ ^ ', @words@), ' ', @short@ + 3) AS w FROM @values@)
  LATERAL VIEW explode(sequence(3, least(size(w) - 1, @short@ + 1))) s AS i WHERE size(w) > 3 GROUP BY 1
), settled AS (
  SELECT a.*, brief AND n_alike >= 2 AND n_alike >= @share@ * (n_alike + coalesce(n_going, 0)) AS phrase FROM alike a LEFT JOIN going ON if(brief, xxhash64(w), xxhash64(id)) = form
)"""
_UNSETTLED = ", settled AS (SELECT *, false AS brief, false AS phrase FROM cand)"


def cut_values(values: DataFrame, share: float = 0.02, short: int = 0) -> DataFrame:
    """The rows (id, field, source) of ``values`` (id, field, source, value) that were cut off.

    A value is cut if, with trailing blanks and any mark of omission taken off, it stops inside a
    character or behind a comma or opening bracket; if a mark of omission stood behind an unfinished
    sentence; if it is unfinished at a length where its source piles up unfinished values; or if its
    last trigram (where rarer than 5, its last word) ends less than ``share`` of its occurrences,
    or no text uses its last word. Values of field ``heading`` need no stop, so they must also stand
    at a field limit, behind a trigram seen 20 times or on a word seen 100 times, or on one that (but for
    ``share`` of its ends, however often it was cut there) no text uses inside and with which words begin
    that are far more frequent than itself. A signature line, a line in capitals and a
    place with date end a text. Null, empty and blank values and null ids are no case; repeated rows
    count once in the result; a null source is a source of its own; empty input gives no rows.
    Values of fewer than ``short`` words may be set phrases without a stop: those that differ in
    digits at most count once in a pile, two of them or more are whole (if others go on with them, above ``share``), and
    a last word that no text uses must be the beginning of one that some text uses.
    """
    spark = values.sparkSession
    values = values.select("id", "field", F.coalesce("source", F.lit("")).alias("source"), "value")
    steps = _STEPS.replace("@mark@", _MARK).replace("@stop@", _STOP).replace("@words@", _WORDS).replace("@blank@", _BLANK)
    unfinished = checkpoint(run_sql(spark, steps, values=values))
    one = f"if(size(w) - 2 < {short}, xxhash64(w), xxhash64(id))" if short else "id"
    flags = run_sql(spark, _LIMITS.replace("@one@", one), open=unfinished).groupBy("source", "field").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("at"))).alias("char_limits"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("at"))).alias("byte_limits")
    )
    at_limit = "coalesce(array_contains(char_limits, {}) OR array_contains(byte_limits, {}), false)"
    flags = F.broadcast(checkpoint(flags))  # a limit piles up 1/100000 of all unfinished values, so there are at most 200000
    known = values.join(flags, ["source", "field"], "left")
    counts = run_sql(spark, _COUNTS.replace("@words@", _WORDS).replace("@at_limit@", at_limit.format("length(value)", "octet_length(value)")), values=known)
    settled = _SETTLED.replace("@short@", str(short)).replace("@share@", str(share)).replace("@words@", _WORDS) if short else _UNSETTLED
    decide = _DECIDE.replace("@at_limit_cand@", at_limit.format("chars", "bytes")).replace("@settled@", settled)
    candidates = checkpoint(run_sql(spark, decide, values=values, open=unfinished, flags=flags))
    # Distinct lengths, not words: a few dozen.
    lengths = sorted(r["n"] for r in candidates.where("(heading OR brief) AND ending <> ''").select(F.length("ending").alias("n")).distinct().collect())
    verdict = _VERDICT.replace("@share@", str(share)).replace("@words@", _WORDS).replace("@lengths@", ", ".join(map(str, lengths)) or "0")
    return run_sql(spark, verdict, settled=candidates, counts=counts, values=values)


def article_values(texts: DataFrame) -> DataFrame:
    """The headings and bodies of article texts as values."""
    both = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("heading", "body")))
    return texts.select("id", "source", F.inline(both))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cut headings and bodies of ``article_texts``."""
    found = cut_values(article_values(table(spark, folder, "article_texts")))
    return found.select(F.col("id").alias("text_id"), "field")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut texts per source."""
    texts = table(spark, folder, "article_texts")
    cut = cut_values(article_values(texts)).groupBy("source").agg(F.countDistinct("id").alias("n_cut"))
    total = texts.select("id", F.coalesce("source", F.lit("")).alias("source")).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"))
    joined = total.join(cut, "source", "left").withColumn("n_cut", F.coalesce("n_cut", F.lit(0)))
    return joined.select("source", "n_texts", "n_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6).alias("share"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
ORACLES: dict[str, str] = {}
