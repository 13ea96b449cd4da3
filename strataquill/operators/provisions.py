"""Provisions and amendments of parsed articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.functions.classify import BLANKET, ON_PUBLICATION, any_match, provision_kind
from strataquill.functions.lawnumbers import cited_laws, normalise_law_number
from strataquill.functions.patterns import ascii_borders

# How titles and recitals name the law they change.
AMENDS_IN_TITLE = r"(?:AMENDING|MODIFYING|COMPLEMENTING|RIHINDURA|RIVUGURURA|PORTANT\s+MODIFICATION\s+DE|MODIFIANT)\b"
REVIEWED = r"(?:Isubiye\s+ku|Having\s+reviewed|Revu\s+la|Revue\s+la)\b"
NAMED_ARTICLES = r"(?:in\s+its\s+articles?|mu\s+ngingo\s+za?ryo|en\s+ses\s+articles?|ingingo\s+ya)\b([^.;]{0,80})"
_LANGUAGES = ("rw", "en", "fr")


def provisions(articles: DataFrame) -> DataFrame:
    """(law_number, number, kind, languages_agree, targets, blanket, on_publication, resolvable) of the
    articles (law_number, number, language, body) that hold a provision; the first language wins."""
    judged = articles.withColumns({"kind": provision_kind(F.col("body")), "place": F.array_position(F.array(*map(F.lit, _LANGUAGES)), F.col("language"))})
    per = judged.groupBy("law_number", "number").agg(
        F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("place"))).alias("kind"),
        (F.countDistinct("kind") <= 1).alias("languages_agree"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(cited_laws(F.col("body"), F.col("law_number")))))).alias("targets"),
        F.bool_or(any_match(F.col("body"), BLANKET)).alias("blanket"),
        F.bool_or(any_match(F.col("body"), ON_PUBLICATION)).alias("on_publication"),
    )
    return per.where(F.col("kind").isNotNull()).withColumn("resolvable", F.size("targets") > 0)


def provision_totals(found: DataFrame) -> DataFrame:
    """Provisions by kind, with how many are blanket, resolvable, or differ between languages."""
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("blanket").alias("blanket"), F.count_if("resolvable").alias("resolvable"), F.count_if(~F.col("languages_agree")).alias("disagree"))


def amendments(titles: DataFrame, articles: DataFrame) -> DataFrame:
    """(law_number, target, articles, source) from titles (law_number, title) and articles (law_number,
    heading, body): what a title amends, and what a recital reviewed; a title outranks a recital, and
    the articles named merge in numeric order. A law does not amend itself."""
    verb, recital, named = map(ascii_borders, (AMENDS_IN_TITLE, REVIEWED, NAMED_ARTICLES))
    own = normalise_law_number(F.col("law_number"))
    after = F.array_join(F.slice(F.split("title", verb), 2, 1000), " ")
    by_title = titles.where(F.col("title").rlike(verb)).select(own.alias("law_number"), normalise_law_number(after).alias("target"), F.array().cast("array<string>").alias("articles"), F.lit(True).alias("titled"))
    text = F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("body", F.lit("")))
    clauses = articles.select(own.alias("law_number"), F.explode(F.slice(F.split(text, recital), 2, 1000)).alias("clause"))
    by_recital = clauses.select("law_number", normalise_law_number(F.col("clause")).alias("target"), F.regexp_extract_all(F.regexp_extract("clause", named, 1), F.lit(r"\d{1,4}"), F.lit(0)).alias("articles"), F.lit(False).alias("titled"))
    both = by_title.unionByName(by_recital).where(F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("law_number")))
    numbers = F.transform(F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("articles")), lambda a: a.cast("int")))), lambda a: a.cast("string"))
    return both.groupBy("law_number", "target").agg(numbers.alias("articles"), F.when(F.bool_or("titled"), "title").otherwise("recital").alias("source"))
