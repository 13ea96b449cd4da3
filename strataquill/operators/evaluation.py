"""Measures of retrieval and translation quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recall_at(ranks: DataFrame, cuts: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Share (percent) of rows (rank, null where not found) within each cut, and the number of rows."""
    return ranks.agg(F.count(F.lit(1)).alias("n"), *(F.round(100 * F.avg(F.when(F.col("rank") <= c, 1.0).otherwise(0.0)), 6).alias(f"recall_{c}") for c in cuts))


def best_cut(scores: DataFrame, width: float = 1.0) -> DataFrame:
    """(language, cut, value) from scores (language, score, signal): the lowest of the scores that
    maximise the share of signal kept (at least the cut) plus twice the share of noise rejected.

    The numbers below each score are summed in two steps, over slices of ``width`` and inside a slice,
    so no task meets all scores of a language."""
    totals = scores.groupBy("language").agg(F.count_if("signal").alias("n_signal"), F.count_if(~F.col("signal")).alias("n_noise"))
    distinct = scores.groupBy("language", "score").agg(F.count_if("signal").alias("s"), F.count_if(~F.col("signal")).alias("x")).withColumn("slice", F.floor(F.col("score") / width))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    slices = distinct.groupBy("language", "slice").agg(F.sum("s").alias("s"), F.sum("x").alias("x"))
    slices = slices.select("language", "slice", *(F.coalesce(F.sum(c).over(before("language", "slice")), F.lit(0)).alias(f"{c}_slices") for c in "sx"))
    inside = distinct.select("language", "slice", "score", *(F.coalesce(F.sum(c).over(before("language", "slice", "score")), F.lit(0)).alias(f"{c}_inside") for c in "sx"))
    counted = inside.join(slices, ["language", "slice"]).join(F.broadcast(totals), "language")
    kept, rejected = F.col("n_signal") - F.col("s_slices") - F.col("s_inside"), F.col("x_slices") + F.col("x_inside")
    value = kept / F.greatest("n_signal", F.lit(1)) + 2 * rejected / F.greatest("n_noise", F.lit(1))
    return counted.withColumn("value", F.round(value, 9)).groupBy("language").agg(F.max_by("score", F.struct("value", -F.col("score"))).alias("cut"), F.max("value").alias("value"))


def floors(scores: DataFrame, margin: float = 1.02) -> DataFrame:
    """(language, floor): the best cut, or the noise ceiling with a margin if that is higher, rounded up."""
    ceiling = scores.groupBy("language").agg(F.max(F.when(~F.col("signal"), F.col("score"))).alias("noise"))
    return best_cut(scores).join(ceiling, "language").select("language", F.ceil(F.greatest("cut", F.coalesce(F.col("noise") * margin, F.lit(0.0)))).alias("floor"))


def two_sided_binomial(n: int, k: int) -> float:
    """Exact probability of a split at least as uneven as k of n with even odds."""
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    return min(1.0, 2 * tail)


def even_odds(n: Column, k: Column) -> Column:
    """``two_sided_binomial`` of columns: each term of the tail from the one before, in logarithms."""
    tail = F.sequence(F.lit(0).cast("long"), F.least(k, n - k))
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("total"))
    step = lambda s, i: F.struct((s["term"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("term"), (s["total"] + F.exp(s["term"])).alias("total"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(tail, start, step, lambda s: s["total"])))


def mcnemar(hits_a: DataFrame, hits_b: DataFrame, key: str = "q") -> DataFrame:
    """(only_a, only_b, both, p) of two sets of keys that were answered; ``p`` is the exact two-sided
    probability of a split at least as uneven where the sets differ by chance."""
    a, b = hits_a.select(key).distinct().withColumn("a", F.lit(True)), hits_b.select(key).distinct().withColumn("b", F.lit(True))
    joined = a.join(b, key, "full_outer")
    counted = joined.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
    return counted.withColumn("p", even_odds(F.col("only_a") + F.col("only_b"), F.col("only_a")))


def _ngrams(items: Column, n: int) -> Column:
    """Joined n-grams of an array (empty where it is shorter)."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), "\u0001"))


def chrf(pairs: DataFrame, chars: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """(id, chrf) of pairs (id, hypothesis, reference): the mean precision and recall of character and
    word n-grams up to their orders, as a harmonic mean weighted towards recall, times 100.

    Characters count without white space and with their case, words in lower case. An order longer
    than the reference is skipped; a side without characters scores 0, as does a null side.
    """
    bare = {s: F.filter(F.split(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", ""), ""), lambda c: c != "") for s in ("hypothesis", "reference")}
    split = {s: F.filter(F.split(F.lower(F.trim(F.coalesce(s, F.lit("")))), r"\s+"), lambda w: w != "") for s in ("hypothesis", "reference")}
    sides = pairs.select("id", *(bare[s].alias(f"c_{s}") for s in bare), *(split[s].alias(f"w_{s}") for s in split))
    orders = [("c", n) for n in range(1, chars + 1)] + [("w", n) for n in range(1, words + 1)]
    grams = sides.select(
        "id", (F.size("c_hypothesis") > 0).alias("said"), (F.size("c_reference") > 0).alias("meant"),
        F.explode(F.array(*(F.struct(F.lit(f"{kind}{n}").alias("order"), _ngrams(F.col(f"{kind}_hypothesis"), n).alias("h"), _ngrams(F.col(f"{kind}_reference"), n).alias("r")) for kind, n in orders))).alias("o"),
    ).where(F.size("o.r") > 0)
    each = grams.select("id", "said", "meant", "o.order", F.explode(F.concat(F.transform("o.h", lambda g: F.struct(g.alias("g"), F.lit(1).alias("h"), F.lit(0).alias("r"))), F.transform("o.r", lambda g: F.struct(g.alias("g"), F.lit(0).alias("h"), F.lit(1).alias("r"))))).alias("x"))
    counted = each.groupBy("id", "said", "meant", "order", "x.g").agg(F.sum("x.h").alias("h"), F.sum("x.r").alias("r"))
    per_order = counted.groupBy("id", "said", "meant", "order").agg(F.sum(F.least("h", "r")).alias("shared"), F.sum("h").alias("h"), F.sum("r").alias("r"))
    means = per_order.groupBy("id", "said", "meant").agg(F.avg(F.when(F.col("h") > 0, F.col("shared") / F.col("h")).otherwise(0.0)).alias("p"), F.avg(F.col("shared") / F.col("r")).alias("q"))
    b2 = beta * beta
    value = F.when(F.col("said") & F.col("meant") & (F.col("p") + F.col("q") > 0), 100 * (1 + b2) * F.col("p") * F.col("q") / (b2 * F.col("p") + F.col("q"))).otherwise(0.0)
    return pairs.select("id").join(means.select("id", value.alias("chrf")), "id", "left").select("id", F.coalesce("chrf", F.lit(0.0)).alias("chrf"))


def grounding(answers: DataFrame, sources: DataFrame, words: Column) -> DataFrame:
    """(id, rate): share of an answer's words (with repeats) that its source of the same id has."""
    said = answers.select("id", F.explode(words).alias("w"))
    known = sources.select("id", F.explode(words).alias("w")).distinct().withColumn("known", F.lit(1))
    return said.join(known, ["id", "w"], "left").groupBy("id").agg(F.avg(F.coalesce("known", F.lit(0))).alias("rate"))


def lower_quantile(column: str, share: float) -> Column:
    """Element min(n - 1, floor(share * n)) of the sorted values of ``column``: counted from above it is the
    discrete percentile ``1 - share``, which keeps only the distinct values and their counts."""
    return F.expr(f"percentile_disc({1 - share}) WITHIN GROUP (ORDER BY {column} DESC)")


def upper_median(column: str) -> Column:
    """Element floor(n / 2) of the sorted values of ``column``: the upper of two middle ones."""
    return lower_quantile(column, 0.5)
