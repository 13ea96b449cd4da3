"""Missing or wrong language labels, by character language models.

One interpolated Kneser-Ney model per language is fitted on a bounded sample of labelled rows. Its
n-grams stand as sorted 64-bit hashes beside their log-probabilities, and the contexts beside their
back-off weights, so that a lookup is a binary search. The texts are cut into sentences and words
by Arrow kernels, every distinct word of a batch is scored once, and sums per sentence decide; in
bodies whose sentences disagree the best sequence of languages with a price on each change wins. What
cross-entropy is too high for any language, and how sure a difference makes, is read off held-out text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions.labels import LANGUAGES, label_language
from strataquill.sources.tables import table

_PRIME = np.uint64(1099511628211)


class CharModel:
    """An interpolated Kneser-Ney model of the characters of words, in sorted hash arrays."""

    def __init__(self, words: Counter, order: int = 5, discount: float = 0.75):
        self.order = order
        counts: list[Counter] = [Counter() for _ in range(order + 1)]
        for word, n in words.items():
            padded = f"\x02{word}\x03"
            for end in range(2, len(padded) + 1):
                low = max(0, end - order)
                if end - low == order or low == 0:
                    counts[end - low][padded[low:end]] += n
        # Lower orders count in how many contexts an n-gram ends; n-grams at a word's start keep theirs.
        for size in range(order, 1, -1):
            for gram in counts[size]:
                counts[size - 1][gram[1:]] += 1
        self.base = np.log(1.0 / (len(counts[1]) + 20))
        probability: dict[str, float] = {}
        self.tables = []
        for size in range(1, order + 1):
            total, kinds = Counter(), Counter()
            for gram, n in counts[size].items():
                total[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            weight = {h: discount * kinds[h] / total[h] for h in total}
            for gram, n in counts[size].items():
                lower = probability[gram[1:]] if size > 1 else np.exp(self.base)
                probability[gram] = (n - discount) / total[gram[:-1]] + weight[gram[:-1]] * lower
            self.tables.append((*_sorted({g: np.log(probability[g]) for g in counts[size]}), *_sorted({h: np.log(w) for h, w in weight.items()})))

    def score(self, codes: np.ndarray, since: np.ndarray) -> np.ndarray:
        """Log-probability of each code given those before it; ``since``: codes since the word's start."""
        hashes = [np.zeros(len(codes) + 1, np.uint64)]
        for size in range(1, self.order + 1):
            previous = np.concatenate([np.zeros(1, np.uint64), hashes[-1][:-1]])
            hashes.append(_step(previous[: len(codes) + 1], np.concatenate([np.zeros(1, np.uint64), codes])))
        result, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        for size in range(self.order, 0, -1):
            at = np.flatnonzero(open_ & (since >= size - 1))
            grams, values, contexts, weights = self.tables[size - 1]
            found, where = _lookup(grams, hashes[size][1:][at])
            result[at[found]] += values[where[found]]
            open_[at[found]] = False
            missed = at[~found]
            seen, where = _lookup(contexts, hashes[size - 1][:-1][missed])
            result[missed[seen]] += weights[where[seen]]
        result[open_] += self.base
        return result


def _step(previous: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (previous ^ (codes + np.uint64(1))) * _PRIME + np.uint64(0x9E3779B97F4A7C15)


def _gram_hash(gram: str) -> int:
    value = np.zeros(1, np.uint64)
    for char in gram:
        value = _step(value, np.array([ord(char)], np.uint64))
    return int(value[0])


def _sorted(entries: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([_gram_hash(g) for g in entries], np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array(list(entries.values()))[order]


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return (keys[where] == wanted) if len(keys) else np.zeros(len(wanted), bool), where


def score_words(models: list[CharModel], words: list[str]) -> np.ndarray:
    """Log-probability of each word under each model, shape (words, models)."""
    if not words:
        return np.zeros((0, len(models)))
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    since = np.arange(len(codes)) - np.repeat(starts, lengths)
    result = np.empty((len(words), len(models)))
    for m, model in enumerate(models):
        each = model.score(codes, since)
        each[starts] = 0
        result[:, m] = np.add.reduceat(each, starts)
    return result


def _pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Sentence counts of the texts, word counts of the sentences, and the words."""
    marked = pc.replace_substring_regex(pc.utf8_lower(texts), r"([.!?…]['\"»”’)\]]*)\s+", "\\1\x01")
    sentences = pc.split_pattern(marked, "\x01")
    flat = pc.utf8_trim_whitespace(pc.replace_substring_regex(sentences.flatten(), r"[^\p{L}’']+", " "))
    words = pc.split_pattern(flat, " ")
    return np.diff(sentences.offsets.to_numpy()), np.diff(words.offsets.to_numpy()), words.flatten().dictionary_encode()


def best_runs(scores: np.ndarray, price: float) -> np.ndarray:
    """The language of each sentence (rows) that maximises the sum of scores less ``price`` a change."""
    total, back = scores[0].copy(), []
    for row in scores[1:]:
        best = int(total.argmax())
        stay = total >= total[best] - price
        back.append(np.where(stay, np.arange(len(total)), best))
        total = np.where(stay, total, total[best] - price) + row
    path = [int(total.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


@dataclass
class Fitted:
    """The models, the cross-entropy (nats a character) beyond which no language is named, and the
    temperature (in characters, as a share of the text) at which differences turn into confidence."""

    models: list[CharModel]
    limit: float
    temperature: float

    def confidence(self, totals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Posterior of each language (columns) for texts (rows) of ``sizes`` characters."""
        scaled = totals / np.maximum(self.temperature * sizes, 1.0)[:, None]
        power = np.exp(np.clip(scaled - scaled.max(1, keepdims=True), -50, 0))
        return power / power.sum(1, keepdims=True)


def _totals(models: list[CharModel], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each sentence with words under each model, and its characters."""
    _, per_sentence, words = _pieces(pa.array(texts, pa.string()))
    vocabulary = words.dictionary.to_pylist()
    each, sizes = score_words(models, vocabulary), np.array([len(w) + 1 if w else 0 for w in vocabulary])
    each[sizes == 0] = 0
    ends = np.concatenate([[0], np.cumsum(per_sentence)])
    codes = words.indices.to_numpy()
    sums = np.concatenate([np.zeros((1, len(models))), np.cumsum(each[codes], axis=0)])
    chars = np.concatenate([[0], np.cumsum(sizes[codes])])
    totals, chars = sums[ends[1:]] - sums[ends[:-1]], chars[ends[1:]] - chars[ends[:-1]]
    return totals[chars > 0], chars[chars > 0]


def calibrate(models: list[CharModel], held_out: list[list[str]], kept: float = 0.999, slack: float = 1.5) -> Fitted:
    """Limit and temperature from held-out texts of each model's language.

    ``kept`` of the held-out sentences lie below the limit before ``slack`` is given for damaged text;
    the temperature is the one under which the held-out labels (some of them wrong) are most likely.
    """
    parts = [(k, *_totals(models, texts)) for k, texts in enumerate(held_out) if texts]
    if not parts:
        return Fitted(models, np.inf, 0.125)
    totals, sizes = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    labels = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
    if not len(totals):
        return Fitted(models, np.inf, 0.125)
    entropy = -totals.max(1) / sizes
    fitted = [Fitted(models, slack * float(np.quantile(entropy, kept)), t) for t in np.geomspace(0.002, 1.0, 28)]
    return min(fitted, key=lambda f: float(-np.log(np.maximum(f.confidence(totals, sizes)[np.arange(len(labels)), labels], 1e-12)).sum()))


def fit_models(labelled: DataFrame, text_col: str, label_col: str, rows_per_language: int = 1500, longest: int = 20_000, order: int = 5, held_out: int = 5) -> Fitted:
    """One calibrated model per language.

    The sample is about ``rows_per_language`` rows of each language with a clear label (never more),
    first by a hash of their text, each no longer than ``longest`` characters; this bounds what reaches
    the driver. Every ``held_out``-th row is kept for the calibration. One scan counts the labels, and
    one takes the rows.
    """
    named = labelled.select(F.col(text_col).alias("text"), label_language(label_col).alias("language"))
    counts = {r["language"]: r["n"] for r in named.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    drawn = F.lit(False)
    for language in LANGUAGES:
        share = 1.2 * rows_per_language / max(counts.get(language, 0), 1)
        drawn = drawn | (F.col("language") == language) & (place < min(1 << 30, int(share * (1 << 30))))
    rows = named.where(drawn & F.length("text").between(20, longest)).withColumn("place", place).toArrow().sort_by([("place", "ascending"), ("text", "ascending")])
    sample = {language: rows.filter(pc.equal(rows.column("language"), language)).column("text").to_pylist()[:rows_per_language] for language in LANGUAGES}
    models = []
    for texts in sample.values():
        _, _, words = _pieces(pa.array([t for k, t in enumerate(texts) if k % held_out], pa.string()))
        models.append(CharModel(Counter(w for w in words.to_pylist() if w), order))
    return calibrate(models, [texts[::held_out] for texts in sample.values()])


def detect_languages(texts: DataFrame, id_col: str, text_col: str, fitted: Fitted, price: float = 14.0) -> DataFrame:
    """Rows (id, segment, language, confidence): one row of segment 0 for a text in one language, one
    row per longest run of sentences of one language (segment 1, 2, ...) for a mixed one.

    Confidence is the posterior of the run's language at the calibrated temperature. A run whose
    cross-entropy lies beyond the calibrated limit gets a null language. Null, empty and letterless texts give
    no row; repeated rows give repeated rows; other columns are ignored.
    """

    held = texts.sparkSession.sparkContext.broadcast(fitted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        models, limit = fitted.models, fitted.limit
        for batch in batches:
            per_text, per_sentence, words = _pieces(batch.column("text"))
            if not len(words):
                continue
            vocabulary = words.dictionary.to_pylist()
            each = score_words(models, vocabulary)
            sizes = np.array([len(w) + 1 if w else 0 for w in vocabulary])
            each[sizes == 0] = 0
            codes = words.indices.to_numpy()
            ends = np.concatenate([[0], np.cumsum(per_sentence)])
            sums = np.concatenate([np.zeros((1, len(models))), np.cumsum(each[codes], axis=0)])
            sums = sums[ends[1:]] - sums[ends[:-1]]
            chars = np.concatenate([[0], np.cumsum(sizes[codes])])
            chars = chars[ends[1:]] - chars[ends[:-1]]
            bounds = np.concatenate([[0], np.cumsum(per_text)])
            winner = sums.argmax(1)
            margin = np.sort(sums, axis=1)
            clear = (margin[:, -1] - margin[:, -2]) > 0
            ids, rows = batch.column("id").to_pylist(), []
            for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                if a == b or not chars[a:b].any():
                    continue
                votes = winner[a:b][clear[a:b]]
                path = np.full(b - a, votes[0] if len(votes) else winner[a])
                if len(votes) and (votes != votes[0]).any():
                    path = best_runs(sums[a:b], price)
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), b - a]
                for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                    total, size = sums[a + x : a + y].sum(0), chars[a + x : a + y].sum()
                    language = int(path[x])
                    sure = float(fitted.confidence(total[None, :], np.array([size]))[0, language])
                    named = size and -total[language] / size <= limit
                    rows.append((ids[t], s + 1 if len(cuts) > 2 else 0, LANGUAGES[language] if named else None, sure))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (batch.schema.field("id").type, pa.int32(), pa.string(), pa.float64()))], ["id", "segment", "language", "confidence"])

    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    return source.mapInArrow(work, f"id {source.schema['id'].dataType.simpleString()}, segment int, language string, confidence double")


def label_faults(texts: DataFrame, id_col: str = "id", text_col: str = "body", label_col: str = "language") -> DataFrame:
    """Rows (id, segment, language, confidence) of the texts whose label is absent or wrong, and of
    all mixed texts. Redelivered rows count once; an unnamed language is no case."""
    fitted = fit_models(texts, text_col, label_col)
    labels = F.col(id_col).isNotNull()
    found = detect_languages(texts.where(labels).withColumn("__key", F.struct(F.col(id_col).alias("id"), label_language(label_col).alias("label"))), "__key", text_col, fitted)
    wrong = (F.col("segment") > 0) | ~F.col("language").eqNullSafe(F.col("id.label"))
    return found.where(F.col("language").isNotNull() & wrong).select(F.col("id.id").alias("id"), "segment", "language", "confidence").dropDuplicates(["id", "segment"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Article texts with an absent or wrong label, and mixed ones by runs."""
    return label_faults(table(spark, folder, "article_texts")).select(F.col("id").alias("text_id"), "segment", "language")


def p5_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every body, or of each run of a mixed one, with its confidence; null where none is clear."""
    texts = table(spark, folder, "article_texts").dropDuplicates(["id"])
    return detect_languages(texts, "id", "body", fit_models(texts, "body", "language")).select(F.col("id").alias("text_id"), "segment", "language", F.round("confidence", 6).alias("confidence"))


QUERIES = {"p5_found": p5_found, "p5_languages": p5_languages}
ORACLES: dict[str, str] = {}
