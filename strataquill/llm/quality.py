"""Per-document text quality statistics, and what is not natural prose.

Texts are measured by Arrow kernels over the lines and words of whole batches. The prose of each
language has a robust mean and covariance: from the medians of all documents on, sums over all
documents nearer than a cutoff give the next mean and covariance, a few times over. A document's
squared Mahalanobis distance from its language's prose tells whether it is prose; each statistic has a
part in that distance, and the statistics that have the largest part name the kind: entries make a
list, cells and figures a table, unknown words, signs, odd word lengths and repetition make junk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions.labels import label_language
from strataquill.session import checkpoint
from strataquill.sources.tables import table

#: The statistics of the distance, each with the spread that is no evidence by itself: its square is
#: added to the variance, so that a statistic that prose hardly varies does not decide alone.
SPREADS = {
    "entry_words": 0.1, "row_words": 0.1, "digit_ratio": 0.08, "unknown_letters": 0.08, "symbol_ratio": 0.06, "markup": 0.1, "punctuated_lines": 0.5, "common_words": 0.4,
    "log_word_length": 0.25, "log_letters_per_word": 0.2, "log_variety": 0.35, "log_words": 1.0, "log_words_per_line": 1.0, "log_sentence_length": 1.5,
}
STATISTICS = tuple(SPREADS)
#: Which statistics speak for which kind.
KINDS = {
    "list": ("entry_words", "log_words_per_line"),
    "table": ("row_words", "digit_ratio"),
    "junk": ("unknown_letters", "symbol_ratio", "markup", "common_words", "log_word_length", "log_letters_per_word", "log_variety"),
}
REPORTED = ("words", "mean_word_length")
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_BULLET = r"^(?:[-*•–—·+o▪►]\s+|\(?(?:\d+|[a-zA-Z]|[ivxIVX]+)[.)°:]\)?\s*)"
_LEADER = r"(?:\.{3,}|…{2,}|(?:\s\.){3,}|_{3,}|\s{2,}|\t)\s*\d+$"
_STOP = r"[.!?…][\"'»”)\]]*$"
_SEPARATOR = r"\t|\||;|  +|,[^\s,]"
_ENDS = r"(?:[\p{L}]{2}|\d)[\"'»”)\]]*[.!?](?:\s|$)"
_MARKUP = r"<[^<>]+>"
_WIDE_BLANK = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _spans(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[starts[1:]] - total[starts[:-1]]


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(float)


def _flags(values: pa.Array) -> np.ndarray:
    return np.asarray(values.to_numpy(zero_copy_only=False), bool)


def _found(values: pa.Array, pattern: str) -> np.ndarray:
    return _flags(pc.match_substring_regex(values, pattern))


def _left(values: pa.Array, dropped: str) -> np.ndarray:
    """Characters left where those of the pattern are taken out."""
    return _numbers(pc.utf8_length(pc.replace_substring_regex(values, dropped, "")))


def _left_of(values: pa.Array, dropped: str, *signs: str) -> np.ndarray:
    """``_left`` where only texts that hold one of ``signs`` can hold the pattern."""
    result = _numbers(pc.utf8_length(values))
    held = np.zeros(len(values), bool)
    for sign in signs:
        held |= _flags(pc.match_substring(values, sign))
    if held.any():
        result[held] = _left(values.filter(pa.array(held)), dropped)
    return result


def _byte_counts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digits and white space of each value, from its bytes."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(values) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    starts = offsets - offsets[0] if len(values) else np.zeros(1, np.int64)
    digits, blanks = (np.diff(np.searchsorted(np.flatnonzero(kind), starts)) for kind in (data - np.uint8(48) < 10, (data == 32) | (data - np.uint8(9) < 5)))
    wide = pc.count_substring_regex(values, _WIDE_BLANK) if (data > 127).any() else None
    return digits.astype(float), blanks + (_numbers(wide) if wide is not None else 0.0)


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text in lower case: runs of letters (with an empty one where there is none)."""
    return pc.split_pattern(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")), " ")


def _line_shares(texts: pa.Array) -> dict[str, np.ndarray]:
    """Per text: lines, white-space words, sentence ends, and shares of lines and words in forms of lines.

    A row has at least two separators and at most four words a cell, or mostly digits. An entry is a
    short line without a stop, a numbered or marked line that is no sentence, or a line that leads to a
    number; a line that the next goes on with is none. Fewer than three lines hold neither.
    """
    n = len(texts)
    lists = pc.split_pattern_regex(texts, _BREAKS)
    of = np.repeat(np.arange(n), np.diff(_spans(lists)))
    line = pc.utf8_trim_whitespace(pc.replace_substring_regex(lists.flatten(), r"\p{Z}", " "))
    full = _flags(pc.not_equal(pc.utf8_length(line), 0))
    line, of = line.filter(pa.array(full)), of[full]
    starts = np.searchsorted(of, np.arange(n + 1))
    lines = np.diff(starts)
    words = _numbers(pc.list_value_length(pc.utf8_split_whitespace(line)))
    body = pc.replace_substring_regex(line, _BULLET, "", max_replacements=1)
    size = pc.utf8_length(body)
    marked = _flags(pc.and_(pc.not_equal(pc.utf8_length(line), size), pc.greater(size, 0)))
    count = _numbers(pc.list_value_length(pc.utf8_split_whitespace(body)))
    stop, leader = _found(line, _STOP), _found(line, _LEADER)
    separators, ends = _numbers(pc.count_substring_regex(line, _SEPARATOR)), _numbers(pc.count_substring_regex(line, _ENDS))
    first = pc.utf8_slice_codeunits(body, 0, 1)
    lower, upper, digit = _flags(pc.utf8_is_lower(first)), _flags(pc.utf8_is_upper(first)), _flags(pc.utf8_is_digit(first))
    follows = np.zeros(len(of), bool)
    follows[1:] = of[1:] == of[:-1]
    flowed = follows & lower & ~np.roll(stop, 1) & np.roll(upper, 1)
    flows = np.roll(follows & lower, -1) & upper
    several = lines[of] >= 3
    digits, blanks = _byte_counts(line)
    row = several & ((separators >= 2) & (words <= 4 * (separators + 1)) & (ends == 0) | (words >= 2) & (digits > 0.5 * (_numbers(pc.utf8_length(line)) - blanks)))
    short = (count <= 7) & ~stop & ~flows & ~flowed
    numbered = (marked | digit & (count > 1)) & (~stop | (count <= 6)) & (ends == 0)
    entry = several & ~row & (leader & (count <= 16) | short | numbered)
    total = np.maximum(_sums(words, starts), 1)
    return {
        "lines": np.maximum(lines, 1), "words": total, "sentences": _sums(ends, starts), "punctuated_lines": _sums(stop, starts) / np.maximum(lines, 1),
        "entry_words": _sums(words * entry, starts) / total, "row_words": _sums(words * row, starts) / total,
    }


def measure(texts: pa.Array, common: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of texts that have at least one character that is not white space."""
    n = len(texts)
    lines = _line_shares(texts)
    chars = _numbers(pc.utf8_length(texts))
    digits, blanks = _byte_counts(texts)
    visible = np.maximum(chars - blanks, 1)
    found = words_of(texts)
    starts, kinds = _spans(found), found.flatten().dictionary_encode()
    size, at = _numbers(pc.utf8_length(kinds.dictionary)), kinds.indices.to_numpy()
    known = _flags(pc.is_in(kinds.dictionary, common)) & (size > 1)
    letters, known_letters, runs = _sums(size[at], starts), _sums((known * size)[at], starts), _sums((size > 0)[at], starts)
    whole = np.maximum(_sums((size > 1)[at], starts), 1)
    tokens = pc.utf8_split_whitespace(texts)
    spans, kinds = _spans(tokens), tokens.flatten().dictionary_encode()
    codes = _distinct(np.repeat(np.arange(n), np.diff(spans)) * (len(kinds.dictionary) + 1) + kinds.indices.to_numpy())
    distinct = np.bincount(codes // (len(kinds.dictionary) + 1), minlength=n)
    fill = chars - _left_of(texts, r"\.{4,}|_{4,}|…{2,}", "....", "____", "……")  # leaders are no symbols
    words = lines["words"]
    return {
        "words": words, "mean_word_length": visible / words, "entry_words": lines["entry_words"], "row_words": lines["row_words"], "digit_ratio": digits / visible,
        "unknown_letters": np.maximum(letters - known_letters, 0) / visible, "symbol_ratio": np.maximum(visible - letters - digits - fill, 0) / visible, "markup": 1 - _left_of(texts, _MARKUP, "<") / np.maximum(chars, 1),
        "punctuated_lines": lines["punctuated_lines"], "common_words": np.where(runs > 0, _sums(known[at], starts) / whole, 1.0), "log_word_length": np.log(np.maximum(visible / words, 1)),
        # The variety of a text is its different words against those that 30 words could be.
        # Figures without any word say nothing about the length of words: they count as words of five letters.
        "log_letters_per_word": np.log(np.where(runs > 0, letters / np.maximum(runs, 1), 5.0)), "log_variety": np.log(np.maximum(distinct, 0.5) / np.minimum(words, 30)), "log_words": np.log(words),
        "log_words_per_line": np.log(words / lines["lines"]), "log_sentence_length": np.log(words / np.maximum(lines["sentences"], 0.5)),
    }


_MEASURES = (*REPORTED, *STATISTICS)


def common_words(documents: DataFrame, text_col: str = "text", share: float = 0.002, least: int = 3) -> list[str]:
    """Words of at least two letters in ``share`` of all texts: at most the mean number of distinct
    words a text divided by ``share``, which bounds what is collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of(batch.column("text"))
            kinds = found.flatten().dictionary_encode()
            size = len(kinds.dictionary)
            codes = _distinct(np.repeat(np.arange(len(found)), np.diff(_spans(found))) * max(size, 1) + kinds.indices.to_numpy())
            n = np.bincount(codes % max(size, 1), minlength=size)
            words = pa.concat_arrays([kinds.dictionary, pa.array([None], pa.string())])  # null stands for the number of texts
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, batch.num_rows).astype(np.int64))], ["word", "n"])

    counted = documents.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = checkpoint(counted.where(F.col("word").isNull() | (F.length("word") > 1)))
    texts = counted.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = counted.where(F.col("word").isNotNull() & (F.col("n") >= max(least, share * texts))).select("word").collect()
    return sorted(r["word"] for r in rows)


def text_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row of statistics per document whose text has something to see, with its named language
    (``und`` where the label names none). Null, empty and blank texts and null ids give no row."""
    common = documents.sparkSession.sparkContext.broadcast(common_words(documents, text_col))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(common.value, pa.string())
        for batch in batches:
            found = measure(batch.column("text"), known)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("language"), *(pa.array(found[m], pa.float64()) for m in _MEASURES)], ["id", "language", *_MEASURES])

    source = documents.select(F.col(id_col).alias("id"), F.coalesce(label_language(label_col), F.lit("und")).alias("language"), F.col(text_col).alias("text")).where(
        F.col("id").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]")
    )
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(work, f"id {kind}, language string, " + ", ".join(f"{m} double" for m in _MEASURES))


Model = dict[str, tuple[np.ndarray, np.ndarray]]


def contributions(batch: pa.RecordBatch, models: Model) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of the rows and their parts in the squared distance (each of shape rows, statistics)."""
    values = np.stack([_numbers(batch.column(s)) for s in STATISTICS], axis=1) if batch.num_rows else np.zeros((0, len(STATISTICS)))
    languages = np.array(batch.column("language").to_pylist(), object)
    parts = np.zeros_like(values)
    for language in set(languages.tolist()):
        mean, inverse = models.get(language) or models["und"]
        rows = languages == language
        off = values[rows] - mean
        parts[rows] = off * (off @ inverse)
    return values, parts


def prose_models(statistics: DataFrame, rounds: int = 3, cutoff: float = 40.0) -> Model:
    """Robust mean and inverse covariance of prose per language, from sums over all documents.

    The medians of all documents of a language start, so most of them must be prose; a language of
    fewer than twice as many documents as statistics takes the model of all documents together.
    """
    k = len(STATISTICS)
    spread = np.array(list(SPREADS.values())) ** 2
    medians = [F.percentile_approx(s, 0.5, 10_000).alias(s) for s in STATISTICS]
    rows = statistics.groupBy("language").agg(*medians).collect() + statistics.agg(*medians).withColumn("language", F.lit("und")).collect()
    models: Model = {r["language"]: (np.array([r[s] or 0.0 for s in STATISTICS]), np.diag(1 / spread)) for r in rows}
    upper = np.triu_indices(k)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            values, parts = contributions(batch, models)
            near = parts.sum(1) < cutoff
            languages = np.array(batch.column("language").to_pylist(), object)
            for language in set(languages[near].tolist()):
                own = values[near & (languages == language)]
                found = np.concatenate([[len(own)], own.sum(0), (own.T @ own)[upper]])
                sums[language] = sums[language] + found if language in sums else found
        names = [name for name, found in sums.items() for _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i for f in sums.values() for i in range(len(f))], pa.int32()), pa.array([x for f in sums.values() for x in f], pa.float64())], ["language", "at", "value"])

    for _ in range(rounds):
        rows = statistics.select("language", *STATISTICS).mapInArrow(gather, "language string, at int, value double").groupBy("language", "at").agg(F.sum("value").alias("value")).collect()
        each: dict[str, np.ndarray] = {}
        for r in rows:
            each.setdefault(r["language"], np.zeros(1 + k + len(upper[0])))[r["at"]] = r["value"]
        each["und"] = sum(each.values(), np.zeros(1 + k + len(upper[0])))
        models = {}
        for language, s in each.items():
            s = s if s[0] >= 2 * k else each["und"]
            n = max(s[0], 1)
            mean, covariance = s[1 : k + 1] / n, np.zeros((k, k))
            covariance[upper] = s[k + 1 :] / n
            covariance = covariance + np.triu(covariance, 1).T - np.outer(mean, mean)
            models[language] = mean, np.linalg.inv(covariance + np.diag(spread))
    return models


def quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", cutoff: float = 40.0) -> DataFrame:
    """Statistics, distance, contributions and kind (``prose``, ``list``, ``table``, ``junk``) of each document.

    A text nearer than ``cutoff`` (squared) to its language's prose is prose; any other has the kind
    whose statistics (``KINDS``) have the largest part in the distance. Null, empty and blank texts and
    null ids have no row; a document without a clear label is compared with all prose; other columns
    are ignored. A table without a single measurable text gives no rows.
    """
    statistics = checkpoint(text_statistics(documents, id_col, text_col, label_col))
    models = prose_models(statistics, cutoff=cutoff)
    columns = [[STATISTICS.index(s) for s in group] for group in KINDS.values()]
    names = np.array(list(KINDS), object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, parts = contributions(batch, models)
            distance = parts.sum(1)
            kind = np.where(distance < cutoff, "prose", names[np.stack([parts[:, c].sum(1) for c in columns], axis=1).argmax(1)])
            offsets = pa.array(np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32))
            named = pa.StructArray.from_arrays([pa.array(list(STATISTICS) * len(parts), pa.string()), pa.array(parts.ravel())], ["statistic", "part"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(distance), pa.ListArray.from_arrays(offsets, named), pa.array(kind.tolist(), pa.string())], [*batch.schema.names, "distance", "contributions", "kind"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in statistics.schema)
    return statistics.mapInArrow(judge, f"{kinds}, distance double, contributions array<struct<statistic:string,part:double>>, kind string")


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents", spread=True)).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are a list, a table or junk."""
    return _quality(spark, folder).where("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document."""
    wanted = ["mean_word_length", "symbol_ratio", "punctuated_lines", "common_words"]
    return _quality(spark, folder).select("doc_id", F.col("words").cast("long").alias("words"), *(F.round(c, 6).alias(c) for c in wanted), F.round("distance", 3).alias("distance"), "kind")


def p10_contributions(spark: SparkSession, folder: str) -> DataFrame:
    """The part of each statistic in the distance of every document."""
    return _quality(spark, folder).select("doc_id", F.inline("contributions")).select("doc_id", "statistic", F.round("part", 3).alias("part"))


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics, "p10_contributions": p10_contributions}
ORACLES: dict[str, str] = {}
