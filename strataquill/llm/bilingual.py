"""Sentence alignment in bilingual documents.

Sentences are compared by how much of each is covered by the other: numbers, names and cognates
cover themselves, other words what a lexicon says translates them. The lexicon is fitted on all
document pairs by counting co-occurrence, first in documents, then in the sentences that the
lexicon so far aligns. Per document pair, sentences that share an anchor that is rare in both texts and
prefer each other are chained by the longest increasing subsequence. Only the gaps of the chain are
compared in full, by dynamic programming, and sentences left over join where they are covered: that
finds reordered and merged ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions.labels import label_language
from strataquill.session import checkpoint
from strataquill.sources.tables import table

_END = re.compile(r"(?<=[.!?])\s+")
_NUMBER = re.compile(r"(?<=\d)[ ,.  ](?=\d{3}(?!\d))")
_TOKEN = re.compile(r"\d+(?:/\d+)*|[^\W\d_]+")


def sentences_of(text: str) -> list[str]:
    """Sentences in order: each ends at ``.``, ``?`` or ``!`` followed by white space or the end."""
    return [s for s in _END.split(text.strip()) if s]


def tokens_of(sentence: str) -> list[tuple[str, bool]]:
    """Lower-case words and numbers (without separators of thousands), with whether each is an anchor:
    a number, or a capitalised word that does not open the sentence."""
    words = _TOKEN.findall(_NUMBER.sub("", sentence))
    return [(w.lower(), w[0].isdigit() or (i > 0 and w[0].isupper() and len(w) > 2)) for i, w in enumerate(words)]


@dataclass
class Lexicon:
    """Translation strength of word pairs, and how much each word tells."""

    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    strength: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))


class Side:
    """The sentences of one text as arrays over their words."""

    def __init__(self, sentences: list[str], lexicon: Lexicon, codes: dict[str, int]):
        tokens = [tokens_of(s) or [("", False)] for s in sentences]
        flat = [w for ts in tokens for w, _ in ts]
        self.starts = np.cumsum([0] + [len(t) for t in tokens])
        self.ids = np.array([lexicon.words.get(w, -1) for w in flat], np.int64)
        self.anchors = np.array([a for ts in tokens for _, a in ts], bool)
        self.codes = np.array([codes.setdefault(w, len(codes)) for w in flat], np.int64)
        self.stems = np.array([codes.setdefault("\0" + w[:5], len(codes)) if len(w) > 5 else -1 for w in flat], np.int64)
        self.digits = np.array([w[:1].isdigit() for w in flat], bool)
        self.weights = np.where(self.anchors, 8.0, np.where(self.ids >= 0, lexicon.weights[self.ids], 1.5) if len(lexicon.weights) else 1.5)

    def words(self, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of some sentences, and where each sentence starts among them."""
        sizes = self.starts[sentences + 1] - self.starts[sentences]
        starts = np.cumsum(sizes) - sizes
        return np.repeat(self.starts[sentences] - starts, sizes) + np.arange(sizes.sum()), starts


class Comparison:
    """Coverage of sentences of two texts, worked out for the sentences asked for, a bounded number of
    pairs of words at a time."""

    def __init__(self, left: list[str], right: list[str], lexicon: Lexicon, cells: int = 4_000_000):
        codes: dict[str, int] = {}
        self.left, self.right, self.lexicon, self.cells = Side(left, lexicon, codes), Side(right, lexicon, codes), lexicon, cells
        self.whole = None
        if self.left.starts[-1] * self.right.starts[-1] <= cells // 16:  # short texts: all at once
            self.whole = self._coverage(np.arange(len(left)), np.arange(len(right)))

    def coverage(self, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares (rows, columns) of the left sentences covered by the right ones, and the other way."""
        if self.whole is not None:
            at = np.ix_(rows, columns)
            return self.whole[0][at], self.whole[1][at]
        forward, backward = np.zeros((len(rows), len(columns)), np.float32), np.zeros((len(rows), len(columns)), np.float32)
        row_parts = self._parts(self.left, rows)
        for c in self._parts(self.right, columns):
            for r in row_parts:
                forward[r[0] : r[1], c[0] : c[1]], backward[r[0] : r[1], c[0] : c[1]] = self._coverage(rows[r[0] : r[1]], columns[c[0] : c[1]])
        return forward, backward

    def _parts(self, side: Side, sentences: np.ndarray) -> list[tuple[int, int]]:
        """Runs of sentences of at most the root of ``cells`` words (or one sentence)."""
        sizes, parts, first, held = side.starts[sentences + 1] - side.starts[sentences], [], 0, 0
        for k, size in enumerate(sizes.tolist()):
            if k > first and held + size > self.cells**0.5:
                parts.append((first, k))
                first, held = k, 0
            held += size
        return [*parts, (first, len(sentences))] if len(sentences) else []

    def _coverage(self, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = self.left, self.right
        (lw, ls), (rw, rs) = left.words(rows), right.words(columns)
        li, ri = left.ids[lw], right.ids[rw]
        match = np.zeros((len(lw), len(rw)), np.float32)
        if len(self.lexicon.weights):
            match = self.lexicon.strength[np.ix_(li, ri)].astype(np.float32)
            match[li < 0] = 0
            match[:, ri < 0] = 0
        same = left.codes[lw][:, None] == right.codes[rw][None, :]
        lp, rp = left.stems[lw], right.stems[rw]
        match = np.maximum(match, np.where((lp[:, None] == rp[None, :]) & (lp >= 0)[:, None], np.float32(0.8), np.float32(0)))
        match[same & left.anchors[lw][:, None] & right.anchors[rw][None, :]] = 1
        # A number covers nothing but itself.
        match[(left.digits[lw][:, None] | right.digits[rw][None, :]) & ~same] = 0
        lv, rv = left.weights[lw], right.weights[rw]
        forward = np.add.reduceat(np.maximum.reduceat(match, rs, axis=1) * lv[:, None], ls, axis=0) / np.add.reduceat(lv, ls)[:, None]
        backward = np.add.reduceat(np.maximum.reduceat(match, ls, axis=0) * rv[None, :], rs, axis=1) / np.add.reduceat(rv, rs)[None, :]
        return forward, backward

    def anchored(self, rare: int = 8) -> list[tuple[int, int]]:
        """Pairs of sentences that share an anchor standing in at most ``rare`` sentences of either text."""
        sides = []
        for side in (self.left, self.right):
            of = np.repeat(np.arange(len(side.starts) - 1), np.diff(side.starts))
            places: dict[int, list[int]] = {}
            for code, sentence in sorted({*zip(side.codes[side.anchors].tolist(), of[side.anchors].tolist())}):
                places.setdefault(code, []).append(sentence)
            sides.append(places)
        shared = (code for code in sides[0].keys() & sides[1].keys() if len(sides[0][code]) <= rare and len(sides[1][code]) <= rare)
        return sorted({(i, j) for code in shared for i in sides[0][code] for j in sides[1][code]})


def increasing_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first number) with increasing second numbers."""
    tails: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(last[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            last.append(k)
        else:
            tails[at], last[at] = j, k
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def fill_gap(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The order-keeping 1:1 pairs of a gap with the largest sum of score above ``least``."""
    n, m = score.shape
    gain = score.astype(np.float64) - least
    steps = np.zeros((n, m), np.uint8)  # 1: the row goes without, 2: the column does, 3: a pair
    above = np.zeros(m + 1)
    for i in range(n):
        row = np.zeros(m + 1)
        paired, gains = above[:-1], gain[i]
        for j in range(m):
            best, step = above[j + 1], 1
            if row[j] > best:
                best, step = row[j], 2
            if paired[j] + gains[j] > best:
                best, step = paired[j] + gains[j], 3
            row[j + 1], steps[i, j] = best, step
        above = row
    pairs, i, j = [], n - 1, m - 1
    while i >= 0 and j >= 0:
        if steps[i, j] == 3:
            pairs.append((i, j))
            i, j = i - 1, j - 1
        elif steps[i, j] == 1:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def align(left: list[str], right: list[str], lexicon: Lexicon, least: float = 0.55, merged: float = 0.68) -> list[tuple[int, int]]:
    """Pairs (left, right) of sentence numbers from 0 that translate one another."""
    if not left or not right:
        return []
    compared = Comparison(left, right, lexicon)
    scores: dict[tuple[int, int], float] = {}
    best_left, best_right = np.zeros(len(left)), np.zeros(len(right))
    for i, j in compared.anchored():
        forward, backward = compared.coverage(np.array([i]), np.array([j]))
        scores[i, j] = value = float(forward[0, 0] + backward[0, 0]) / 2
        best_left[i], best_right[j] = max(best_left[i], value), max(best_right[j], value)
    firm = [(i, j) for (i, j), value in scores.items() if value >= least and value >= best_left[i] and value >= best_right[j]]
    pairs = increasing_chain(sorted(firm))
    edges = [(-1, -1), *pairs, (len(left), len(right))]
    for (a, b), (c, d) in zip(edges[:-1], edges[1:]):
        if c - a > 1 and d - b > 1:
            forward, backward = compared.coverage(np.arange(a + 1, c), np.arange(b + 1, d))
            pairs = pairs + [(a + 1 + i, b + 1 + j) for i, j in fill_gap((forward + backward) / 2, least)]
    done_left, done_right = {i for i, _ in pairs}, {j for _, j in pairs}
    rows, columns = (np.array([k for k in range(len(side)) if k not in done], np.int64) for side, done in ((left, done_left), (right, done_right)))
    if len(rows) and len(columns):
        forward, backward = compared.coverage(rows, columns)
        score = (forward + backward) / 2
        rest = sorted(((float(score[i, j]), -int(rows[i]), -int(columns[j])) for i, j in zip(*np.nonzero(score >= least))), reverse=True)
        for _, i, j in rest:
            if -i not in done_left and -j not in done_right:
                pairs.append((-i, -j))
                done_left.add(-i)
                done_right.add(-j)
    # A sentence that another one merges with its neighbours is covered by it.
    if len(rows := rows[[i not in done_left for i in rows.tolist()]] if len(rows) else rows):
        forward, _ = compared.coverage(rows, np.arange(len(right)))
        pairs += [(int(i), int(f.argmax())) for i, f in zip(rows, forward) if f.max() >= merged]
    if len(columns := columns[[j not in done_right for j in columns.tolist()]] if len(columns) else columns):
        _, backward = compared.coverage(np.arange(len(left)), columns)
        pairs += [(int(f.argmax()), int(j)) for j, f in zip(columns, backward.T) if f.max() >= merged]
    return sorted(set(pairs))


class _Together:
    """How often words stand together, by kind of pair: a row of counts for every word of the first language
    met so far. Rows pass on when ``cells`` are held, or one for every word where those are more."""

    def __init__(self, words: int, kinds: int, cells: int = 24_000_000):
        self.words, self.kinds = words, kinds
        self.slots, self.keys = np.full(kinds * words, -1, np.int64), np.zeros(min(kinds * words, max(words, cells // words)), np.int64)
        self.counts, self.used = np.zeros((len(self.keys), words), np.int32), 0
        self.alone, self.rows = np.zeros((kinds, 2, words), np.int64), np.zeros(kinds, np.int64)

    def add(self, kind: int, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count two bags of words that belong together."""
        self.rows[kind] += 1
        self.alone[kind, 0, left] += 1
        self.alone[kind, 1, right] += 1
        if not len(left) or not len(right):
            return
        keys = kind * self.words + left
        if self.used + np.count_nonzero(self.slots[keys] < 0) > len(self.keys):
            yield from self.passed_on()
        fresh = keys[self.slots[keys] < 0]
        self.slots[fresh] = np.arange(self.used, self.used + len(fresh))
        self.keys[self.used : self.used + len(fresh)] = fresh
        self.used += len(fresh)
        self.counts[np.ix_(self.slots[keys], right)] += 1

    def passed_on(self) -> Iterator[pa.RecordBatch]:
        """(code, n) of all rows held, which begin anew."""
        step = max(1, 1_000_000 // self.words)
        for first in range(0, self.used, step):
            part = self.counts[first : min(first + step, self.used)]
            row, column = np.nonzero(part)
            yield _codes(self.keys[first + row] * self.words + column, part[row, column])
        self.slots[self.keys[: self.used]] = -1
        self.counts[: self.used] = 0
        self.used = 0

    def totals(self) -> Iterator[pa.RecordBatch]:
        """(code, n) of single words and of pairs of bags, by codes below 0."""
        numbers = np.concatenate([self.alone.ravel(), self.rows])
        some = np.flatnonzero(numbers)
        yield _codes(-1 - some, numbers[some])


def _codes(codes: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(numbers, pa.int64())], ["code", "n"])


@dataclass
class _Packed:
    """A lexicon whose strengths are those above 0 only."""

    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    columns: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def lexicon(self) -> Lexicon:
        strength = np.zeros((len(self.words), len(self.words)), np.float32)
        strength[self.rows, self.columns] = self.values
        return Lexicon(self.words, self.weights, strength)


def fit_lexicon(pairs: DataFrame, most_words: int = 6000, rounds: int = 3) -> _Packed:
    """A lexicon from all pairs (body_a, language_a, body_b, language_b) of two languages; the first round
    counts in documents, later ones in the sentences that the lexicon so far aligns. The ``most_words`` most
    frequent words of all texts bound its size; what is counted is added up from all tasks."""
    swapped = F.col("language_a") > F.col("language_b")
    sides = [F.when(swapped, F.col(f"{n}_{y}")).otherwise(F.col(f"{n}_{x}")).alias(f"{n}_{k}") for k, x, y in ((1, "a", "b"), (2, "b", "a")) for n in ("language", "body")]
    told = pairs.where(F.col("language_a") != F.col("language_b")).select(*sides)
    words, weights = _vocabulary(told, most_words)
    if not words:
        return _Packed()
    kinds = [(r[0], r[1]) for r in told.select("language_1", "language_2").distinct().orderBy("language_1", "language_2").collect()]  # a few labels
    packed = _Packed(words, weights)
    for turn in range(rounds):
        packed = _Packed(words, weights, *_strengths(told, packed, kinds, turn))
    return packed


def _vocabulary(told: DataFrame, most_words: int) -> tuple[dict[str, int], np.ndarray]:
    """The most frequent words of all texts (those that stand once only are left out), and how much each tells."""

    def count(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
        total, within = Counter(), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([*within], pa.string()), pa.array([total[w] for w in within], pa.int64()), pa.array([*within.values()], pa.int64())], ["word", "n", "sentences"])
        for batch in batches:
            for text in (t for c in ("body_1", "body_2") for t in batch.column(c).to_pylist()):
                for sentence in sentences_of(text):
                    found = [w for w, _ in tokens_of(sentence) if not w[0].isdigit()]
                    total.update(found)
                    within.update({"", *found})  # the empty word counts the sentences
                if len(within) > most:
                    yield out()
                    total, within = Counter(), Counter()
        yield out()

    counted = told.select("body_1", "body_2").mapInArrow(count, "word string, n long, sentences long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("sentences").alias("sentences"))
    first = F.col("word") == ""
    rows = counted.where(first | (F.col("n") > 1)).orderBy(first.desc(), F.desc("n"), "word").limit(most_words + 1).collect()
    if len(rows) < 2:
        return {}, np.zeros(0, np.float32)
    counts = np.array([r["sentences"] for r in rows[1:]], float)
    return {r["word"]: k for k, r in enumerate(rows[1:])}, np.clip(np.log(rows[0]["sentences"] / np.maximum(counts, 1)), 0.3, 4).astype(np.float32)


def _strengths(told: DataFrame, packed: _Packed, kinds: list[tuple[str, str]], turn: int, tasks: int = 4, least_rows: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the translation strength above 0 by one round over all pairs.

    At most ``tasks`` tasks a core count, so that the tables to add up don't grow with the data."""
    context, n = told.sparkSession.sparkContext, len(packed.words)
    held = context.broadcast(packed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, together = held.value.lexicon(), _Together(n, len(kinds))
        at = {kind: k for k, kind in enumerate(kinds)}
        for batch in batches:
            for x, left, y, right in zip(*(batch.column(c).to_pylist() for c in ("language_1", "body_1", "language_2", "body_2"))):
                left, right = sentences_of(left), sentences_of(right)
                if not left or not right:
                    continue
                if turn == 0:
                    yield from together.add(at[x, y], _bag(" ".join(left), model.words), _bag(" ".join(right), model.words))
                    continue
                for i, j in align(left, right, model, 0.3, 0.9):
                    yield from together.add(at[x, y], _bag(left[i], model.words), _bag(right[j], model.words))
        yield from together.passed_on()
        yield from together.totals()

    counted = told.coalesce(tasks * context.defaultParallelism).mapInArrow(count, "code long, n long")
    cells = checkpoint(counted.groupBy("code").agg(F.sum("n").alias("n")))
    found = cells.where("code < 0").toArrow()  # words and kinds
    totals = np.zeros(len(kinds) * (2 * n + 1))
    totals[-1 - found.column("code").to_numpy()] = found.column("n").to_numpy()
    known = context.broadcast(totals)

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, rows = known.value[: 2 * n * len(kinds)].reshape(len(kinds), 2, n), known.value[2 * n * len(kinds) :]
        for batch in batches:
            code, both = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            kind, i, j = code // (n * n), code // n % n, code % n
            left, right, every = alone[kind, 0, i], alone[kind, 1, j], rows[kind]
            base_right, base_left = right / every, left / every
            # Agreement beyond chance, in both directions; a few more sightings count for rare words.
            to_right = np.clip((both / (left + 0.7) - base_right) / np.maximum(1 - base_right, 0.05), 0, 1)
            to_left = np.clip((both / (right + 0.7) - base_left) / np.maximum(1 - base_left, 0.05), 0, 1)
            value = np.sqrt(to_right * to_left)
            kept = (value >= 0.15) & (every >= least_rows)
            yield pa.RecordBatch.from_arrays([pa.array(i[kept], pa.int32()), pa.array(j[kept], pa.int32()), pa.array(value[kept], pa.float32())], ["i", "j", "value"])

    # At most the words by the words; a pair of words in several kinds, or in either order, has its largest value.
    found = cells.where("code >= 0").mapInArrow(strong, "i int, j int, value float").toArrow()
    for sent in (held, known):
        sent.destroy()
    i, j, value = (found.column(c).to_numpy() for c in ("i", "j", "value"))
    codes, value = np.concatenate([i.astype(np.int64) * n + j, j.astype(np.int64) * n + i]), np.concatenate([value, value])
    order = np.lexsort((-value, codes))
    codes, first = np.unique(codes[order], return_index=True)
    i, j, value = codes // n, codes % n, value[order][first]
    # A word's best translation counts in full: paraphrases share its occurrences.
    best = np.zeros(n, np.float32)
    np.maximum.at(best, i, value)
    return i.astype(np.int32), j.astype(np.int32), np.minimum(1, value / np.maximum(np.sqrt(np.maximum(best[i], best[j])), 1e-6)).astype(np.float32)


def _bag(sentence: str, words: dict[str, int]) -> np.ndarray:
    return np.unique([words[w] for w, _ in tokens_of(sentence) if w in words]).astype(int)


def document_pairs(texts: DataFrame, most_keys: int = 2_000_000) -> DataFrame:
    """Articles held as one official and one unofficial text: (text_a, text_b, body_a, body_b,
    language_a, language_b), text_a < text_b. Redelivered rows count once; null ids, articles and
    bodies are left out; several official or unofficial texts give all such pairs.

    Only official texts of articles with an unofficial one are shuffled: the keys of those are
    broadcast where there are at most ``most_keys``, and joined by a shuffle beyond."""
    columns = ["article_id", "id", "body", label_language("language").alias("language")]
    good = F.col("id").isNotNull() & F.col("article_id").isNotNull() & F.col("body").isNotNull()
    rough = texts.where(good & ~F.col("is_official")).select(*columns)
    keys = checkpoint(rough.select("article_id").distinct())
    official = texts.where(good & F.col("is_official")).select(*columns)
    official = official.join(F.broadcast(keys) if keys.count() <= most_keys else keys, "article_id", "left_semi")
    first, second = F.struct("r.id", "r.body", "r.language"), F.struct("o.id", "o.body", "o.language")
    joined = rough.alias("r").join(official.alias("o"), "article_id").select("article_id", F.array_sort(F.array(first, second)).alias("p"))
    both = [F.col("p")[k][c].alias(f"{n}_{s}") for k, s in enumerate("ab") for c, n in (("id", "text"), ("body", "body"), ("language", "language"))]
    return joined.select("article_id", *both).dropDuplicates(["article_id", "text_a", "text_b"]).drop("article_id")


def align_pairs(pairs: DataFrame) -> DataFrame:
    """Rows (text_a, sentence_a, text_b, sentence_b) of sentences that translate one another.

    Sentences number from 1. The lexicon (of the 6,000 commonest words at most) is fitted on every pair with
    both languages labelled, whatever its length; every pair is aligned. A text without sentences gives no row.
    """
    pairs = checkpoint(pairs)
    packed = pairs.sparkSession.sparkContext.broadcast(fit_lexicon(pairs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = packed.value.lexicon()
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("text_a", "text_b", "body_a", "body_b"))):
                found += [(a, i + 1, b, j + 1) for i, j in align(sentences_of(x), sentences_of(y), model)]
            columns = list(zip(*found)) if found else [[], [], [], []]
            kinds = (batch.schema.field("text_a").type, pa.int32(), batch.schema.field("text_b").type, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["text_a", "sentence_a", "text_b", "sentence_b"])

    kind = pairs.schema["text_a"].dataType.simpleString()
    return pairs.select("text_a", "text_b", "body_a", "body_b").mapInArrow(work, f"text_a {kind}, sentence_a int, text_b {kind}, sentence_b int")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence pairs of official texts and their rough translations."""
    return align_pairs(document_pairs(table(spark, folder, "article_texts")))


QUERIES = {"p7_found": p7_found}
ORACLES: dict[str, str] = {}
