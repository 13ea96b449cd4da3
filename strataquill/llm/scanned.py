"""Noise in text from scanned pages: page matter, words broken over lines, misread characters.

Three passes, each over whole texts. The first counts the corpus vocabulary with Arrow kernels; only
words above a relative frequency, hence at most its inverse many, reach the workers. The second finds
page numbers as running sequences and running titles by fuzzy repetition at page edges, and counts the
shapes of both; a shape borne by a share of all such texts is page matter also where a text has but one
page of it. The third restores each text: it drops page matter, joins lines by the vocabulary, and
repairs unknown words that a usual confusion of characters turns into known ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.llm.cut_text import article_values
from strataquill.session import checkpoint
from strataquill.sources.tables import table

EDGES = ".,;:!?()[]«»\"…“”"
HYPHENS = "-­¬‐"
_BROKEN = re.compile(rf"[^\W\d_]['’]?[{HYPHENS}]$")
_PAGE = re.compile(r"^[\W_]*(?:\d+|\d+\s*/\s*\d+|[^\W\d_]+\.?\s*\d+|\d+\s*[|•·]\s*[^\W\d_]+|[^\W\d_]+\s*[|•·]\s*\d+)[\W_]*$")
_BULLET = re.compile(r"^\s*(?:[-*•–]\s+\S|\(?\d{1,3}[.)°]\s*\S|\([a-z]\))")
#: What the right-hand characters are misread as, on the left.
CONFUSIONS = (
    ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("6", "b"), ("6", "é"), ("6", "g"), ("9", "g"), ("8", "b"), ("3", "e"), ("2", "z"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
    ("iii", "m"), ("in", "m"), ("nn", "m"), ("u", "ii"), ("w", "vv"),
    ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("q", "g"), ("y", "v"), ("v", "y"), ("u", "n"), ("n", "u"), ("s", "5"),
    ("e", "é"), ("é", "e"), ("c", "o"), ("o", "c"), ("j", "i"), ("t", "l"), ("l", "t"), ("k", "h"), ("z", "2"), ("!", "l"), ("!", "i"), ("|", "l"), ("|", "i"), ("£", "e"), ("€", "e"), ("$", "s"), ("@", "a"),
)


def plain_word(token: str) -> str:
    return token.lower().strip(EDGES)


class Vocabulary(dict):
    """Known words with their counts, their beginnings, and what has been looked up."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(counts)
        self.ordered = sorted(counts)
        self.longest = max(map(len, counts), default=0)
        self.memo: dict[str, str | None] = {}

    def begins(self, word: str) -> bool:
        """Whether a known word begins with ``word``."""
        at = bisect_left(self.ordered, word)
        return at < len(self.ordered) and self.ordered[at].startswith(word)

    def correction(self, word: str) -> str | None:
        if word not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[word] = corrected(word, self)
        return self.memo[word]


def corrected(word: str, known: Vocabulary) -> str | None:
    """The known word that at most two usual confusions turn into ``word``; the likeliest if several.

    A confusion takes away two characters at most, so words longer than the longest known one by more
    than four have none."""
    if len(word) > known.longest + 4:
        return None
    seen, layer = {word}, [word]
    for _ in range(2):
        found, following = [], []
        for current in layer:
            for wrong, right in CONFUSIONS:
                at = current.find(wrong)
                while at >= 0:
                    candidate = current[:at] + right + current[at + len(wrong) :]
                    if candidate not in seen:
                        seen.add(candidate)
                        following.append(candidate)
                        if candidate in known:
                            found.append(candidate)
                    at = current.find(wrong, at + 1)
        if found:
            return max(found, key=lambda w: (known[w], w))
        layer = following
    return None


def line_shape(line: str) -> str:
    """A line with numbers and capitalised words made alike."""
    return re.sub(r"[^\W\d_a-zà-ÿ][\w’'-]*", "X", re.sub(r"\d+", "9", re.sub(r"\s+", " ", line.strip())))


def page_shape(line: str) -> str:
    return re.sub(r"\d+", "9", re.sub(r"\s+", " ", line.strip()))


def inside_sentence(lines: list[str], drop: set[int]) -> tuple[set[int], set[int]]:
    """The lines that stand between two lines of one sentence: what is before them has no stop (or a
    broken word), and what is behind goes on in lower case; and the lines that begin the sentence that
    goes on behind them. Lines of ``drop`` are looked past."""
    solid = [i for i, line in enumerate(lines) if line.strip()]
    result, begins, before = set(), set(), None
    behind: dict[int, int] = {}
    following = None
    for i in reversed(solid):
        behind[i] = following if following is not None else -1
        if i not in drop:
            following = i
    for i in solid:
        after = behind[i]
        if before is not None and after >= 0:
            head, tail = lines[before].strip(), lines[after].strip()
            if _BROKEN.search(head) or head[-1] not in ".;:!?" and tail[:1].islower():
                result.add(i)
            elif head[-1] in ".!?" and tail[:1].islower():
                begins.add(i)
        if i not in drop:
            before = i
    return result, begins


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance of two lines, or ``most`` + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def repeated_lines(lines: dict[int, str], edges: set[int], begins: set[int], share: float = 0.08, apart: int = 3) -> set[int]:
    """Which of ``lines`` (index -> line) stand at least twice, ``apart`` lines apart at least, up to a
    ``share`` of changed characters (numbers count as alike), at least once at a page edge,
    and not half of the times at the beginning of a sentence."""
    groups: list[tuple[str, list[int]]] = []
    by_gram: dict[str, list[int]] = {}
    exact: dict[str, int] = {}
    for i, line in lines.items():
        plain = page_shape(line).lower()
        grams = {plain[k : k + 3] for k in range(len(plain) - 2)} or {plain}
        at = exact.get(plain)
        if at is None:
            most = int(share * len(plain))
            votes = Counter(g for gram in grams for g in by_gram.get(gram, ()))
            # Each changed character spoils three trigrams at most.
            near = (g for g, n in votes.most_common() if n >= len(grams) - 3 * most and _distance(plain, groups[g][0], most) <= most)
            at = next(near, None) if most else None
        if at is None:
            at = len(groups)
            groups.append((plain, []))
            for gram in grams:
                by_gram.setdefault(gram, []).append(at)
        exact[plain] = at
        groups[at][1].append(i)
    return {i for _, places in groups if places[-1] - places[0] >= apart and not edges.isdisjoint(places) and 2 * len(begins.intersection(places)) < len(places) for i in places}


def possible_titles(lines: list[str], edges: set[int]) -> list[int]:
    """The lines that could be a running title: no sentence or list entry ends there, and they are set
    off (figures, a bar, capitals or an indent) or stand at a page edge."""
    return [
        i for i, whole in enumerate(lines)
        if (line := whole.strip()) and line[-1] not in ".;,:!?" and not _BULLET.match(line) and not _PAGE.match(line) and not _BROKEN.search(line)
        and (line[0].isupper() and (i in edges or re.search(r"\d", line)) or "|" in line or line.upper() == line or whole[:2].isspace())
    ]


def page_matter(lines: list[str], shapes: frozenset[str], apart: int = 3) -> dict[int, str]:
    """Which lines belong to the page only: index -> ``page`` or ``header``.

    A page number belongs to a running sequence: a later line of the same shape, ``apart`` lines away at
    least, has the next number. A running title is repeated, up to misread characters. With a single
    page in the text, a line of a shape in ``shapes`` is page matter in running text, and so is a line in
    capitals inside a sentence.
    """
    numbers = [i for i, line in enumerate(lines) if _PAGE.match(line) and not line.rstrip().endswith((";", ",", ":"))]
    result: dict[int, str] = {}
    latest: dict[tuple[str, int], int] = {}
    for i in numbers:
        shape, number = page_shape(lines[i]), int(re.search(r"\d+", lines[i]).group()[:18])
        before = latest.get((shape, number - 1))
        if before is not None and i - before >= apart:
            result[before] = result[i] = "page"
        latest[shape, number] = i
    # Figures of a list may follow one another by chance: most of a shape must be in sequence.
    of_shape = Counter(page_shape(lines[i]) for i in numbers)
    in_sequence = Counter(page_shape(lines[i]) for i in result)
    result = {i: "page" for i in result if 3 * in_sequence[page_shape(lines[i])] >= 2 * of_shape[page_shape(lines[i])]}
    inside, _ = inside_sentence(lines, set(numbers))
    solid = [i for i, line in enumerate(lines) if line.strip()]
    rest = [lines[i].strip() for i in solid if not _PAGE.match(lines[i])]
    flowing = sum(a[-1] not in ".;:!?" and not b[:1].isupper() for a, b in zip(rest, rest[1:]))
    runs = len(rest) > 2 and 2 * flowing >= len(rest) - 1  # most lines go on in the next
    for i in numbers:
        if i not in result and page_shape(lines[i]) in shapes and (i in inside or runs):
            result[i] = "page"
    edges = {k for i in result for k in (i - 1, i + 1)} | set(solid[:1]) | set(solid[-1:]) | inside
    titles = possible_titles(lines, edges)
    lone, begins = inside_sentence(lines, set(result) | set(titles))
    beside = {i for i in titles if i in lone or i - 1 in result or i + 1 in result or i in (solid[0], solid[-1])}
    repeated = repeated_lines({i: lines[i] for i in titles}, beside, begins, apart=apart)
    for i in titles:
        line = lines[i].strip()
        capitals = line.upper() == line and any(c.isalpha() for c in line)
        if i in repeated or line_shape(line) in shapes and (i in beside or runs) or capitals and i in lone:
            result[i] = "header"
    return result


def restore_text(text: str, known: Vocabulary, shapes: frozenset[str]) -> tuple[str, list[tuple[str, str]]]:
    """The text as continuous paragraphs, and the noise in it as (noise, restored)."""
    lines = text.split("\n")
    matter = page_matter(lines, shapes) if len(lines) > 2 else {}
    noise = [(kind, lines[i].strip()) for i, kind in matter.items()]
    kept = [line.strip() for i, line in enumerate(lines) if i not in matter]
    unfinished = re.search(r"(\.\.|…|[^.!?;:)\]»”\"])\s*$", text) is not None

    def repair(token: str, last: bool = False) -> str:
        word = plain_word(token)
        if not word or word in known or not re.search(r"[^\W\d_]", word):
            return token
        if last and known.begins(word):
            return token  # cut off rather than misread
        better = known.correction(word) if len(word) > 1 else None
        if better is None:
            return token
        noise.append(("misread", better))
        at = token.lower().find(word)
        return token[:at] + (better.capitalize() if word[:1] != token[at : at + 1] else better) + token[at + len(word) :]

    paragraphs, current = [], ""
    for k, line in enumerate(kept):
        if not line:
            if current:
                paragraphs.append(current)
            current = ""
            continue
        if current and _BROKEN.search(current) and re.match(r"[^\W\d_]", line):
            head, _, left = current.rpartition(" ")
            right, _, rest = line.partition(" ")
            mark, left = left[-1], left[:-1]
            joined, hyphened = left + right, f"{left}-{right}"
            word, compound = plain_word(joined), plain_word(hyphened)
            if known.get(compound, 0) > known.get(word, 0):
                word, joined = compound, hyphened
            elif word not in known:
                better = known.correction(word)
                if better is None and (other := known.correction(compound)) is not None:
                    better = other
                if better is not None:
                    at = joined.lower().find(word)
                    noise.append(("misread", better))
                    word, joined = better, (joined[:at] + better + joined[at + len(word) :] if at >= 0 else better)
            if mark != "-" or word in known or not re.search(r"\d", word):
                noise.append(("hyphen", word))
                current = f"{head} {joined} {rest}".strip()
                continue
        # A new paragraph starts behind a finished sentence only where a list entry follows.
        current = f"{current}\n{line}" if current and _BULLET.match(line) else f"{current} {line}".strip()
    if current:
        paragraphs.append(current)
    fixed = []
    for p, paragraph in enumerate(paragraphs):
        tokens = re.split(r"(\s+)", paragraph)
        last = len(tokens) - 1 if unfinished and p == len(paragraphs) - 1 else -1
        fixed.append("".join(t if not t or t.isspace() else repair(t, i == last) for i, t in enumerate(tokens)))
    return "\n\n".join(fixed), list(dict.fromkeys(noise))


def _words(values: pa.Array) -> tuple[pa.ListArray, pa.DictionaryArray]:
    lists = pc.utf8_split_whitespace(pc.utf8_lower(values))
    return lists, lists.flatten().dictionary_encode()


def vocabulary(values: DataFrame, rarest: int = 200_000, least: int = 3) -> dict[str, int]:
    """Words (between blanks, without punctuation at their ends) that make up at least 1/``rarest``
    of all words and occur ``least`` times: at most ``rarest`` of them, which bounds what is sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("value")
            lined = pc.match_substring(column, "\n")
            joined = pc.replace_substring_regex(column.filter(lined), rf"[{HYPHENS}]\n\s*", "")
            _, words = _words(pa.concat_arrays([column.filter(pc.invert(lined)), joined]))
            totals: Counter = Counter()
            for word, n in zip(words.dictionary.to_pylist(), np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))):
                totals[word.strip(EDGES)] += int(n)
            yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"])

    words = checkpoint(values.where(F.col("value").isNotNull()).select("value").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("word <> ''"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = words.where((F.col("n") >= least) & (F.col("n") * rarest >= total)).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))


def title_shapes(values: DataFrame, share: float = 0.003, least: int = 3) -> frozenset[str]:
    """Shapes of the page numbers and running titles found by sequence and repetition in at least
    ``share`` of all texts with page matter, and in ``least`` texts: at most 1/``share`` times the few
    shapes a text holds."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: Counter = Counter()
            for text in batch.column("value").to_pylist():
                lines = text.split("\n")
                if len(lines) > 2 and (matter := page_matter(lines, frozenset())):
                    totals[""] += 1
                    totals.update({page_shape(lines[i]) if kind == "page" else line_shape(lines[i]) for i, kind in matter.items()})
            yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["shape", "n"])

    several = values.where(F.col("value").contains("\n")).select("value")
    counted = checkpoint(several.mapInArrow(shapes, "shape string, n long").groupBy("shape").agg(F.sum("n").alias("n")))
    texts = counted.where("shape = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = counted.where((F.col("shape") != "") & (F.col("n") >= max(least, share * texts))).select("shape").collect()
    return frozenset(r["shape"] for r in rows)


def restore_pages(values: DataFrame, everything: bool = False) -> DataFrame:
    """Rows (id, field, text, noise): the restored text and its noise (kind, restored) of each value
    (id, field, value) that has any, or with ``everything`` of each value.

    Null and empty values give no row; redelivered rows give one row; ties between corrections go to
    the more frequent word. Other columns are ignored.
    """
    context = values.sparkSession.sparkContext
    model = context.broadcast((vocabulary(values), title_shapes(values)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shapes = model.value
        known = Vocabulary(counts)
        for batch in batches:
            column = batch.column("value")
            lists, words = _words(column)
            strange = np.array([bool(w := word.strip(EDGES)) and w not in known and any(c.isalpha() for c in w) for word in words.dictionary.to_pylist()], bool)
            flags = strange[words.indices.to_numpy()] if len(words) else np.zeros(0, bool)
            sums = np.concatenate([[0], np.cumsum(flags)])
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            suspect = (sums[offsets[1:]] > sums[offsets[:-1]]) | pc.greater_equal(pc.count_substring(column, "\n"), 2).to_numpy(zero_copy_only=False)
            rows = []
            for i in range(len(column)) if everything else np.flatnonzero(suspect):
                text, noise = restore_text(column[int(i)].as_py(), known, shapes) if suspect[i] else (column[int(i)].as_py(), [])
                if noise or everything:
                    rows.append((batch.column("id")[int(i)].as_py(), batch.column("field")[int(i)].as_py(), text, [{"noise": n, "restored": r} for n, r in noise]))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (batch.schema.field("id").type, pa.string(), pa.string(), pa.list_(pa.struct([("noise", pa.string()), ("restored", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "field", "text", "noise"])

    source = values.where(F.col("id").isNotNull() & (F.col("value") != "")).select("id", "field", "value")
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(work, f"id {kind}, field string, text string, noise array<struct<noise:string,restored:string>>").dropDuplicates(["id", "field"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The noise of scanned headings and bodies."""
    restored = restore_pages(article_values(table(spark, folder, "article_texts")))
    return restored.select(F.col("id").alias("text_id"), "field", F.inline("noise")).distinct()


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every heading and body as continuous paragraphs."""
    restored = restore_pages(article_values(table(spark, folder, "article_texts")), everything=True)
    return restored.select(F.col("id").alias("text_id"), "field", "text", F.size("noise").cast("long").alias("n_repairs"))


QUERIES = {"p6_found": p6_found, "p6_restored": p6_restored}
ORACLES: dict[str, str] = {}
