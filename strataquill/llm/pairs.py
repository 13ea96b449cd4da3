"""Broken prompt and response pairs.

Responses are sorted by their text in range partitions, so that the longer versions of a response stand
right behind it: a response that one of them goes on with in mid-sentence is a shortened version. Piles of unfinished responses at one length and last
words that never end a sentence show the other cut ones. Rules for emptiness, copies of the question,
refusals and the languages of both sides (by character models) name the rest.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions.labels import LANGUAGES
from strataquill.llm.cut_text import cut_values
from strataquill.llm.languages import CharModel, fit_models, score_words
from strataquill.sources.tables import table

_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_EMPTY = {"", "n a", "na", "none", "null", "nil", "empty", "nan", "undefined", "vide", "aucun", "aucune", "no answer", "not available", "tbd", "todo", "blank", "missing", "br", "p p", "ntacyo", "sans objet"}
#: The closed classes of words that a refusal is made of in each language: who speaks, what denies,
#: what is denied (saying, knowing, helping), and how something sought was not found.
_REFUSES = {
    language: tuple(re.compile(pattern, re.IGNORECASE) for pattern in patterns)
    for language, patterns in {
        "en": (
            r"\b(?:i|i'm|i've|i'd|we|we're|we've|my|our|me|us|myself)\b",
            r"\b(?:not|no|nothing|none|never|cannot|\w+n't|unable|unfit|unqualified|decline|refuse|beyond|outside|exceeds?|lack)\b",
            r"\b(?:answer\w*|respond|response|say|speak|tell|help|assist|discuss\w*|comment|advi[sc]e|opinion|provide|know\w*|aware|familiar|competence|expertise|remit|scope|information|sources?|data|documents?|found|find|idea|able|qualified|position)\b",
            r"\b(?:no|nothing|none|not|\w+n't)\b.*\b(?:found|retrieved|available|returned|yielded|located)\b",
            r"\b(?:information|results?|answers?|documents?|sources?|web|internet|search\w*|request|query|database|nothing)\b",
        ),
        "fr": (
            r"\b(?:je|nous|mes|mon|ma|notre|nos|me|moi)\b|\b[jm]'",
            r"\b(?:ne|pas|rien|aucune?|impossible|incapable|refuse|hors|dépasse\w*|ignore|décline)\b|\bn'",
            r"\b(?:répon\w+|aider|aide|dire|parler|prononcer|commenter|avis|conseiller|donner|fournir|sais|savoir|connais\w*|compétences?|informations?|sources?|données|documents?|trouv\w+|idée|mesure|ignore)\b",
            r"\b(?:rien|aucune?|ne|pas)\b.*\b(?:trouv\w+|disponibles?|donné|retourné|contien\w+|abouti)\b|\bn'.*\b(?:trouv\w+|disponibles?|donné|retourné|abouti)\b|\b(?:trouv\w+|disponibles?)\b.*\b(?:aucune?|rien)\b",
            r"\b(?:informations?|réponses?|résultats?|documents?|sources?|web|internet|recherches?|base|rien)\b",
        ),
        "rw": (
            r"\b(?:sin\w{3,}|sim\w{3,}|sinzi|simbizi|nshobora|mfite|mbona|nabonye|nabonyemo|nzi|mbizi|njye|jyewe|\w+anjye)\b",
            r"\b(?:nta|ntabwo|ntacyo|ntaby\w+|birenze|burenze|hanze|si[nm]\w{2,})\b",
            r"\b(?:gusubiza|kubisubiza|gufasha|kugufasha|kuvuga\w*|mvuga|sinzi|simbizi|nzi|mbizi|mbiziho|ubumenyi|ubushobozi|amakuru|makuru|gisubizo|igisubizo|inyandiko|nyandiko|nabonye\w*|bibivugaho|kugira icyo|ikibazo|ingingo)\b",
            r"\b(?:nta|ntabwo|ntacyo)\b.*\b(?:\w*bonetse|\w*bonye\w*|\w*tanze|\w*bivugaho|mbiziho|mfite)\b",
            r"\b(?:makuru|amakuru|gisubizo|igisubizo|nyandiko|inyandiko|rubuga|gushakisha|ishakisha|ibyo)\b",
        ),
    }.items()
}
_REGRETS = re.compile(r"\b(?:sorry|unfortunately|apolog\w+|regret\w*|afraid|sadly|alas)\b|\b(?:désolée?s?|malheureusement|excuse[sz]?|excusez|regrett?\w*|navrée?s?|hélas|pardon)\b|\b(?:mbabarira|imbabazi|ikibabaje|birababaje|unyihanganire|mwihangane|ihangane)\b", re.IGNORECASE)
#: What stands beside a refusal: a role, or a request to turn elsewhere or ask again.
_BESIDE = re.compile(
    r"^(?:but|mais|ariko|and|et|kandi)?\s*(?:as an?\b|en tant qu|en qualité d|nk'|please|kindly|try|ask|see|seek|visit|contact|consult|speak|refer|turn|rephrase|reformulate|you (?:may|might|could|should) (?:ask|try|contact|consult)"
    r"|veuillez|merci de|adressez|reformulez|consultez|contactez|essayez|demandez|voyez|posez|baza|mubaze|ongera|egera|gerageza|reba|shaka|hamagara|wabaza)", re.IGNORECASE,
)
#: How a question asks for an answer in a language.
_ASKS = {
    "en": re.compile(r"\b(?:in english|en anglais|(?:mu |ki)?cyongereza)\b", re.IGNORECASE),
    "fr": re.compile(r"\b(?:in french|en français|en francais|(?:mu )?[kg]ifaransa)\b", re.IGNORECASE),
    "rw": re.compile(r"\b(?:in (?:iki)?nyarwanda|in kinyarwanda|en kinyarwanda|(?:mu )?(?:iki|ki)nyarwanda)\b", re.IGNORECASE),
}


class _Unmarked(dict):
    """Translation of code points that drops combining and invisible characters, filled as they come."""

    def __missing__(self, code: int) -> int | None:
        char = chr(code)
        self[code] = None if unicodedata.combining(char) or unicodedata.category(char) == "Cf" else code
        return self[code]


_UNMARKED = _Unmarked()


def bare_words(text: str) -> list[str]:
    """Words and numbers without case, accents, markup and invisible characters."""
    folded = re.sub(r"<[^<>]*>", " ", html.unescape(text)).casefold()
    return _WORD.findall(folded if folded.isascii() else unicodedata.normalize("NFKD", folded).translate(_UNMARKED))


def says_nothing(answer: str | None) -> bool:
    if answer is None:
        return True
    # No placeholder has more than 24 letters and digits: longer answers need no closer look.
    if len(answer) > 100 and sum(map(len, _WORD.findall(re.sub(r"<[^<>]*>|&[a-z#0-9]+;", " ", answer)))) > 24:
        return False
    return " ".join(bare_words(answer)) in _EMPTY


def declines(clause: str) -> bool:
    """In one of the languages, the speaker denies to say, know or help, or something sought was not found."""
    return any(denies.search(clause) and (speaks.search(clause) and tells.search(clause) or missed.search(clause) and sought.search(clause)) for speaks, denies, tells, missed, sought in _REFUSES.values())


def only_declines(answer: str) -> bool:
    """Every clause declines, regrets, names a role or refers elsewhere, and one of them declines, or
    nothing but regret is said."""
    text = unicodedata.normalize("NFC", answer).replace("’", "'")
    clauses = [c.strip(" ,*_>#-\"“”«»()") for c in re.split(r"[.!?…\n;:]+|,\s*(?=(?:but|however|mais|ariko)\b)", text) if _LETTERS.search(c)]
    refused = regretted = False
    for clause in clauses:
        if declines(clause):
            refused = True
        elif _REGRETS.search(clause) and len(clause.split()) <= 6:
            regretted = True
        elif not _BESIDE.match(clause):
            return False
    return refused or regretted


def only_repeats(question: str | None, answer: str, dressing: int = 6) -> bool:
    """Without the question (or its first sentence), at most ``dressing`` words are left, all in front."""
    if len(set(answer.casefold().split())) > len((question or "").split()) + dressing + 4:
        return False  # too many different words
    asked, said = bare_words(question or ""), bare_words(answer)
    if len(asked) < 3:
        return bool(asked) and said == asked
    for target in (asked, bare_words(re.split(r"(?<=[?.!])\s", (question or "").strip())[0])):
        n = len(target)
        if n < 3:
            continue
        starts, k = [], 0
        while k + n <= len(said):
            if said[k : k + n] == target:
                starts.append(k)
                k += n
            else:
                k += 1
        if starts and starts[-1] + n == len(said) and len(said) - n * len(starts) <= dressing * len(starts) and starts[0] <= dressing:
            return True
    return False


class WordScores:
    """Sums of word scores under each model; every word is scored once."""

    def __init__(self, models: list[CharModel], most: int = 100_000):
        self.models, self.most = models, most
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((0, len(models)))

    def sums(self, text: str) -> tuple[np.ndarray, int]:
        words = _LETTERS.findall(text.lower())
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if new:
            if len(self.rows) > self.most:
                self.rows, self.matrix = {}, self.matrix[:0]
                new = list(dict.fromkeys(words))
            self.rows.update(zip(new, range(len(self.matrix), len(self.matrix) + len(new))))
            self.matrix = np.concatenate([self.matrix, score_words(self.models, new)])
        return self.matrix[[self.rows[w] for w in words]].sum(0), len(words)


def goes_on(before: str, rest: str, short: int) -> bool:
    """Whether ``rest`` goes on with a text in mid-word or, behind ``short`` words at least, in mid-sentence."""
    inside = rest[0].isalpha() and before[-1].isalpha()
    if inside or len(before.split(None, short)) < short:
        return inside
    return rest[0].isalnum() and before[-1].isalnum() or rest[0] in " ,'’-" and rest.lstrip(" ,'’-")[:1].islower()


def open_beginnings(texts: Iterator[str], short: int) -> Iterator[tuple[str, bool, bool]]:
    """(text, any, all) of each of the sorted distinct texts that others begin with: whether one of them,
    and whether each of them, goes on with it (each: in mid-word). The texts that begin with another
    stand behind it in one run, so a stack holds the beginnings of the text at hand."""
    stack: list[list] = []
    for text in texts:
        while stack and not text.startswith(stack[-1][0]):
            done = stack.pop()
            if done[3]:
                yield done[0], done[1], done[2]
        for beginning in stack:
            rest = text[len(beginning[0]) :]
            if rest:
                beginning[1] = beginning[1] or goes_on(beginning[0], rest, short)
                beginning[2] = beginning[2] and rest[0].isalpha() and beginning[0][-1].isalpha()
                beginning[3] = True
        if not stack or stack[-1][0] != text:
            stack.append([text, False, True, False])
    for done in reversed(stack):
        if done[3]:
            yield done[0], done[1], done[2]


def shortened(values: DataFrame, column: str = "answer", certain: int = 24, short: int = 8, sampled: int = 20_000) -> DataFrame:
    """The distinct texts of ``column`` that another text goes on with in mid-word or mid-sentence.

    Texts of fewer than ``short`` words must go on in mid-word, and those of fewer than ``certain``
    characters in every longer text. The texts are sorted in ranges cut at texts of a bounded sample;
    a text also goes to each later range that begins inside its run, so no run is cut.
    """
    texts = values.select(F.rtrim(column).alias("text")).where(F.length("text") > 0)
    ranges = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = (sampled << 30) // max(values.count(), 1)
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < min(share, 1 << 30)).select(F.substring("text", 1, 200).alias("text")).distinct().toArrow()
    ordered = sorted(drawn.column("text").to_pylist())
    cuts = sorted({ordered[k * len(ordered) // ranges] for k in range(1, ranges)}) if ordered else []

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, parts = [], []
            for text in dict.fromkeys(batch.column("text").to_pylist()):
                at = bisect_right(cuts, text)
                kept.append(text)
                parts.append(at)
                while at < len(cuts) and cuts[at].startswith(text):
                    at += 1
                    kept.append(text)
                    parts.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(parts, pa.int32())], ["text", "part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (text for batch in batches for text in batch.column("text").to_pylist())
        found = open_beginnings(texts, short)
        while rows := list(islice(found, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.bool_(), pa.bool_()))], ["text", "one", "each"])

    sorted_out = texts.mapInArrow(placed, "text string, part int").repartitionById(max(len(cuts) + 1, 1), F.col("part")).sortWithinPartitions("text")
    judged = sorted_out.select("text").mapInArrow(compare, "text string, one boolean, each boolean").groupBy("text").agg(F.max("one").alias("one"), F.min("each").alias("each"))
    unfinished = ~F.col("text").rlike(r"[.!?]$")
    return judged.where(unfinished & F.when(F.length("text") < certain, F.col("each")).otherwise(F.col("one"))).select("text")


def defective_pairs(records: DataFrame, labelled: DataFrame, text_col: str = "body", label_col: str = "language", short: int = 8) -> DataFrame:
    """Rows (id, source, defect) of the records (id, question, answer, source) with a broken answer.

    ``empty``: null or nothing that says anything. ``copy``: only the question, dressed in at most six
    words in front of it. ``refusal``: every sentence declines or goes with it. ``truncated``: stops
    inside a word or sentence; answers of fewer than ``short`` words may lack a stop, so they must end
    on a word that is unknown or ends nothing, at a field limit, or be gone on with in mid-word.
    ``other_language``: an answer of at least five words in another language than the question,
    which does not ask for it. The first that holds is given. A null question makes only ``empty``,
    ``refusal`` and ``truncated`` possible. Redelivered rows count once; null ids are left out. The
    language models are fitted on a bounded sample of ``labelled`` texts.
    """
    records = records.where(F.col("id").isNotNull()).select("id", "question", "answer", "source").dropDuplicates(["id"])
    held = records.sparkSession.sparkContext.broadcast(fit_models(labelled, text_col, label_col).models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(held.value)
        for batch in batches:
            verdicts = []
            for question, answer in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist()):
                verdict = None
                if says_nothing(answer):
                    verdict = "empty"
                elif only_repeats(question, answer):
                    verdict = "copy"
                elif only_declines(answer):
                    verdict = "refusal"
                elif question:
                    said = answer
                    if (place := said.casefold().find(question.strip().casefold())) >= 0:
                        said = said[:place] + said[place + len(question.strip()) :]
                    (asked, n_asked), (spoken, n_spoken) = scores.sums(question), scores.sums(said)
                    if n_asked >= 3 and n_spoken >= 5:
                        a, b = int(asked.argmax()), int(spoken.argmax())
                        if a != b and spoken[b] - spoken[a] > 6 and asked[a] - asked[b] > 3 and not _ASKS[LANGUAGES[b]].search(question):
                            verdict = "other_language"
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), batch.column("answer"), pa.array(verdicts, pa.string())], ["id", "source", "answer", "defect"])

    kind = records.schema["id"].dataType.simpleString()
    judged = records.mapInArrow(judge, f"id {kind}, source string, answer string, defect string")
    cut = cut_values(records.select("id", F.lit("answer").alias("field"), "source", F.col("answer").alias("value")), short=short).select("id")
    by_text = records.select("id", F.rtrim("answer").alias("text")).join(shortened(records, short=short), "text", "left_semi").select("id")
    truncated = cut.unionByName(by_text).distinct().withColumn("cut", F.lit(True))
    joined = judged.join(truncated, "id", "left")
    # A text cut off in mid-sentence is truncated, whatever language it is in.
    defect = F.when(F.col("defect").isin("empty", "copy", "refusal"), F.col("defect")).when(F.col("cut"), "truncated").otherwise(F.col("defect"))
    return joined.select("id", "source", defect.alias("defect")).where(F.col("defect").isNotNull())


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return defective_pairs(table(spark, folder, "history"), table(spark, folder, "article_texts"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The defective records of ``history``."""
    return _found(spark, folder).select("id", "defect")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Defects per source."""
    return _found(spark, folder).groupBy("source", "defect").agg(F.count(F.lit(1)).alias("n_records"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLES: dict[str, str] = {}
