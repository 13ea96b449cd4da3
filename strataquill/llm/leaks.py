"""Evaluation texts leaking into training text, by greedy string tiling.

The test items come in blocks of bounded size. A block is broadcast as a sorted array of the Karp-Rabin
hashes of its word windows; the corpus is read once per block and never shuffled. Documents are hashed
by Arrow and numpy kernels over whole batches, and share seeds with an item where their hashes stand in
that array. By the pigeonhole principle a leak leaves a known least number of seeds, so pairs with fewer
are dropped without loss. The rest are tiled: maximal matches from hashed seeds, the longest first and
without overlap; tiles in order are chained into one stretch, whose matched words and edits decide.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.sources.tables import table

#: Words in a seed, the longest first: an item takes the first of which each of its leaks must hold one.
_SEEDS = (5, 3, 2, 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def plain_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text without case, accents and punctuation; apostrophes and hyphens join,
    nothing else does."""
    folded = pc.utf8_normalize(pc.replace_substring(pc.utf8_lower(texts), "ß", "ss"), "NFKD")
    bare = pc.replace_substring_regex(pc.replace_substring_regex(folded, r"\p{M}+", ""), r"[^\p{L}\p{N}\p{Z}\s\x{85}]+", "")
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(bare))


def batch_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A stable 64-bit code of every word of the texts, and where each text starts (and the last ends)."""
    lists = plain_words(texts)
    words = lists.flatten().dictionary_encode()
    codes = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in words.dictionary.to_pylist()], np.uint64)
    flat = codes[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(flat != 0)])
    offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
    return flat[flat != 0], ends[offsets]


def word_codes(text: str) -> np.ndarray:
    return batch_codes(pa.array([text], pa.string()))[0]


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words (empty where there are fewer words)."""
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    result = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        result = result * _BASE + codes[k : len(codes) - size + 1 + k]
    return result


def least_seeds(n_words: int, size: int, share: float = 0.5, edits: float = 0.1) -> int:
    """The fewest whole seeds of ``size`` words in a stretch of ``share`` of ``n_words`` words with a
    share of ``edits``; below 1 where such a stretch may hold none."""
    lengths = range(int(np.ceil(share * n_words)), n_words + 1)
    return min((n - size + 1 - size * int(edits * n) for n in lengths), default=0)


def seed_size(n_words: int, share: float, edits: float) -> int:
    return next((size for size in _SEEDS if least_seeds(n_words, size, share, edits) >= 1), 1)


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int = 2, once: bool = True) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (item position, text position, length), each the longest left when taken.
    Without ``once`` a part of the item may be found in several places of the text."""
    seeds: dict[int, list[int]] = {}
    for i, h in enumerate(window_hashes(item, least).tolist()):
        seeds.setdefault(h, []).append(i)
    item_words, text_words = item.tolist(), text.tolist()
    matches, reached = [], {}
    for j, h in enumerate(window_hashes(text, least).tolist()):
        for i in seeds.get(h, ()):
            if reached.get(i - j, -1) > j:
                continue
            n = 0
            while i + n < len(item_words) and j + n < len(text_words) and item_words[i + n] == text_words[j + n]:
                n += 1
            if n >= least:
                matches.append((n, i, j))
                reached[i - j] = j + n
    used_item, used_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    heap = [(-n, i, j) for n, i, j in matches]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = ~(used_item[i : i + n] & once | used_text[j : j + n])
        if free.all():
            used_item[i : i + n] = used_text[j : j + n] = True
            tiles.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), i + int(a), j + int(a)))
    return sorted(tiles)


def _common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence of two short gaps."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(row[k], before[k + 1])
    return row[-1]


def _undominated(states: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """States (matched, edits) of which no other has as many matches with as few edits."""
    kept: list[tuple[int, int]] = []
    for matched, wrong in sorted(states, key=lambda s: (-s[0], s[1])):
        if not kept or wrong < kept[-1][1]:
            kept.append((matched, wrong))
    return kept


def best_stretch(item: np.ndarray, text: np.ndarray, edits: float = 0.1, once: bool = True) -> int:
    """Most item words that stand in order in one stretch of the text with at most a share of edits.

    Tiles are chained in order; the words a gap shares count as matched, its other words as dropped or
    replaced. All chains that no other beats in both are kept. A stretch has at most
    ``edits / (1 - edits)`` times the item's words as edits, and between two tiles there is at most one
    more single match than there are edits, so longer gaps cannot belong to a stretch.
    """
    tiles = greedy_tiles(item, text, once=once)
    most = int(edits / (1 - edits) * len(item) + 1e-9)
    longest, best = 2 * most + 1, 0
    states: list[list[tuple[int, int]]] = [[(n, 0)] for _, _, n in tiles]
    for k, (i, j, n) in enumerate(tiles):
        states[k] = _undominated(states[k])
        best = max([best, *(matched for matched, wrong in states[k] if wrong <= edits * (matched + wrong) + 1e-9)])
        for m in range(k + 1, len(tiles)):
            a, b, size = tiles[m]
            gap_item, gap_text = a - i - n, b - j - n
            if gap_item > longest:
                break
            if gap_item < 0 or gap_text < 0 or gap_text > longest:
                continue
            shared = _common(item[i + n : a].tolist(), text[j + n : b].tolist()) if gap_item and gap_text else 0
            more = max(gap_item, gap_text) - shared
            states[m] += [(matched + shared + size, wrong + more) for matched, wrong in states[k] if wrong + more <= most]
    return best


class Block:
    """Test items with their codes and, per size of seed, the sorted hashes of their windows."""

    def __init__(self, ids: list, texts: list[str], share: float, edits: float):
        self.ids = ids
        self.codes = [word_codes(text) for text in texts]
        sizes = np.array([seed_size(len(c), share, edits) for c in self.codes])
        self.needed = np.array([max(1, least_seeds(len(c), s, share, edits)) if len(c) >= 5 else 1 << 30 for c, s in zip(self.codes, sizes)], np.int64)
        self.tables = []
        for size in _SEEDS:
            own = np.flatnonzero(sizes == size)
            hashes = [window_hashes(self.codes[k], size) for k in own]
            if not sum(map(len, hashes)):
                continue
            owners, keys = np.repeat(own, [len(h) for h in hashes]), np.concatenate(hashes)
            order = np.argsort(keys, kind="stable")
            self.tables.append((size, keys[order], owners[order]))

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Pairs (text, item) that share enough seeds, in order."""
        n, found = len(self.ids), []
        of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for size, keys, owners in self.tables:
            hashes = window_hashes(codes, size)
            inside = of[: len(hashes)] == of[size - 1 :] if len(hashes) else np.zeros(0, bool)
            low = np.searchsorted(keys, hashes, "left")
            hit = inside & (keys[np.minimum(low, len(keys) - 1)] == hashes)
            texts, low, hashes = of[: len(hashes)][hit], low[hit], hashes[hit]
            # Each distinct seed of a text counts every place of the items where it stands.
            order = np.lexsort((hashes, texts))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (texts[order][1:] != texts[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
            texts, low = texts[order][fresh], low[order][fresh]
            length = np.searchsorted(keys, hashes[order][fresh], "right") - low
            at = np.repeat(low - np.cumsum(length) + length, length) + np.arange(length.sum())
            pairs, counts = np.unique(np.repeat(texts, length) * n + owners[at], return_counts=True)
            found.append(pairs[counts >= self.needed[pairs % n]])
        pairs = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.stack([pairs // max(n, 1), pairs % max(n, 1)], axis=1)


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
               share: float = 0.5, edits: float = 0.1, block: int = 20_000, block_chars: int = 50_000_000) -> DataFrame:
    """Rows (doc_id, item_id, words): documents holding at least ``share`` of an item's words in the
    item's order in one stretch with at most ``edits`` of its words dropped or replaced.

    Case, accents, punctuation and spacing do not count. Null ids and texts, and items with fewer
    than 5 words, give no row; repeated rows give one row; copies of a document are documents; other
    columns are ignored; no items or documents give no rows. The items are spread by a hash over
    blocks of about ``block`` items and ``block_chars`` characters; one block at a time passes through
    the driver, and a worker holds the block it works on.
    """
    context = documents.sparkSession.sparkContext
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).dropDuplicates(["item"])
    total = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-total["n"] // block), -(-total["chars"] // block_chars))
    source = documents.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    kinds = source.schema["doc"].dataType.simpleString(), wanted.schema["item"].dataType.simpleString()
    result = None
    for number in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).toArrow().sort_by("item")
        held = context.broadcast(Block(rows.column("item").to_pylist(), rows.column("text").to_pylist(), share, edits))
        part = source.mapInArrow(_finder(held, rows.schema.field("item").type, share, edits), f"doc {kinds[0]}, item {kinds[1]}, words int")
        result = part if result is None else result.unionByName(part)
    return result.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "words").dropDuplicates(["doc_id", "item_id"])


def _finder(held, item_type: pa.DataType, share: float, edits: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            codes, starts = batch_codes(batch.column("text"))
            docs, found, most = [], [], []
            for text, item in items.candidates(codes, starts).tolist():
                own, least = codes[starts[text] : starts[text + 1]], share * len(items.codes[item])
                words = best_stretch(items.codes[item], own, edits)
                if words < least:  # a part of the item that stands twice may have been marked in the wrong place
                    words = max(words, best_stretch(items.codes[item], own, edits, once=False))
                if words >= least:
                    docs.append(text)
                    found.append(items.ids[item])
                    most.append(words)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(docs, pa.int64())), pa.array(found, item_type), pa.array(most, pa.int32())], ["doc", "item", "words"])

    return work


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a test passage wholly or in large part."""
    return find_leaks(table(spark, folder, "documents", spread=True), table(spark, folder, "benchmark")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents leak each item that leaks, and the most words any holds."""
    found = find_leaks(table(spark, folder, "documents", spread=True), table(spark, folder, "benchmark"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("words").alias("most_words"))


QUERIES = {"p9_found": p9_found, "p9_report": p9_report}
ORACLES: dict[str, str] = {}
