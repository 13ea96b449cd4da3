"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Words are cut by the tokenizer's pattern. A short word is merged in a contiguous array of part starts
and ranks of adjacent pairs: the smallest rank is found by a scan, its boundary deleted, and the two
neighbouring ranks refreshed. A long word, for which scans would be quadratic, takes a heap over a
linked list of parts instead and gives the same ids. Each worker keeps the ids of frequent words.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.sources.tables import table

#: The file of ranks and the pattern that splits text before merging.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word by repeated scans for the smallest rank."""
    starts = list(range(len(word) + 1))
    adjacent = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == _NONE:
            break
        at = adjacent.index(least)
        del starts[at + 1]
        del adjacent[at]
        if at < len(adjacent):
            adjacent[at] = ranks.get(word[starts[at] : starts[at + 2]], _NONE)
        if at:
            adjacent[at - 1] = ranks.get(word[starts[at - 1] : starts[at + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(starts[:-1], starts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word by a heap of (rank, start); a pair that has changed since is skipped."""
    n = len(word)
    following, previous = list(range(1, n + 2)), list(range(-1, n))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, start, end = heapq.heappop(heap)
        middle = following[start] if alive[start] else n
        if middle >= n or following[middle] != end:
            continue
        alive[middle] = False
        following[start] = end
        if end < n:
            previous[end] = start
            if (rank := ranks.get(word[start : following[end]])) is not None:
                heapq.heappush(heap, (rank, start, following[end]))
        before = previous[start]
        if before >= 0 and (rank := ranks.get(word[before:end])) is not None:
            heapq.heappush(heap, (rank, before, end))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : following[at]]])
        at = following[at]
    return ids


class Encoder:
    """Encodes texts with the given ranks; ``short`` is the longest word (bytes) merged by scans."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, short: int = 128, cached: int = 200_000):
        self.ranks, self.pattern, self.short, self.cached = ranks, regex.compile(pattern), short, cached
        self.cache: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.cache.get(word)
        if ids is None:
            raw = word.encode("utf-8", "replace")
            if (whole := self.ranks.get(raw)) is not None:
                ids = [whole]
            else:
                ids = merge_short(raw, self.ranks) if len(raw) <= self.short else merge_long(raw, self.ranks)
            if len(raw) <= self.short:
                if len(self.cache) >= self.cached:
                    self.cache.clear()
                self.cache[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts give none. Nothing is a special token."""
        ids: list[int] = []
        for word in self.pattern.findall(text or ""):
            ids += self.word(word)
        return ids


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """Rows (id, ids), one for each input row.

    Null and empty texts have an empty list, blank texts are encoded as they are, words of any
    length are encoded whole. Repeated rows give repeated rows; other columns are ignored. The rank
    file has a fixed size and goes to the workers by a broadcast variable.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            lists = [encoder.encode(text) for text in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = pa.array([i for x in lists for i in x], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["id", "ids"])

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(work, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, folder, "documents", spread=True)).withColumnRenamed("id", "doc_id")


QUERIES = {"p8_ids": p8_ids}
ORACLES: dict[str, str] = {}
