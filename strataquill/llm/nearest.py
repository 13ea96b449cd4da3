"""The k most similar vectors of every vector, by shifted space-filling curves.

Copies of a direction are folded into one group first, so a vector that a third of all rows share
is searched once. Several Hilbert orderings, each of its own random projection and with its own
shift, are range partitioned in Spark: an ordering is cut into key ranges of about ``chunk`` groups,
and a range is one task. Within a range further Hilbert orderings of other projections are sorted in
memory; windows of neighbouring keys are compared by matrix products, and neighbours of neighbours
are compared until the lists hardly change. The best of each range are ranked in double precision,
so that no vector is ever fetched again, and the lists of all orderings are merged.

The axes of an ordering are cut at quantiles and not at equal steps, so a dense group of near-copies
gets as many cells as its share of the rows, however narrow it is. The number of orderings grows with
the logarithm of the number of ranges, since two neighbours fall into one range the more rarely the
more ranges there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataquill.operators.skew import hot_key_join
from strataquill.session import checkpoint
from strataquill.sources.tables import table


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (n, d) with ``bits`` bits a side, as int64 (d * bits <= 62).

    The axes are turned into the transposed index by undoing the excess rotations of each level,
    then Gray-decoded, and the bits of all axes are interleaved.
    """
    x = cells.T.astype(np.uint32).copy()
    d, n = x.shape
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for axis in range(d):
            inverted = (x[axis] & bit) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[axis]) & low).astype(np.uint32)
            x[0] ^= np.where(inverted, low, swapped).astype(np.uint32)
            x[axis] ^= swapped
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    gray = np.zeros(n, np.uint32)
    for level in range(bits - 1, 0, -1):
        gray ^= np.where((x[d - 1] >> np.uint32(level)) & 1, np.uint32((1 << level) - 1), np.uint32(0)).astype(np.uint32)
    x ^= gray
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(d):
            key = (key << 1) | ((x[axis] >> np.uint32(level)) & 1)
    return key


def curve_projection(curve: int, size: int, axes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The orthonormal projection (size, axes) and the shift (axes) of one curve."""
    rng = np.random.default_rng([seed, curve])
    basis = np.linalg.qr(rng.normal(size=(size, max(axes, 1))))[0]
    return basis[:, :axes].astype(np.float32), rng.random(axes)


def shifted_keys(ranks: np.ndarray, shift: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of points given by their rank on each axis (0 to 1), moved by the curve's shift."""
    return hilbert_keys(np.minimum((ranks * 0.75 + shift * 0.25) * (1 << bits), (1 << bits) - 1).astype(np.uint32), bits)


class Ordering:
    """One global ordering: axes cut at the quantiles of a sample, and the key ranges of its chunks."""

    def __init__(self, curve: int, sample: np.ndarray, chunks: int, axes: int, bits: int, seed: int):
        self.bits = bits
        self.basis, self.shift = curve_projection(curve, sample.shape[1], axes, seed)
        self.borders = np.sort(sample @ self.basis, axis=0)
        ordered = np.sort(self.keys(sample))
        self.edges = ordered[(np.arange(1, chunks) * len(ordered)) // chunks] if len(ordered) else np.zeros(0, np.int64)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        places = vectors @ self.basis
        ranks = np.stack([np.searchsorted(self.borders[:, a], places[:, a]) for a in range(places.shape[1])], axis=1) / max(len(self.borders), 1)
        return shifted_keys(ranks, self.shift, self.bits)

    def chunk(self, vectors: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, self.keys(vectors), "right")


class Lists:
    """The best ``m`` neighbours of each of ``n`` rows found so far, best first; absent ones are -1."""

    def __init__(self, n: int, m: int):
        self.who, self.score = np.full((n, m), -1, np.int32), np.full((n, m), -9, np.float32)

    def absorb(self, rows: np.ndarray, others: np.ndarray, scores: np.ndarray, k: int) -> int:
        """Merge (row, other, score) triples; returns how many places among the first ``k`` changed."""
        if not len(rows):
            return 0
        seen = np.zeros(len(self.who), bool)
        seen[rows] = True
        touched = np.flatnonzero(seen)
        n, m = len(touched), self.who.shape[1]
        place = np.zeros(len(self.who), np.int64)
        place[touched] = np.arange(n)
        rows = np.concatenate([np.repeat(np.arange(n), m), place[rows]])
        others = np.concatenate([self.who[touched].ravel(), others])
        scores = np.concatenate([self.score[touched].ravel(), scores])
        code = (rows << 32) | (others + 1)
        order = np.argsort(code)
        code = code[order]
        fresh = (code & 0xFFFFFFFF) > 0
        fresh[1:] &= code[1:] != code[:-1]
        kept = order[fresh]
        # Descending scores as ascending whole numbers, behind the row.
        kept = kept[np.argsort((rows[kept] << 32) | (((1.5 - scores[kept].astype(np.float64)) * 2**28).astype(np.int64)))]
        at = rows[kept]
        rank = np.arange(len(at)) - np.searchsorted(at, np.arange(n))[at]
        kept, at, rank = kept[rank < m], at[rank < m], rank[rank < m]
        who, score = np.full((n, m), -1, np.int32), np.full((n, m), -9, np.float32)
        who[at, rank], score[at, rank] = others[kept], scores[kept]
        changed = int((who[:, :k] != self.who[touched, :k]).sum())
        self.who[touched], self.score[touched] = who, score
        return changed


def window_round(unit: np.ndarray, lists: Lists, curve: int, k: int, halo: int, axes: int, bits: int, seed: int, block: int = 64) -> int:
    """Compare each row with the rows at most ``halo`` away on one curve of the chunk; changed places."""
    n = len(unit)
    basis, shift = curve_projection(curve, unit.shape[1], axes, seed)
    places = unit @ basis
    ranks = np.empty(places.shape)
    for a in range(places.shape[1]):
        ranks[np.argsort(places[:, a], kind="stable"), a] = np.arange(n) / n
    order = np.argsort(shifted_keys(ranks, shift, bits), kind="stable")
    moved, least = unit[order], lists.score[order, -1]
    rows, others, scores = [], [], []
    for first in range(0, n, block):
        last, low, high = min(first + block, n), max(0, first - halo), min(n, first + block + halo)
        found = moved[first:last] @ moved[low:high].T
        found[np.arange(last - first), np.arange(first, last) - low] = -9
        if least[first] < -8:  # the first round: the best of the window, whatever their score
            take = min(lists.who.shape[1], high - low - 1)
            c = np.argpartition(-found, take - 1, axis=1)[:, :take].ravel() if take else np.zeros(0, int)
            r = np.repeat(np.arange(last - first), take)
        else:
            r, c = np.nonzero(found > least[first:last, None])
        rows.append(order[first + r])
        others.append(order[low + c].astype(np.int32))
        scores.append(found[r, c])
    return lists.absorb(np.concatenate(rows), np.concatenate(others), np.concatenate(scores), k)


def spread_round(unit: np.ndarray, lists: Lists, active: np.ndarray, k: int, reach: int, block: int = 1024) -> tuple[int, np.ndarray]:
    """Compare the ``active`` rows with the neighbours of their neighbours; changed places, changed rows."""
    n = len(unit)
    near = np.where(lists.who[:, :reach] < 0, np.arange(n, dtype=np.int32)[:, None], lists.who[:, :reach])
    reach = near.shape[1]
    rows, others, scores = [], [], []
    for first in range(0, len(active), block):
        own = active[first : first + block]
        wanted = near[near[own]].reshape(len(own), reach * reach)
        found = np.matmul(unit[wanted], unit[own][:, :, None])[:, :, 0]
        found[wanted == own[:, None]] = -9
        r, c = np.nonzero(found > lists.score[own, -1][:, None])
        rows.append(own[r])
        others.append(wanted[r, c])
        scores.append(found[r, c])
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    before = lists.who[:, :k].copy()
    changed = lists.absorb(rows, np.concatenate(others) if others else np.zeros(0, np.int32), np.concatenate(scores) if scores else np.zeros(0, np.float32), k)
    return changed, np.flatnonzero((before != lists.who[:, :k]).any(1))


def chunk_neighbours(vectors: np.ndarray, ids: np.ndarray, k: int, seed: int, curves: int = 4, halo: int = 32, axes: int = 8, bits: int = 7, spare: int = 2,
                     settled: float = 0.03, most_rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best neighbours of each vector among the others: ids and cosines (12 decimals), best first.

    ``curves`` window rounds come first; then windows of further curves and neighbours of neighbours of
    the rows that still change alternate, until a round changes less than ``settled`` of all places
    (``most_rounds`` at most). Absent neighbours have cosine -9. Ties go to the smaller id.
    """
    n = len(vectors)
    exact = vectors.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1)[:, None]
    unit = exact.astype(np.float32)
    lists = Lists(n, min(k + spare, max(n - 1, 1)))
    for curve in range(curves):
        window_round(unit, lists, curve, k, halo, axes, bits, seed)
    active = np.arange(n)
    for turn in range(most_rounds):
        changed, active = spread_round(unit, lists, active, k, k)
        if changed < settled * n * k:
            break
        if turn:
            window_round(unit, lists, curves + turn, k, halo, axes, bits, seed)
            active = np.arange(n)
    width = lists.who.shape[1]
    found, cosine = np.zeros((n, width), ids.dtype), np.full((n, width), -9.0)
    for first in range(0, n, 4096):
        who = lists.who[first : first + 4096]
        cos = np.round(np.matmul(exact[who], exact[first : first + 4096][:, :, None])[:, :, 0], 12)
        cosine[first : first + 4096] = np.where(who < 0, -9, cos)
        found[first : first + 4096] = ids[who]
    order = np.lexsort((found, -cosine), axis=1)[:, :k]
    return np.take_along_axis(found, order, 1), np.take_along_axis(cosine, order, 1)


def best_of(keys: np.ndarray, others: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest distinct others of each key, in order; those of distance over 8 are absent."""
    order = np.lexsort((others, far, keys))
    keys, others, far = keys[order], others[order], far[order]
    kept = far < 8
    kept[1:] &= (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])
    keys, others, far = keys[kept], others[kept], far[kept]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(keys)]])))
    first = rank < k
    return keys[first], others[first], far[first]


def orderings_for(chunks: int) -> int:
    """Orderings that keep neighbours together: 4 for one or two ranges, 5 more for ten times as many."""
    return max(4, math.ceil(2 + 5 * math.log10(max(chunks, 1))))


def _stacked(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, size)


def nearest_vectors(records: DataFrame, id_col: str = "id", vector_col: str = "embedding", size: int = 64, k: int = 10,
                    chunk: int = 65_536, orderings: int | None = None, sampled: int = 20_000, axes: int = 8, bits: int = 7, seed: int = 7) -> DataFrame:
    """Rows (id, neighbour, cosine, rank): the k most similar records of every record by cosine.

    Ties (equal to 12 decimals) go to the smaller id; a record is not its own neighbour. Records
    with a null id, or whose vector is null, has another number of components than ``size``, holds a
    null or no finite number, or is all zeros take no part. Rows of equal id count once. The same
    direction under another id is a neighbour of cosine 1. Fewer than k other records give fewer
    rows; an empty table gives none. Other columns are ignored.

    The result is approximate where there are more than ``k`` directions. It is the same at every run
    and every number of partitions: the key ranges come from a sample of at most ``sampled`` vectors
    and 100 a range, first by a hash; every vector is placed and searched.
    """
    axes = min(axes, size)
    spark = records.sparkSession

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)
            unit = raw.astype(np.float64)
            norms = np.linalg.norm(unit, axis=1)
            good = np.isfinite(norms) & (norms > 0)
            raw, unit = raw[good], np.round(unit[good] / norms[good][:, None], 12) + 0.0
            marks = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in unit]
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), pa.array(marks, pa.binary()), pa.array([row.tobytes() for row in raw], pa.binary())], ["id", "mark", "vec"])

    usable = records.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == size) & ~F.exists("v", lambda x: x.isNull())
    )
    marked = usable.mapInArrow(prepare, "id long, mark binary, vec binary")
    # The k + 1 smallest ids of a direction are all that can be among k nearest; the limit acts before the shuffle.
    ranked = marked.withColumn("n", F.dense_rank().over(Window.partitionBy("mark").orderBy("id"))).where(F.col("n") <= k + 1)
    groups = checkpoint(ranked.groupBy("mark").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.max("vec").alias("vec")).withColumn("gid", F.col("ids")[0]))

    n = groups.count()
    chunks = max(1, math.ceil(n / chunk))
    wanted = sampled + 100 * chunks
    drawn = groups.where(F.pmod(F.xxhash64("mark"), F.lit(1 << 30)) < (wanted << 30) // n) if n > wanted else groups
    rows = drawn.select("gid", "vec").toArrow()
    sample = _stacked(rows.column("vec").combine_chunks(), size).astype(np.float64) if rows.num_rows else np.zeros((0, size))
    sample = (sample / np.linalg.norm(sample, axis=1)[:, None]).astype(np.float32) if len(sample) else sample.astype(np.float32)
    count = orderings or orderings_for(chunks)
    model = spark.sparkContext.broadcast([Ordering(c, sample, chunks, axes, bits, seed) for c in range(count)])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _stacked(batch.column("vec"), size)
            unit = (vectors / np.linalg.norm(vectors.astype(np.float64), axis=1)[:, None]).astype(np.float32)
            for curve, ordering in enumerate(model.value):
                part = pa.array((curve * chunks + ordering.chunk(unit)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part, batch.column("ids"), batch.column("vec")], ["part", "ids", "vec"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        of = whole.column("part").to_numpy()
        for part in np.unique(of):
            held = whole.filter(pa.array(of == part)) if len(np.unique(of)) > 1 else whole
            lists = held.column("ids").combine_chunks()
            members, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            gids = members[starts[:-1]]
            # The order of arrival must not matter, as several steps break ties by place.
            order = np.argsort(gids)
            vectors = _stacked(held.column("vec").combine_chunks(), size)[order]
            near, cosine = chunk_neighbours(vectors, order, k, seed + 1000 * (1 + int(part) // chunks))
            yield from _expanded(gids, members, starts, order, near, cosine, k)

    kinds = "part int, ids array<long>, vec binary"
    by_range = groups.select("ids", "vec").mapInArrow(placed, kinds).repartitionById(count * chunks, F.col("part"))
    per_range = by_range.mapInArrow(search, "gid long, near array<long>, far array<double>")
    merged = per_range.groupBy("gid").agg(F.collect_list(F.struct("near", "far")).alias("lists")).select("gid", F.flatten("lists.near").alias("near"), F.flatten("lists.far").alias("far"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            gids = np.repeat(batch.column("gid").to_numpy(zero_copy_only=False), np.diff(near.offsets.to_numpy()))
            gids, others, far = best_of(gids, near.flatten().to_numpy(zero_copy_only=False), batch.column("far").flatten().to_numpy(zero_copy_only=False), k + 1)
            firsts = np.flatnonzero(np.concatenate([[True], gids[1:] != gids[:-1]])) if len(gids) else np.zeros(0, int)
            offsets = pa.array(np.append(firsts, len(gids)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(gids[firsts]), pa.ListArray.from_arrays(offsets, pa.array(others)), pa.ListArray.from_arrays(offsets, pa.array(far))], ["gid", "near", "far"])

    lists = merged.mapInArrow(merge, "gid long, near array<long>, far array<double>")
    # Every record of a direction has its list, without itself; most directions have one record.
    several = groups.where(F.size("ids") > 1).select("mark", "gid")
    copies = hot_key_join(marked.select("id", "mark").distinct(), several, ["mark"]).where(F.col("id") != F.col("gid")).select("id", "gid")
    both = lists.withColumn("id", F.col("gid")).unionByName(hot_key_join(copies, lists, ["gid"]))
    pairs = both.select("id", F.arrays_zip("near", "far").alias("list"))
    others = F.slice(F.filter("list", lambda p: p["near"] != F.col("id")), 1, k)
    return pairs.select("id", F.posexplode(others).alias("rank", "p")).select("id", F.col("p.near").alias("neighbour"), (-F.col("p.far")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def _expanded(gids: np.ndarray, members: np.ndarray, starts: np.ndarray, order: np.ndarray, near: np.ndarray, cosine: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Lists of records from lists of groups: row i of ``near`` belongs to group order[i]."""
    sizes = np.diff(starts)
    for first in range(0, len(near), 8192):
        rows = order[first : first + 8192]
        groups = np.concatenate([rows[:, None], near[first : first + 8192]], axis=1).ravel()
        far = np.concatenate([np.full((len(rows), 1), -1.0), -cosine[first : first + 8192]], axis=1).ravel()
        keys = np.repeat(gids[rows], near.shape[1] + 1)
        groups, far, keys = groups[far < 8], far[far < 8], keys[far < 8]
        lengths = sizes[groups]
        at = np.repeat(starts[groups] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        keys, others, far = best_of(np.repeat(keys, lengths), members[at], np.repeat(far, lengths), k + 1)
        firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        offsets = pa.array(np.append(firsts, len(keys)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(keys[firsts]), pa.ListArray.from_arrays(offsets, pa.array(others)), pa.ListArray.from_arrays(offsets, pa.array(far))], ["gid", "near", "far"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Unordered pairs of uploads of which either is among the 10 nearest of the other."""
    near = nearest_vectors(table(spark, folder, "uploaded_documents"))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
