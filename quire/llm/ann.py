"""Approximate nearest neighbours by collision counting.

Every vector is projected on each of ``PROJECTIONS`` random lines, and each line keeps its projections as a sorted array. A query
opens a window around its own projection on every line; a vector collides with it once for each line on which it
lies in the window. Windows grow by virtual rehashing, radius by radius, and only what enters them is counted. The first radius is the one
at which half of ``TRIED`` vectors of the shard end their own searches; where the first windows hold more than half of all entries, what lies outside is
counted instead, which gives the same collisions. A vector
that collides on at least the threshold of lines is verified with its true inner product. A query ends when its
neighbours are so near that the windows, ``CERTAIN`` times as wide, would have shown nearer ones, or when all vectors are verified. Nothing else
ends it, so recall doesn't depend on the number of vectors or of their components: a vector as near as the last of those
found lies in a window with the probability that a normal variable is within ``CERTAIN`` (0.911), and on 34 of 40 lines with 0.93; nearer ones with
more. Where vectors have no structure, all are nearly as far and most are verified; where they have, few are.

Largest inner products are nearest neighbours once each vector gets one more coordinate that lifts it to the length
of the longest, and queries get 0 there; projections use these, scores the original vectors in double precision.

Vectors are dealt to shards of bounded size, queries to blocks, and each pair of shard and block is one task's work: it
builds the shard's index once, then the block's queries pass through it. So the stated queries meet all rows, in
blocks, and each keeps its nearest of a shard. More vectors mean more shards, not larger ones.

Lengths are taken as powers of two, and vectors divided by that of the longest, so neither very long nor very short ones overflow.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null
vec_id; vectors meet only vectors of their own dimension; a score that overflows is infinite, and one that is then no number
ranks last; rows that repeat a vec_id count once, with the smallest
vector; equal scores are ordered by vec_id; a query with fewer candidates than neighbours gets all; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

NEIGHBOURS, EVERY = 20, 20
PROJECTIONS, THRESHOLD, START, GROWTH = 40, 0.85, 0.25, 1.25
CERTAIN = 1.7
#: Vectors of a shard whose searches say where others begin.
TRIED = 16
#: Vectors of a shard; queries that pass through one building of its index; queries searched together.
SHARD, BLOCK, TOGETHER = 16384, 1 << 17, 1024


def _shrunk(vectors: np.ndarray, power: np.ndarray | float) -> np.ndarray:
    """vectors / 2**power, in two steps, since the power itself may overflow."""
    half = np.exp2(-np.asarray(power, float) / 2)
    return vectors * half * half


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(1, keepdims=True)
    scaled = _shrunk(vectors, np.frexp(largest)[1])
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


class Shard:
    """Sorted projections of up to a few ten thousand vectors, and the search in them. 2**longest bounds their lengths."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        rng = np.random.default_rng(seed + vectors.shape[1])
        self.lines = rng.normal(size=(PROJECTIONS, vectors.shape[1] + 1))
        self.scaled = _shrunk(vectors, longest)
        # A vector shorter than the longest gets the missing length in one more coordinate.
        lift = np.sqrt(np.maximum(1 - (self.scaled * self.scaled).sum(1), 0))
        spots = self.scaled @ self.lines[:, :-1].T + lift[:, None] * self.lines[:, -1]
        self.order = np.ascontiguousarray(np.argsort(spots, axis=0, kind="stable").T)
        self.spots = np.ascontiguousarray(np.take_along_axis(spots, self.order.T, 0).T)
        self.begin = 0
        tried = np.unique(np.arange(TRIED) * len(ids) // TRIED)
        self.begin = sorted(level for *_, level in self._search(vectors[tried], ids[tried], NEIGHBOURS))[len(tried) // 2]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query, ids and scores of the k nearest found, nearest first, and how many window entries were counted.

        The row with the id in ``own`` is left out.
        """
        for found, scores, entries, _ in self._search(queries, own, k):
            yield found, scores, entries

    def _search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """The same, and the step of the radius at which the query ends."""
        n = len(self.ids)
        units = _unit(queries)
        centres = units @ self.lines[:, :-1].T
        need = math.ceil(THRESHOLD * PROJECTIONS)
        lines = range(PROJECTIONS)
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by radius: where windows start and end, for each query and line
        reaches, last = [START], float(np.abs(self.spots).max() + np.abs(centres).max()) + 1
        while len(reaches) <= self.begin:
            reaches.append(reaches[-1] * GROWTH if reaches[-1] < last else math.inf)
        for q in range(len(queries)):
            level, before, entries = self.begin, None, 0
            seen, near = np.empty(0, np.int64), np.empty(0)
            while True:
                if level not in bounds:
                    ends = [np.stack([np.searchsorted(s, c + side, how) for s, c in zip(self.spots, centres.T)], 1) for side, how in ((-reaches[level], "left"), (reaches[level], "right"))]
                    bounds[level] = ends[0], ends[1]
                    if level + 1 == len(reaches):
                        reaches.append(reaches[level] * GROWTH if reaches[level] < last else math.inf)
                lo, hi = bounds[level][0][q].tolist(), bounds[level][1][q].tolist()
                entries = sum(hi) - sum(lo)
                # A line has each vector once, so one step adds or takes at most one of a count.
                if before is None and 2 * entries > n * PROJECTIONS:
                    counts = np.full(n, PROJECTIONS, np.uint8)
                    for i in lines:
                        counts[self.order[i][: lo[i]]] -= 1
                        counts[self.order[i][hi[i] :]] -= 1
                elif before is None:
                    counts = np.zeros(n, np.uint8)
                    for i in lines:
                        counts[self.order[i][lo[i] : hi[i]]] += 1
                else:
                    for i in lines:
                        counts[self.order[i][lo[i] : before[0][i]]] += 1
                        counts[self.order[i][before[1][i] : hi[i]]] += 1
                before = lo, hi
                fresh = np.flatnonzero(counts >= need)
                if len(fresh) > len(seen):
                    fresh = np.setdiff1d(fresh, seen, assume_unique=True)
                    seen, near = np.r_[seen, fresh], np.r_[near, self.scaled[fresh] @ units[q]]
                # Of unit vectors, the square of a distance is 2 - 2 times the product.
                if len(seen) == n or (len(seen) > k and 2 - 2 * np.partition(near, -k - 1)[-k - 1] <= (reaches[level] / CERTAIN) ** 2):
                    break
                level += 1
            # Exact scores are taken of all that may be among the nearest, with room for rounding.
            at = seen if len(seen) <= k + 1 else seen[near >= np.partition(near, -k - 1)[-k - 1] - 1e-9]
            at = at[self.ids[at] != own[q]]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = (self.vectors[at] * queries[q]).sum(1)
            best = np.lexsort((self.ids[at], -scores))[:k]
            yield self.ids[at[best]], scores[best], entries, level


def usable(table: DataFrame) -> DataFrame:
    """vec_id, vector (array of double), dim of the rows that take part."""
    vector = table["embedding"].cast("array<double>")
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), vector.alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = rows.filter(finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def nearest(table: DataFrame, k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose vec_id is divisible by ``every``."""
    rows = stash(usable(table), "vectors")
    largest = F.array_max(F.transform("vector", F.abs))
    scaled = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.col("largest")) * (x / F.col("largest")))
    asked = F.col("vec_id") % every == 0
    lengths = rows.select("dim", "vec_id", "vector", largest.alias("largest")).select("dim", "vec_id", (F.log2("largest") + F.log2(scaled) / 2).alias("power"))
    sizes = lengths.groupBy("dim").agg(F.count("*").alias("n"), F.max("power").alias("longest"), F.count(F.when(asked, 1)).alias("n_queries"))
    sizes = stash(sizes.select("dim", "longest", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("n_queries") / BLOCK).cast("int").alias("blocks")).filter("blocks > 0"), "dims")
    held = rows.join(sizes, "dim")
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A shard goes to every block, and a block to every shard.
    points = held.select("dim", part("shards", 1).alias("shard"), every_of("blocks").alias("block"), "longest", F.lit(False).alias("asks"), "vec_id", "vector")
    queries = held.filter(asked).select("dim", every_of("shards").alias("shard"), part("blocks", 2).alias("block"), "longest", F.lit(True).alias("asks"), "vec_id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = None, None
        for key, asks, table in _pairs(batches):
            ids = table.column("vec_id").to_numpy()
            vectors = np.array(table.column("vector").combine_chunks().flatten()).reshape(len(ids), -1)
            if not asks:
                shard, last = Shard(ids, vectors, float(table.column("longest")[0].as_py())), key
                continue
            if key != last:
                continue
            out: list[list] = [[], [], []]
            for q, (found, scores, _) in zip(ids, shard.search(vectors, ids, k)):
                out[0].append(np.full(len(found), q))
                out[1].append(found)
                out[2].append(scores)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    both = points.unionByName(queries).repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "asks", "vec_id")
    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.Table]]:
    """((dim, shard, block), whether these are queries, rows) from batches in this order: shards whole, queries some at a time."""
    held: list[pa.RecordBatch] = []
    last, rows = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(3)] + [batch.column("asks").to_numpy(zero_copy_only=False)], 1)
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if held and (tuple(key[s]) != last or (last[3] and rows >= TOGETHER)):
                yield last[:3], bool(last[3]), pa.Table.from_batches(held)
                held, rows = [], 0
            held.append(batch.slice(s, e - s))
            last, rows = tuple(key[s]), rows + e - s
    if held:
        yield last[:3], bool(last[3]), pa.Table.from_batches(held)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
