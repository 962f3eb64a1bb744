"""Hard negatives: for an anchor and each of its nearest rows of its own label, the nearest rows of other labels within a band of scores.

Components are floored to integers, and a score is the integer inner product. Vectors are turned by an orthogonal matrix, the
principal axes of all rows, so that few leading components hold most of a product. What the components up to a cut give is
known, the rest is at most the product of the lengths of the two remainders (Cauchy-Schwarz); with room for rounding this bounds
the score from both sides. A pair goes on to the next cut only while its bounds still reach what is wanted of the anchor, which rises
as rows pass; the few that reach the end are verified with integer products. So nothing that belongs to the result is dropped.

There are two meetings of anchors and rows, both with the same step. The first, among rows of one label, gives the
positives. Their scores bound the bands of the second, with rows of other labels. In a meeting rows are dealt to shards, anchors to
blocks, and each pair of shard and block is one task's work: it holds the block, and the shard passes through it some rows at a time. Both
have so many vectors that they take a fixed space whatever their dimension, and a label with very many rows has many shards. Each task
keeps at most ``POSITIVES`` rows an anchor, or ``NEGATIVES`` a positive.

The axes are those of the second moments of about ``SAMPLE`` rows of each dimension, those with the smallest hashes; other axes would
change how early pairs are dropped, not what is found.

Defined results: rows with a null label, vec_id or vector, or any null or non-finite component take no part; so doesn't a row whose component
is no number once scaled. Rows meet only rows of their own dimension. Rows that repeat a vec_id count once, with the
smallest label, then vector. Equal scores are ordered by vec_id. An anchor without other rows of its label, or a
positive without rows in its band, gives no rows. Scores beyond 64 bits count as the largest or smallest that fits. An empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, scope, stash

EVERY, POSITIVES, NEGATIVES, SCALE = 100, 5, 10, 256
#: The band of a negative's score, in hundredths of the positive's.
BAND = (30, 90)
#: Rows that the axes are fitted on, about; numbers (rows times dimension) of a shard and of a block; rows and anchors multiplied at once.
SAMPLE, SHARD, BLOCK, TOGETHER = 4096, 1 << 20, 1 << 22, 1024
#: Shares of the components after which bounds are taken; share of pairs below which those left are no longer multiplied as a matrix.
CUTS, SPARSE = (0.25, 0.5, 0.75, 1.0), 0.05
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_KEYS = ("dim", "family", "shard", "block", "kind")
_AXES, _ANCHOR, _ROW = 0, 1, 2
#: What a meeting reads, in order.
_STREAM = "dim int, family long, shard int, block int, kind int, vec_id long, label long, vector array<double>, positives array<long>, scores array<long>"


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole numbers, cut to 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a * b).sum(1).astype(np.int64)
    if most < 2.0**62:
        return (a.astype(np.int64) * b.astype(np.int64)).sum(1)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(p, q)), _LEAST), _MOST) for p, q in zip(a, b)], np.int64)


class Turned:
    """Vectors along the axes, and what bounds of their products need: lengths, and lengths of what follows each cut."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray):
        self.whole = vectors
        with np.errstate(over="ignore", invalid="ignore"):
            self.parts = vectors @ axes
            squares = np.cumsum(self.parts[:, ::-1] ** 2, 1)[:, ::-1]
            self.lengths = np.sqrt((vectors * vectors).sum(1))
        dim = vectors.shape[1]
        self.cuts = sorted({round(c * dim) for c in CUTS})
        self.rests = [np.sqrt(squares[:, c]) if c < dim else np.zeros(len(vectors)) for c in self.cuts]
        # Errors of the turn, of the sums and of axes that aren't quite orthogonal, for each unit of both lengths.
        self.slack = float(np.abs(axes.T @ axes - np.eye(dim)).sum()) + 16 * (dim + 1) ** 1.5 * float(np.finfo(float).eps)


class Block:
    """Anchors with up to ``slots`` bands of scores each, and the best ``k`` rows of every band so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, turned: Turned, lows: np.ndarray, highs: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.turned, self.lows, self.highs, self.k, self.same = ids, labels, turned, lows, highs, k, same
        # A bound rounded to a double may not cut more than the integer it stands for.
        self.floor = np.nextafter(lows.astype(float), -np.inf)
        self.ceiling = np.nextafter(highs.astype(float), np.inf)
        self.floor[lows > highs], self.ceiling[lows > highs] = np.inf, -np.inf
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.verified = 0

    def meet(self, ids: np.ndarray, labels: np.ndarray, rows: Turned) -> None:
        """Take what belongs to the best of each band from some rows."""
        own, slots = self.turned, self.lows.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            for start in range(0, len(self.ids), TOGETHER):
                some = slice(start, start + TOGETHER)
                low, high = self.floor[some].min(1)[:, None], self.ceiling[some].max(1)[:, None]
                product, keep, done = 0.0, None, 0
                for i, cut in enumerate(own.cuts):
                    last = own.cuts[i - 1] if i else 0
                    product = product + own.parts[some, last:cut] @ rows.parts[:, last:cut].T
                    room = np.outer(own.rests[i][some], rows.rests[i]) + own.slack * np.outer(own.lengths[some], rows.lengths)
                    # Written so that bounds that are no numbers drop nothing.
                    keep = ~(product + room < low) & ~(product - room > high)
                    if not i:
                        wanted = ((self.labels[some, None] == labels) == self.same) & (self.ids[some, None] != ids)
                    keep &= wanted
                    done = i
                    if np.count_nonzero(keep) < SPARSE * keep.size:
                        break
                a, r = np.nonzero(keep)
                product, a = product[a, r], a + start
                for i in range(done, len(own.cuts)):
                    if i > done:
                        last, cut = own.cuts[i - 1], own.cuts[i]
                        product = product + (own.parts[a, last:cut] * rows.parts[r, last:cut]).sum(1)
                    room = own.rests[i][a] * rows.rests[i][r] + own.slack * own.lengths[a] * rows.lengths[r]
                    open_ = (~((product + room)[:, None] < self.floor[a]) & ~((product - room)[:, None] > self.ceiling[a])).any(1)
                    a, r, product = a[open_], r[open_], product[open_]
                self.verified += len(a)
                scores = exact(own.whole[a], rows.whole[r])
                at, j = np.nonzero((self.lows[a] <= scores[:, None]) & (scores[:, None] <= self.highs[a]))
                self._take(a[at] * slots + j, scores[at], ids[r[at]])

    def _take(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = rank < self.k
        full = rank == self.k - 1
        rows, cols = np.divmod(slot[full], self.lows.shape[1])
        self.floor[rows, cols] = np.maximum(self.floor[rows, cols], np.nextafter(score[full].astype(float), -np.inf))
        self.slot, self.score, self.id = slot[best], score[best], ids[best]


def usable(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector of whole numbers, dim of the rows that take part."""
    vector = F.transform(table["embedding"].cast("array<double>"), lambda x: x * scale)
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), table["label"].cast("long").alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    # FLOOR of a double is a long, which very long vectors don't fit; whole numbers stay doubles.
    floored = F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    rows = rows.select("vec_id", "label", floored.alias("vector"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("vec_id", "row.label", "row.vector", F.size("row.vector").alias("dim"))


def fitted_axes(rows: DataFrame) -> DataFrame:
    """dim, axes: the principal axes of about ``SAMPLE`` rows of each dimension, most important first, flattened."""
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"))
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 31)) * F.col("n") < F.lit(SAMPLE << 31).cast("double")
    sample = rows.join(sizes, "dim").filter(drawn & (F.col("dim") > 0)).select("dim", "vector")

    def fit(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        x = np.array(group["vector"].combine_chunks().flatten()).reshape(-1, dim)
        x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1)
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        return pa.table({"dim": pa.array([dim], pa.int32()), "axes": pa.array([axes.ravel().tolist()], pa.list_(pa.float64()))})

    return sample.groupBy("dim").applyInArrow(fit, "dim int, axes array<double>")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """((dim, family, shard, block), kind, rows) of equal keys, at most ``TOGETHER`` rows a time, from batches in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(name).to_numpy() for name in _KEYS], 1)
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)].tolist()
        for s, e in zip(cuts[:-1], cuts[1:]):
            for at in range(s, e, TOGETHER):
                yield tuple(key[s, :4].tolist()), int(key[s, 4]), batch.slice(at, min(TOGETHER, e - at))


def _vectors(held: list[pa.RecordBatch], dim: int) -> np.ndarray:
    return np.concatenate([np.array(b.column("vector").flatten()).reshape(b.num_rows, dim) for b in held])


def _bands(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list[int]]]:
    """Lowest and highest score wanted of each positive of each anchor; without positives, one band of all scores."""
    ids = [x for b in held for x in b.column("positives").to_pylist()]
    scores = [x for b in held for x in b.column("scores").to_pylist()]
    if ids[0] is None:
        return np.full((len(ids), 1), _LEAST), np.full((len(ids), 1), _MOST), ids, scores
    lows, highs = np.ones((len(ids), POSITIVES), np.int64), np.zeros((len(ids), POSITIVES), np.int64)
    for i, row in enumerate(scores):
        for j, s in enumerate(row):
            lows[i, j], highs[i, j] = -(-BAND[0] * s // 100), BAND[1] * s // 100
    return lows, highs, ids, scores


def _meeting(k: int, same: bool):
    """Rows of ``_STREAM`` in order -> anchor_id, positive_id, positive_score, vec_id, score: of each task, the best k of each band."""

    def close(block: Block, ids, scores) -> pa.RecordBatch:
        anchor, j = np.divmod(block.slot, block.lows.shape[1])
        one = [(None, None) if ids[a] is None else (ids[a][c], scores[a][c]) for a, c in zip(anchor.tolist(), j.tolist())]
        columns = [pa.array(block.ids[anchor], pa.int64()), pa.array([x for x, _ in one], pa.int64()), pa.array([x for _, x in one], pa.int64()), pa.array(block.id, pa.int64()), pa.array(block.score, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, axes, held, block, bands = None, None, [], None, None
        for key, kind, piece in _pieces(batches):
            if key != last:
                if block:
                    yield close(block, *bands)
                last, axes, held, block = key, np.eye(key[0]), [], None
            if kind == _AXES:
                axes = np.array(piece.column("vector").flatten()).reshape(key[0], key[0])
            elif kind == _ANCHOR:
                held.append(piece)
            elif held or block:
                if held:
                    ids, labels = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("vec_id", "label"))
                    lows, highs, *bands = _bands(held)
                    block, held = Block(ids, labels, Turned(_vectors(held, key[0]), axes), lows, highs, k, same), []
                block.meet(piece.column("vec_id").to_numpy(), piece.column("label").to_numpy(), Turned(_vectors([piece], key[0]), axes))
        if block:
            yield close(block, *bands)

    return run


def _met(rows: DataFrame, anchors: DataFrame, axes: DataFrame, k: int, same: bool) -> DataFrame:
    """Anchors (with positives and scores, which may be null) against the rows of their dim and family, in shards and blocks."""
    key = ["dim", "family"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).join(anchors.groupBy(*key).agg(F.count("*").alias("m")), key)
    per = lambda total: F.greatest(F.floor(F.lit(total) / F.greatest("dim", F.lit(1))), F.lit(1))
    sizes = stash(sizes.select(*key, F.ceil(F.col("n") / per(SHARD)).cast("int").alias("shards"), F.ceil(F.col("m") / per(BLOCK)).cast("int").alias("blocks")), "sizes")
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    nothing = F.lit(None).cast("array<long>")
    points = rows.join(sizes, key).select(*key, part("shards", 1).alias("shard"), every_of("blocks").alias("block"), F.lit(_ROW).alias("kind"), "vec_id", "label", "vector", nothing.alias("positives"), nothing.alias("scores"))
    asked = anchors.join(sizes, key).select(*key, every_of("shards").alias("shard"), part("blocks", 2).alias("block"), F.lit(_ANCHOR).alias("kind"), "vec_id", "label", "vector", "positives", "scores")
    turned = sizes.join(axes, "dim").select(*key, every_of("shards").alias("shard"), "blocks", "axes").select(*key, "shard", every_of("blocks").alias("block"), F.lit(_AXES).alias("kind"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("label"), F.col("axes").alias("vector"), nothing.alias("positives"), nothing.alias("scores"))
    stream = points.unionByName(asked).unionByName(turned).select(*[f.split()[0] for f in _STREAM.split(", ")])
    stream = stream.repartition(*key, "shard", "block").sortWithinPartitions(*_KEYS, "vec_id")
    return stream.mapInArrow(_meeting(k, same), "anchor_id long, positive_id long, positive_score long, vec_id long, score long")


def mine(table: DataFrame, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors whose vec_id is divisible by ``every``."""
    with scope(table.sparkSession):
        rows = stash(usable(table), "vectors")
        axes = stash(fitted_axes(rows), "axes")
        nothing = F.lit(None).cast("array<long>")
        chosen = F.col("vec_id") % every == 0
        labelled = rows.withColumn("family", F.col("label"))
        near = _met(labelled, labelled.filter(chosen).withColumns({"positives": nothing, "scores": nothing}), axes, POSITIVES, True)
        best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
        near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= POSITIVES)
        near = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("near"))
        near = stash(near.select("vec_id", F.col("near.id").alias("positives"), F.col("near.score").alias("scores")), "positives")
        mixed = rows.withColumn("family", F.lit(0).cast("long"))
        found = _met(mixed, mixed.filter(chosen).join(near, "vec_id"), axes, NEGATIVES, False)
        best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEGATIVES)
        out = stash(found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        return keep(out)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine(table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP11_SQL = """
WITH listed AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), held AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, v) AS nth FROM listed) WHERE nth = 1
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM held a JOIN held b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM pairs WHERE alike) WHERE nth <= 5
), banded AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.alike
  WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM banded WHERE rank <= 10
"""
