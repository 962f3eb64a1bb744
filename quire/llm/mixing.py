"""Mixing sources to target weights, in DataFrame operations alone.

Targets are filled like vessels under one water level: each source takes its weight times the level, a source
that would pass its cap (``max_epochs`` times its size) stays at the cap, and what it leaves raises the level of
the rest, by weight. With the sources in order of cap / weight the clamped ones come first, so the level at
which redistribution ends is the largest of (total - caps before) / (weights from here on).

A source whose target is r times its size takes every document floor(r) times, and the fractional rest goes to
the documents that come first in a seeded order of their hashes. How far down that order a source goes is found
without sorting a source: sizes are summed by hash bucket first, the one bucket in which the wanted sum
falls again by the next bits, and only a 2**24th of a source is ordered. Sources themselves are few: they are ordered in one task. The order depends on seed, id and text alone, so reruns and any partitioning agree.

Defined results: null or blank text has size 0; a null source is a source of its own, last in order; a source of
size 0 has target 0; exactly repeated rows share one hash and are drawn together; an empty table gives an empty
table; further columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, keep, scope, stash

WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED = 1.5, 2.0, "mix-1"
#: Hashes have 60 bits; the first 12 choose the bucket, the next 12 a bucket in it.
HASH_BITS, BUCKET_BITS, ROUNDS = 60, 12, 2


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def order_hash(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A document's place in the seeded order, from 0 to 2**60 - 1."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def fill(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> also weight and target. One row a source, so one task orders them all."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / open_weight)
    target = F.least(F.col("cap"), F.col("weight") * F.max("level").over(everything))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, size, hash of every document -> source, source_size, target, whole, upto: one row a source.

    A document is taken ``whole`` times, and once more if its hash is at most ``upto``.
    """
    with scope(sized.sparkSession):
        targets = stash(fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs), "targets")
        epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        targets = targets.withColumn("whole", F.floor(epochs).cast("long"))
        targets = targets.withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
        edge = targets.select(F.col("source").alias("goal_source"), F.lit(0).cast("long").alias("goal_bucket"), F.lit(0).cast("long").alias("start"), "goal").filter("goal > 0")
        shift = HASH_BITS
        for _ in range(ROUNDS):
            inside = sized.join(edge, F.col("source").eqNullSafe(F.col("goal_source")) & (F.shiftright("hash", shift) == F.col("goal_bucket")))
            shift -= BUCKET_BITS
            sums = inside.groupBy("goal_source", F.shiftright("hash", shift).alias("bucket"), "start", "goal").agg(F.sum("size").alias("bucket_size"))
            so_far = Window.partitionBy("goal_source").orderBy("bucket")
            sums = sums.withColumn("upper", F.col("start") + F.sum("bucket_size").over(so_far)).withColumn("lower", F.col("upper") - F.col("bucket_size"))
            edge = stash(sums.filter("lower < goal and upper >= goal").select("goal_source", F.col("bucket").alias("goal_bucket"), F.col("lower").alias("start"), "goal"), "edges")
        inside = sized.join(edge, F.col("source").eqNullSafe(F.col("goal_source")) & (F.shiftright("hash", shift) == F.col("goal_bucket")))
        inside = inside.groupBy("goal_source", "hash", "start", "goal").agg(F.sum("size").alias("size"))
        reach = Window.partitionBy("goal_source").orderBy("hash")
        tried = inside.select("goal_source", "hash", (F.col("start") + F.sum("size").over(reach)).alias("sum"), "goal")
        none = edge.select("goal_source", (F.shiftleft(F.col("goal_bucket"), shift) - 1).alias("hash"), F.col("start").alias("sum"), "goal")
        found = tried.unionByName(none).groupBy("goal_source").agg(F.min(F.struct(F.abs(F.col("sum") - F.col("goal")).alias("off"), "hash")).alias("best"))
        cut = found.select("goal_source", F.col("best.hash").alias("upto"))
        out = targets.join(cut, F.col("source").eqNullSafe(F.col("goal_source")), "left")
        return keep(stash(out.select("source", "source_size", "target", "whole", F.coalesce("upto", F.lit(-1)).alias("upto")), "mix"))


def times() -> Column:
    return F.col("whole") + F.when(F.col("hash") <= F.col("upto"), 1).otherwise(0)


def sized_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", size_of(docs["text"]).alias("size"), order_hash(docs["doc_id"], docs["text"], seed).alias("hash"))


def mix_report(docs: DataFrame, seed: str = SEED, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized = stash(sized_documents(docs, seed), "sized")
    sources = plan(sized, **settings).withColumnRenamed("source", "mix_source")
    joined = sized.join(sources, F.col("source").eqNullSafe(F.col("mix_source")), "left")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED, **settings) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, with its own columns."""
    with scope(docs.sparkSession):
        sources = keep(plan(stash(sized_documents(docs, seed).select("source", "size", "hash"), "sized"), **settings)).withColumnRenamed("source", "mix_source")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("source"), order_hash(docs["doc_id"], docs["text"], seed).alias("hash"))
    joined = packed.join(sources, F.col("source").eqNullSafe(F.col("mix_source")))
    taken = joined.filter(times() > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), times())).alias("copy"))
    return taken.select("row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), r AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS goal,
         sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE UNBOUNDED PRECEDING)::BIGINT AS reach
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT source, hash, abs(reach - goal) AS off FROM r WHERE goal > 0
  UNION ALL SELECT DISTINCT source, -1, goal FROM r WHERE goal > 0
), u AS (
  SELECT source, hash AS upto FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, hash) = 1
)
SELECT r.doc_id, r.size, r.source_size, r.target, r.size * (r.whole + CASE WHEN r.hash <= u.upto THEN 1 ELSE 0 END) AS taken
FROM r LEFT JOIN u ON r.source IS NOT DISTINCT FROM u.source
"""
