"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import Unions
from .common import keep, scope, stash

#: So many edges, 16 MB, are one task's work.
FEW = 1 << 20


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> node, root."""
    held = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    nodes, ends = np.unique(np.concatenate([held["a"].to_numpy(), held["b"].to_numpy()]), return_inverse=True)
    sets = Unions(len(nodes))
    sets.add(ends[: len(held)], ends[len(held) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[sets.roots(np.arange(len(nodes)))])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """a, b (any order) -> node, root: the smallest node that each node of an edge can reach.

    Large-star and small-star steps in turn until nothing changes, which takes about the logarithm of the longest path. Each
    joins the edges with the least neighbour of a node, which is summed before the shuffle, so a node with very many
    edges isn't gathered in one task. Every step is a table in the shared folder, of which the last stays: no step
    depends on executors of an earlier one. At most ``FEW`` edges between numbers are joined in one task instead, which saves the driver
    the jobs, plans and files of all the steps.
    """
    spark = edges.sparkSession
    with scope(spark):
        now = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        if [t for _, t in now.dtypes] == ["bigint", "bigint"] and now.count() <= FEW:
            return keep(stash(now.coalesce(1).mapInArrow(_rooted, "node long, root long"), "rooted"))
        last, state = None, ()
        while state != last:
            last = state
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            stars = large.join(least, "a")
            now = stash(stars.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(stars.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
            state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        keep(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
