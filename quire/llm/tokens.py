"""Token counts from an exact histogram of encoded lengths.

Every document is encoded whole and counted under its length in tokens. The histogram is all that is kept: for each
length the number of documents, and suffix sums that answer, for any context limit, how many documents and tokens are
at least that long, what truncation to the limit leaves, and where quantiles lie. Between two lengths of the
histogram all these are linear in the limit, so its rows answer every limit exactly. The histogram is summed
before the shuffle and has at most one row a distinct length; its suffix sums are taken in blocks of lengths, then over
the blocks.

Defined results: null and empty texts have length 0; text that looks like a special token is ordinary text; repeated rows
count as often as they occur; an empty table gives an empty histogram; further columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut before merging; a fixed value, that of the public byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encoded_lengths(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """n_tokens of every document. The vocabulary has a fixed size and is broadcast, so executors need no file."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter((len(encode(t.as_py() or "")) for t in batch.column(0)), np.int64, batch.num_rows))], ["n_tokens"])

    return docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs and, for a limit of n_tokens, docs_at_least, tokens_at_least, truncated_total, docs_up_to."""
    counted = stash(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    counted = counted.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counted.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above, below = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), nothing).alias("d_above"), F.coalesce(F.sum("t").over(above), nothing).alias("t_above"), F.coalesce(F.sum("d").over(below), nothing).alias("d_below"), F.coalesce(F.sum("t").over(below), nothing).alias("t_below"))
    suffix, prefix = Window.partitionBy("block").orderBy(F.desc("n_tokens")), Window.partitionBy("block").orderBy("n_tokens")
    inside = counted.select("block", "n_tokens", "n_docs", F.sum("n_docs").over(suffix).alias("d_suffix"), F.sum("tokens").over(suffix).alias("t_suffix"), F.sum("n_docs").over(prefix).alias("d_prefix"), F.sum("tokens").over(prefix).alias("t_prefix"))
    out = inside.join(stash(blocks, "blocks"), "block")
    up_to, longer = F.col("t_below") + F.col("t_prefix"), F.col("d_above") + F.col("d_suffix") - F.col("n_docs")
    return out.select("n_tokens", "n_docs", (F.col("d_above") + F.col("d_suffix")).alias("docs_at_least"), (F.col("t_above") + F.col("t_suffix")).alias("tokens_at_least"), (up_to + F.col("n_tokens") * longer).alias("truncated_total"), (F.col("d_below") + F.col("d_prefix")).alias("docs_up_to"))


def totals_at(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, kept_docs (that fit), truncated_total: exact for any limits, of which the histogram need hold none."""
    # Per limit: what is no longer than it counts whole, the rest at the limit. Summed before any shuffle.
    parts = hist.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit"))
    return parts.groupBy("limit").agg(F.sum(F.when(F.col("n_tokens") <= F.col("limit"), F.col("n_docs")).otherwise(0)).alias("kept_docs"), F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_total"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of the documents does not pass."""
    total = hist.agg(F.max("docs_up_to").alias("total")).first()["total"] or 0
    each = [F.min(F.when(F.col("docs_up_to") >= F.lit(x * total), F.col("n_tokens"))).alias(f"q{i}") for i, x in enumerate(shares)]
    row = F.array(*[F.struct(F.lit(x).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, x in enumerate(shares)])
    return hist.agg(*each).select(F.inline(row))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(encoded_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
