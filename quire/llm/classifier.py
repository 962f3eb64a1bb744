"""Quality classifier: a factorisation machine over hashed words, statistics of the text's structure, and metadata.

A text becomes a sparse vector: hashed words with damped counts, and one indicator for the level of each statistic and
of the stated number of characters. The machine scores it as

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

of which the pair term is half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so a score takes time in the number of
features. Labels, language, source and doc_id are no features.

Fitting takes at most ``SAMPLE`` labelled documents, those with the smallest hashes of their ids, and the model has a fixed
size, so what the driver holds and broadcasts does not grow with the corpus. Every whole text is scored.

Defined results: a null or blank text has no word features and is scored by the rest; a null n_chars counts as the
text's own length; a document with several labels takes the more frequent one (1 on a tie), null labels are
ignored; without labels of both kinds the score is the share of label 1 (0.5 without any); repeated rows are each
scored; an empty table gives an empty table; further columns are ignored (classify: kept).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import scope, stash

WORDS, LEVELS, RANK, SAMPLE = 1 << 16, 16, 8, 8000
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.1, 1e-4
_UPPER, _LOWER, _DIGIT, _MARKS, _SHOUT, _STOP = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>", "!?", ".,;:"))
_HIGH = bytes(range(128, 256))


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def statistics(text: bytes, words: list[bytes], distinct: int, n_chars: float) -> list[float]:
    """Statistics of structure, each from 0 to 1 or so; the last is metadata."""
    n, size = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(_count(text, _UPPER) + _count(text, _LOWER), 1)
    return [
        _count(text, _UPPER) / letters,
        _count(text, _DIGIT) / size * 4,
        _count(text, _MARKS) / n / 3,
        _count(text, _SHOUT) / n,
        _count(text, _STOP) / n,
        _count(text, _HIGH) / size,
        sum(map(len, words)) / n / 16,
        max(map(len, words), default=0) / 64,
        distinct / n,
        len(set(lines)) / max(len(lines), 1),
        len(lines) / n * 4,
        np.log1p(len(words)) / 12,
        np.log1p(max(n_chars, 0)) / 16,
    ]


STATISTICS = 13
DIM = WORDS + STATISTICS * LEVELS


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    counts = Counter(words)
    at = np.fromiter((zlib.crc32(w) % WORDS for w in counts), np.int32, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    value /= max(float(np.sqrt((value * value).sum())), 1e-9)
    found = np.array(statistics(data, words, len(counts), len(text or "") if n_chars is None else n_chars))
    level = np.clip(found * LEVELS, 0, LEVELS - 1).astype(np.int32)
    return np.concatenate([at, WORDS + np.arange(STATISTICS, dtype=np.int32) * LEVELS + level]), np.concatenate([value, np.full(STATISTICS, 0.5, np.float32)])


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        spread = self.factor[at] * value[:, None]
        raw = self.bias + float(self.weight[at] @ value) + 0.5 * float((spread.sum(0) ** 2 - (spread**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -50, 50))))


def constant(share: float) -> Machine:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Machine(float(np.log(share / (1 - share))), np.zeros(DIM, np.float32), np.zeros((DIM, RANK), np.float32))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> Machine:
    """Logistic loss, AdaGrad over small batches; the order is seeded, so the same rows give the same machine."""
    if not len(labels):
        return constant(0.5)
    machine = constant(float(labels.mean()))
    if labels.min() == labels.max():
        return machine
    rng = np.random.default_rng(seed)
    w, v = machine.weight, rng.normal(0, 0.02, (DIM, RANK)).astype(np.float32)
    machine.factor = v
    sum_w, sum_v, sum_b = np.full(DIM, 1e-6, np.float32), np.full((DIM, RANK), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            sizes = np.array([len(rows[i][0]) for i in chosen])
            at, x = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
            of, first = np.repeat(np.arange(len(chosen)), sizes), np.r_[0, np.cumsum(sizes)[:-1]]
            spread = v[at] * x[:, None]
            total = np.add.reduceat(spread, first, axis=0)
            raw = machine.bias + np.add.reduceat(w[at] * x, first) + 0.5 * (total**2 - np.add.reduceat(spread**2, first, axis=0)).sum(1)
            off = 1 / (1 + np.exp(-np.clip(raw, -50, 50))) - labels[chosen]
            unique, back = np.unique(at, return_inverse=True)
            pull = off[of] * x
            g_w = np.bincount(back, pull, len(unique)) / len(chosen) + DECAY * w[unique]
            by_factor = pull[:, None] * (total[of] - spread)
            g_v = np.stack([np.bincount(back, by_factor[:, f], len(unique)) for f in range(RANK)], 1) / len(chosen) + DECAY * v[unique]
            sum_w[unique] += g_w**2
            sum_v[unique] += g_v**2
            w[unique] -= RATE * g_w / np.sqrt(sum_w[unique])
            v[unique] -= 0.3 * RATE * g_v / np.sqrt(sum_v[unique])
            sum_b += off.mean() ** 2
            machine.bias -= RATE * off.mean() / np.sqrt(sum_b)
    return machine


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _n_chars(docs: DataFrame) -> Column:
    return (docs["n_chars"] if "n_chars" in docs.columns else F.lit(None)).cast("double")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents that are not held out."""
    usable = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(labels["doc_id"]))
    voted = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [features(t.as_py(), n.as_py()) for t, n in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in both], pa.list_(pa.int32())), pa.array([x for _, x in both], pa.list_(pa.float32()))], ["k", "label", "at", "value"])

    texts = docs.select(F.col("doc_id").alias("text_id"), F.col("text").cast("string").alias("text"), _n_chars(docs).alias("n_chars"))
    with scope(docs.sparkSession):
        chosen = stash(voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample").withColumnRenamed("doc_id", "labelled_id")
        read = texts.join(chosen, F.col("text_id") == F.col("labelled_id")).select(F.xxhash64("labelled_id", "text").alias("k"), "label", "text", "n_chars")
        # Repeated ids could bring more rows than labels; the smallest hashes stay.
        found = read.mapInArrow(run, "k long, label int, at array<int>, value array<float>").orderBy("k", "label").limit(sample).toArrow()
    rows = [(np.asarray(a.values, np.int32), np.asarray(v.values, np.float32)) for a, v in zip(found["at"], found["value"])]
    return train(rows, found["label"].to_numpy().astype(np.float64))


def scorer(spark: SparkSession, machine: Machine):
    """A column function of text and n_chars. The machine it broadcasts has a fixed size of 2.4 MB."""
    shared = spark.sparkContext.broadcast(machine)

    @arrow_udf("double")
    def score(texts: pa.Array, n_chars: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(*features(t.as_py(), n.as_py())) for t, n in zip(texts, n_chars)], pa.float64())

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    out = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), score(docs["text"].cast("string"), _n_chars(docs)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least ``least``."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), score(docs["text"].cast("string"), _n_chars(docs)).alias("score"))
    return rows.filter(F.col("score") >= least).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
