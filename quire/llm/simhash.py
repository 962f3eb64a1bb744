"""SimHash near-duplicates with BK-trees.

``component_report`` links fingerprints of 3-word shingles that differ in two bits or fewer. Fingerprints within two
bits agree in one of three blocks of bits, so each goes to three shards, one by each block's value, and a shard is
one BK-tree: all links are found, and no shard holds all fingerprints. Trees go to the tasks by this shuffle,
not by broadcast, because a broadcast of trees would grow with the corpus. Equal fingerprints are one node with
the smallest doc_id, and a shard gives a spanning forest of its links, not all pairs. Large shards split themselves
by further blocks, see bktree.

``near_dedup`` is the stage that removes near copies of word shingles: five words, Jaccard similarity 0.8. Its
fingerprints are of sets, each shingle once, as is the similarity; two such sets are further apart than ``near_radius``
with probability 1e-6, and that radius is too wide for blocks of bits. Its shards are therefore keyed by pairs of
min-hashes (eight pairs; two texts of similarity 0.8 miss each other in all with probability 0.0003), a shard's
BK-tree is searched with a wide radius, and what it finds is thinned by a sketch of 256 bins (a standard error of at
most 0.025; ``LOOSE`` is six of them below 0.8). Texts that such loose links join are fetched by their key, and each
link that counts is verified on the whole sets of their shingles. Loose links only gather the texts to compare: all
pairs of a loose group that aren't joined yet are candidates, so a loose link that fails hides no other.

Defined results: a null or blank text has no words and fingerprint 0, linked like any other (near_dedup: such texts are
copies of each other); a null doc_id takes part, but names a component only if no other id does; repeated rows give
a row each (near_dedup: one stays); an empty table gives an empty table; further columns are ignored (near_dedup: kept).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .bktree import spanning
from .common import keep, scope, stash
from .graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
NEAR_SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, BINS = 8, 2, 256
#: So far below the similarity may an estimate from bins be.
LOOSE = 0.15
#: Odd multipliers of the min-hashes, from a fixed generator.
_MULTIPLY = np.random.default_rng(7).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, size: int) -> tuple[bytes, np.ndarray]:
    """The words of the text in lower case (A to Z only), joined by spaces, and the XXH64 of each shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if not words:
        return joined, np.empty(0, np.uint64)
    if len(words) <= size:
        return joined, np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    digest = xxhash.xxh64_intdigest
    return joined, np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes. Long texts are counted in parts."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def bits_apart(common: int, a: int, b: int) -> float:
    """Probability that a bit of the fingerprint differs in two sets with so many hashes in common, and of their own."""
    ones = lambda n: np.array([math.comb(n, k) / 2**n for k in range(n + 1)])
    k = np.arange(common + 1)[:, None]
    first, second = (((2 * (k + np.arange(n + 1)) > common + n) * ones(n)).sum(1) for n in (a, b))
    return float((ones(common) * (first * (1 - second) + second * (1 - first))).sum())


@cache
def near_radius(similarity: float, miss: float = 1e-6) -> int:
    """The bits within which two sets of at least this similarity lie but for a probability of ``miss``.

    Small sets, with their ties, are the worst case and are counted out; for large ones the angle of the sets is the bound.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for common in range(1, 33):
        more = int(common * (1 / similarity - 1) + 1e-9)
        p = max([p, *(bits_apart(common, a, b) for a in range(more + 1) for b in range(a, more - a + 1))])
    beyond = 1.0
    for radius in range(64):
        beyond -= math.comb(64, radius) * p**radius * (1 - p) ** (64 - radius)
        if beyond <= miss:
            return radius
    return 64


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, print: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(t.as_py(), size)[1]) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, print long")


def groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of at least so many rows, if there are, from batches sorted by their first column; no group is cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        # A group that goes on for long is looked at again only after it has doubled.
        least = max(1 << 15, 2 * rows)
    if held:
        yield pa.Table.from_batches(held)


def _cuts(key: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    return [(int(s), int(e)) for s, e in zip(at[:-1], at[1:]) if e - s > 1]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (column print) -> a, b: a spanning forest of the links in each shard."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    blocks = list(zip(edges, edges[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            key, own = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
            a, b = [], []
            for s, e in _cuts(key):
                lo, hi = blocks[int(key[s]) >> 32]
                root = spanning(own[s:e], radius, (hi, 64) if 64 - hi >= lo else (0, lo))
                joined = np.flatnonzero(root != np.arange(e - s))
                a.append(own[s:e][joined])
                b.append(own[s:e][root[joined]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    value = lambda s, e: F.shiftrightunsigned("print", s).bitwiseAND(F.lit((1 << (e - s)) - 1))
    keys = F.array(*[F.lit(i << 32) + value(s, e) for i, (s, e) in enumerate(blocks)])
    dealt = prints.select(F.explode(keys).alias("key"), "print").repartition("key").sortWithinPartitions("key", "print")
    return dealt.mapInArrow(run, "a long, b long")


def component_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    prints = stash(fingerprints(docs), "prints")
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    with scope(docs.sparkSession):
        found = components(links(nodes.select("print")))
        rooted = nodes.join(found, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root"))
        rooted = keep(stash(rooted, "rooted"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, "root").select("print", "component_id")
    return prints.join(labels, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of min-hashes, and for each of 256 bins a byte of its least hash (0: empty)."""
    hashes = np.unique(hashes)
    bins = np.zeros(BINS, np.uint8)
    at, first = np.unique(hashes >> np.uint64(56), return_index=True)
    bins[at] = 1 + hashes[first] % np.uint64(255)
    if not len(hashes):
        return np.zeros(0, np.int64), bins
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        mixed = (part ^ (part >> np.uint64(31)))[None, :] * _MULTIPLY[:, None]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(1))
    keys = least.reshape(BANDS, ROWS)
    mixed = (keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] >> np.uint64(7)) ^ np.arange(BANDS, dtype=np.uint64)
    return mixed.view(np.int64), bins


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows of sketches have at least this estimated Jaccard similarity."""
    used = ((a | b) != 0).sum(1)
    return ((a == b) & (a != 0)).sum(1) >= similarity * used


def text_key(text: str | None) -> int:
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), SEED)


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def describe_texts(docs: DataFrame, size: int = NEAR_SHINGLE) -> DataFrame:
    """doc_id, key (hash of the words), print, bands, bins of every document."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in batch.column(1):
                joined, hashes = shingle_hashes(t.as_py(), size)
                bands, bins = sketch(hashes)
                for x, v in zip(out, (xxhash.xxh64_intdigest(joined, SEED), fingerprint(np.unique(hashes)), bands, bins.tobytes())):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(out[0]), _signed(out[1]), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], ["doc_id", "key", "print", "bands", "bins"])

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(describe, f"doc_id {id_type}, key long, print long, bands array<long>, bins binary")


def exactly_alike(sets: list[np.ndarray], similarity: float):
    """A test of pairs (arrays of indices) for at least this Jaccard similarity of whole sets of distinct hashes."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = [ids[e - n : e] for e, n in zip(ends, sizes)]
    marks = np.zeros(len(vocabulary), bool)
    ratio = Fraction(str(similarity))

    def accept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.minimum(sizes[x], sizes[y]) * ratio.denominator >= np.maximum(sizes[x], sizes[y]) * ratio.numerator
        last = -1
        for at in (able := np.flatnonzero(out))[np.argsort(x[able], kind="stable")]:
            a, b = int(x[at]), int(y[at])
            if a != last:
                if last >= 0:
                    marks[own[last]] = False
                marks[own[a]] = True
                last = a
            both = int(np.count_nonzero(marks[own[b]]))
            out[at] = both * ratio.denominator >= (sizes[a] + sizes[b] - both) * ratio.numerator
        if last >= 0:
            marks[own[last]] = False
        return out

    return accept


def verified(members: DataFrame, size: int, similarity: float, radius: int) -> DataFrame:
    """group, key, print, text of texts in loose groups -> a, b: a spanning forest of the exact links in each group."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1 << 10):
            group, key, own, text = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy().view(np.uint64), table.column(3)
            a, b = [], []
            for s, e in _cuts(group):
                # Rows that repeat a text stand beside each other.
                at = s + np.flatnonzero(np.r_[True, np.diff(key[s:e]) != 0])
                sets = [np.unique(shingle_hashes(text[int(i)].as_py(), size)[1]) for i in at]
                root = spanning(own[at], radius, limit=1 << 62, accept=exactly_alike(sets, similarity))
                joined = np.flatnonzero(root != np.arange(len(at)))
                a.append(key[at[joined]])
                b.append(key[at[root[joined]]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    return members.select("group", "key", "print", "text").repartition("group").sortWithinPartitions("group", "key").mapInArrow(link, "a long, b long")


def near_groups(described: DataFrame, rows: DataFrame, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """key, keeper, keeper_id: each distinct text, and the text of its group that stays, with its doc_id.

    rows has own_key, own_id and own_text of all documents; it is read again for the texts in loose groups.
    """
    radius = near_radius(similarity) if radius is None else radius

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1 << 12):
            band, key = table.column(0).to_numpy(), table.column(1).to_numpy()
            own, bins = table.column(2).to_numpy().view(np.uint64), np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(-1, BINS)
            a, b = [], []
            for s, e in _cuts(band):
                some = bins[s:e]
                root = spanning(own[s:e], radius, limit=1 << 62, accept=lambda x, y, some=some: alike(some[x], some[y], similarity - LOOSE))
                joined = np.flatnonzero(root != np.arange(e - s))
                a.append(key[s:e][joined])
                b.append(key[s:e][root[joined]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    least = described.groupBy("key").agg(F.min("doc_id").alias("least"))
    texts = stash(described.dropDuplicates(["key"]).select("key", "print", "bands", "bins"), "texts")
    met = texts.select("key", F.explode("bands").alias("band"))
    shared = met.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    met = met.join(shared, "band").join(texts.select("key", "print", "bins"), "key")
    found = met.select("band", "key", "print", "bins").repartition("band").sortWithinPartitions("band", "key").mapInArrow(link, "a long, b long")
    loose = stash(components(found).join(least, F.col("node") == F.col("key")).join(texts.select("key", "print"), "key").select("key", "print", F.col("root").alias("group"), "least"), "loose")
    # What is joined with the texts grows with the corpus: never broadcast, so plans are alike at every size.
    members = rows.join(loose.hint("merge"), (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("least"))).select("group", "key", "print", F.col("own_text").alias("text"))
    roots = components(verified(members, size, similarity, radius))
    rooted = least.join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    rooted = stash(rooted, "rooted")
    keeper = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("k"))
    return rooted.join(keeper, "root").select("key", F.col("k.key").alias("keeper"), F.col("k.least").alias("keeper_id"))


def near_dedup(docs: DataFrame, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs of which no other row of the same group has a smaller doc_id."""

    @arrow_udf("long")
    def key_of(texts: pa.Array) -> pa.Array:
        return _signed([text_key(t.as_py()) for t in texts])

    with scope(docs.sparkSession):
        described = stash(describe_texts(docs, size), "described")
        texts = docs["text"].cast("string")
        read = docs.select(key_of(texts).alias("own_key"), docs["doc_id"].alias("own_id"), texts.alias("own_text"))
        kept = near_groups(described, read, size, similarity).filter("key = keeper").select(F.col("key").alias("kept_key"), F.col("keeper_id").alias("kept_id"))
        kept = keep(stash(kept, "kept"))
        repeated = described.groupBy("doc_id", "key").count().filter("count > 1").limit(1).count()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own_id"), key_of(docs["text"].cast("string")).alias("own_key"))
    held = rows.join(kept.hint("merge"), (F.col("own_key") == F.col("kept_key")) & F.col("own_id").eqNullSafe(F.col("kept_id")))
    # Only if a table repeats rows do copies with the id of the one that stays remain.
    if repeated:
        held = held.dropDuplicates(["own_id", "own_key"])
    return held.select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
