"""Spelling variants: words that differ by one character, and the frequent word that each rare one stands for.

One edit leaves one half of a word as it is. So every word is cut into two segments, and a word near it holds the first at its
start or the second at its end. Segments are dealt to shards by their hash. A shard is an Aho-Corasick automaton of its
segments; the words scanned in it are those with a beginning or an end that may be one of them, of which there are four a word, since a near
word's halves have two lengths. What the automaton finds counts where it lies at the start or end, and where lengths differ by
one at most; then the two words are compared. A pair that shares both segments counts by its first.

Words with a common segment aren't all compared with each other, but by the rest of the word:
rests that differ by one edit are equal once a character at one place is gone from one or both. So each word gives its rest, and its rest without each of
its characters, and words are compared where these are equal. Of one segment and one such string there are at most so many words as there are letters
and places, however large the vocabulary. A pair is taken only at the string that its own edit gives. Where more than ``HOT`` words begin or end
with a segment, these strings are dealt to tasks of their own.

A word's form is its near word of largest count if that is at least ``TIMES`` its own. Counts rise along forms, so chains
end, after ``ROUNDS`` doublings of their steps at the latest.

Defined results: null and empty texts have no words; a null doc_id is written as nothing in the hash of an occurrence; repeated rows count
as often as they occur; of near words with equal counts the smallest in code-point order is the form; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, scope, stash

LETTERS, CODE_POINTS, OCCURRENCES, TIMES, EVERY = r"A-Za-zÀ-ÿ", 7, 2, 10, 31
#: Segments of a shard, about; words that have a segment, above which they meet by their rests; doublings that pass every chain of counts of 64 bits.
SHARD, HOT, ROUNDS = 1 << 14, 1000, 5
_FOUND = "word string, n_near long, best struct<less: long, form: string>"


def words_of_texts(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word, n: words of at least ``CODE_POINTS`` code points that occur at least ``OCCURRENCES`` times.

    In one of ``every`` occurrences, chosen by a hash of document and word, a character is lost, as if mistyped; 0: in none.
    """
    # A maximal run of too few characters has no match, so the matches are the maximal runs that are long enough.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{CODE_POINTS},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    found = found.select("doc", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    if every:
        found = found.select("word", F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary")).alias("h"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        found = found.select(F.when(F.col("h") % every == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))).otherwise(F.col("word")).alias("word"))
    return found.filter(F.char_length("word") >= CODE_POINTS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OCCURRENCES)


def edit(a: str, b: str) -> str | None:
    """What is left of both without the one character that differs, or None unless exactly one is inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return None
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    left = a[:i] + a[i + 1 :]
    return left if left == (b[:i] + b[i + 1 :] if len(a) == len(b) else b) else None


def _add(found: dict, word: str, near: str, n: int) -> None:
    count, less, form = found.get(word, (0, 0, ""))
    found[word] = (count + 1, *min((less, form), (-n, near))) if count else (1, -n, near)


def _batch(found: dict) -> pa.RecordBatch:
    best = pa.StructArray.from_arrays([pa.array([x[1] for x in found.values()], pa.int64()), pa.array([x[2] for x in found.values()], pa.string())], ["less", "form"])
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x[0] for x in found.values()], pa.int64()), best], ["word", "n_near", "best"])


def _left(rest: str) -> set[str]:
    """The rest of a word, and the rest without each of its characters."""
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


class Segment:
    """The words that have a segment, by what is left of their rests."""

    def __init__(self) -> None:
        self.words: list[tuple[str, int, str]] = []
        self.by_left: dict[str, list[tuple[str, int, str]]] = {}

    def near(self, rest: str) -> Iterator[tuple[str, int]]:
        """Words, with their counts, whose rests differ from this one by one edit."""
        if not self.by_left:
            for x in self.words:
                for left in _left(x[2]):
                    self.by_left.setdefault(left, []).append(x)
        for left in _left(rest):
            for word, n, other in self.by_left.get(left, ()):
                if edit(rest, other) == left:
                    yield word, n


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, probe, first, segment, word, n, in order -> ``_FOUND``: for each scanned word, its near words whose segments are in the shard."""
    import ahocorasick

    last, automaton, held, found = None, None, {}, {}
    for batch in batches:
        for shard, probe, first, segment, word, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if shard != last:
                last, automaton, held = shard, None, defaultdict(lambda: (Segment(), Segment()))
            if not probe:
                half = len(word) // 2
                held[segment][not first].words.append((word, n, word[half:] if first else word[:half]))
                continue
            if not held:
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for x, of in held.items():
                    automaton.add_word(x, (len(x), *of))
                automaton.make_automaton()
            # Rests whose lengths differ by more than one have nothing in common here, so lengths of words agree as well.
            for end, (size, begins, ends) in automaton.iter(word):
                if end + 1 == size and begins.words:
                    for other, m in begins.near(word[size:]):
                        _add(found, word, other, m)
                if end + 1 == len(word) and ends.words:
                    for other, m in ends.near(word[:-size]):
                        if not word.startswith(other[: len(other) // 2]):
                            _add(found, word, other, m)
        if found:
            yield _batch(found)
            found = {}


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """segment, first, rest, probe, word, n, in order -> ``_FOUND``: pairs of words that differ in what follows or precedes a segment."""
    last, held, found = None, [], {}
    for batch in batches:
        for segment, first, rest, probe, word, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (segment, first, rest) != last:
                last, held = (segment, first, rest), []
            if not probe:
                held.append((word, n))
                continue
            mine = word[len(segment) :] if first else word[: -len(segment)]
            for other, m in held:
                half = len(other) // 2
                if not first and word.startswith(other[:half]):
                    continue
                if edit(mine, other[half:] if first else other[:half]) == rest:
                    _add(found, word, other, m)
        if found:
            yield _batch(found)
            found = {}


def near_words(words: DataFrame) -> DataFrame:
    """word, n of distinct words -> word, n_near, best (less: minus its count, form) of words with near words."""
    length = F.char_length("word")
    half = F.floor(length / 2).cast("int")
    cut = lambda first, n: F.struct(F.lit(first).alias("first"), (F.substring("word", F.lit(1), n) if first else F.substring("word", length - n + 1, n)).alias("segment"))
    both = [cut(True, half), cut(False, length - half)]
    # Of a word with one character less or more, the first half has one of two lengths, and the second too.
    asked = [*(cut(True, F.floor((length + d) / 2).cast("int")) for d in (-1, 1)), *(cut(False, length + d - F.floor((length + d) / 2).cast("int")) for d in (-1, 1))]
    entries = words.select("word", "n", F.lit(False).alias("probe"), F.inline(F.array(*both)))
    probes = words.select("word", "n", F.lit(True).alias("probe"), F.inline(F.array(*asked)))
    every = entries.unionByName(probes)
    often = stash(probes.groupBy("segment", "first").count().filter(F.col("count") > HOT).select("segment", "first"), "hot")
    shards = max(-(-2 * words.count() // SHARD), 1)
    dealt = every.join(often, ["segment", "first"], "left_anti").withColumn("shard", F.pmod(F.xxhash64("segment", "first"), F.lit(shards)).cast("int"))
    # A word is scanned once in a shard, whatever brings it there.
    scanned = dealt.filter("probe").select("shard", "probe", F.lit(None).cast("boolean").alias("first"), F.lit(None).cast("string").alias("segment"), "word", "n").distinct()
    stream = dealt.filter("NOT probe").select("shard", "probe", "first", "segment", "word", "n").unionByName(scanned)
    found = stream.repartition("shard").sortWithinPartitions("shard", "probe").mapInArrow(_scanned, _FOUND)
    rest = F.when(F.col("first"), F.substring("word", F.char_length("segment") + 1, length)).otherwise(F.substring("word", F.lit(1), length - F.char_length("segment")))
    hot = every.join(often, ["segment", "first"]).withColumn("whole", rest)
    gone = F.transform(F.sequence(F.lit(1), F.char_length("whole")), lambda i: F.concat(F.substring("whole", F.lit(1), i - 1), F.substring("whole", i + 1, F.char_length("whole"))))
    gone = F.when(F.col("whole") == "", F.array(F.col("whole"))).otherwise(F.array_distinct(F.concat(F.array("whole"), gone)))
    hot = hot.select("segment", "first", F.explode(gone).alias("rest"), "probe", "word", "n")
    met = hot.repartition("segment", "first", "rest").sortWithinPartitions("segment", "first", "rest", "probe").mapInArrow(_met, _FOUND)
    return found.unionByName(met).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def group_variants(words: DataFrame) -> DataFrame:
    """word, n of distinct words -> word, form, root, n, n_near, form_n."""
    with scope(words.sparkSession):
        words = stash(words.select("word", F.col("n").cast("long").alias("n")), "words")
        near = words.join(near_words(words), "word", "left")
        count = -F.col("best.less")
        named = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(count >= TIMES * F.col("n"), F.struct(F.col("best.form").alias("form"), count.alias("form_n"))).alias("to"))
        named = stash(named.select("word", F.col("to.form").alias("form"), "n", "n_near", F.col("to.form_n").alias("form_n")), "forms")
        roots = named.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
        for _ in range(ROUNDS):
            on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
            roots = stash(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
            if not roots.filter("moved").limit(1).count():
                break
            roots = roots.select("word", "root")
        out = named.join(roots.select("word", "root"), "word", "left")
        return keep(stash(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(words_of_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b) ORDER BY b) AS of
  FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), kinds AS (
  SELECT doc, run, count(*) AS times, hex(encode(doc || ':' || run)) AS bytes FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_transform(range(length(bytes) // 2), lambda i: ('0x' || bytes[2 * i + 1 : 2 * i + 2])::BIGINT),
    lambda c, b: xor(c >> 8, bits.of[(xor(c, b) & 255) + 1]), 4294967295)) AS h
  FROM kinds, bits
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(times) >= 2
), cuts AS (
  SELECT word, n, place, left(word, place) || substr(word, place + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS place FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION ALL SELECT DISTINCT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION ALL SELECT DISTINCT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(less := -m, form := near)) AS best FROM pairs GROUP BY word
), named AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * w.n THEN best.form END AS form, CASE WHEN -best.less >= 10 * w.n THEN -best.less END AS form_n
  FROM words w LEFT JOIN best ON w.word = best.word
), steps AS (
  SELECT word, word AS seen, form AS next FROM named
  UNION ALL SELECT s.word, n.word, n.form FROM steps s JOIN named n ON n.word = s.next
)
SELECT n.word, n.form, s.seen AS root, n.n, n.n_near, n.form_n FROM named n JOIN steps s ON s.word = n.word AND s.next IS NULL
"""
