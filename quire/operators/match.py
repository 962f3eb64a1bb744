"""Comparison of texts by their words, review units, and corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .align import replaced
from .sweep import over_groups


def word_counts(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, word, n."""
    return texts.select(*key, F.explode(X.words(F.col(text))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("n"))


def _both_counts(expected: DataFrame, found: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """key, word, w, g, w_at, g_at: counts of a word in the two texts, and where each has it first; a text without words has the null word."""
    at = F.struct(*order, "pos")
    side = lambda t, n: t.select(*key, *order, F.posexplode_outer(X.words(F.col("text"))).alias("pos", "word")).select(*key, "word", *[(F.lit(1) if i == n else F.lit(0)).alias(c) for i, c in enumerate("wg")], *[(at if i == n else F.lit(None)).alias(f"{c}_at") for i, c in enumerate("wg")])
    return side(expected, 0).unionByName(side(found, 1)).groupBy(*key, "word").agg(F.sum("w").alias("w"), F.sum("g").alias("g"), F.min("w_at").alias("w_at"), F.min("g_at").alias("g_at"))


def _shares(counted: DataFrame, key: list[str], *more: Column) -> DataFrame:
    n = lambda c: F.sum(F.when(F.col("word").isNotNull(), c).otherwise(0))
    sums = counted.groupBy(*key).agg(n(F.col("w")).alias("w"), n(F.col("g")).alias("g"), n(F.least("w", "g")).alias("m"), *more)
    return sums.select(*(c for c in sums.columns if c not in "wgm"), X.ratio(F.col("m"), F.col("g")).alias("precision"), X.ratio(F.col("m"), F.col("w")).alias("recall"))


def match_shares(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """key, precision, recall: the shares of the words of found that are expected, and of those expected that are found, with their counts."""
    return _shares(_both_counts(expected, found, key, []), key)


def text_match(expected: DataFrame, found: DataFrame, key: list[str], show: int = 50, order: list[str] | None = None, step: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> DataFrame:
    """key, precision, recall, missing, extra for pairs of texts with the same key; the first ``show`` words each.

    expected and found: key, text, and columns ``order`` if a text is in several rows. Words are compared with their counts; missing and extra are
    in the order in which their texts have them first, and repeated as often as they are missing. Both sides are counted in one grouping, so each word is
    shuffled once at most, and not at all where the texts are dealt by the key. The counts are read once; ``step`` may write them, see sources.scratch.
    """
    return _matched(step(_both_counts(expected, found, key, order or []), "counts"), key, show)


def column_match(texts: DataFrame, key: list[str], expected: str, found: str, show: int = 50, order: list[str] | None = None) -> DataFrame:
    """``text_match`` of two columns of the same rows: where these are dealt by the key, nothing is shuffled."""
    words = lambda c, n: F.transform(X.words(F.col(c)), lambda w, i: F.struct(w.alias("word"), *[F.lit(int(k == n)).cast("int").alias(x) for k, x in enumerate("wg")], i.alias("pos")))
    rows = texts.select(*key, *(order or []), F.explode_outer(F.concat(words(expected, 0), words(found, 1))).alias("_x"))
    at = F.struct(*(order or []), F.col("_x.pos").alias("pos"))
    rows = rows.select(*key, F.col("_x.word").alias("word"), *[F.col(f"_x.{c}").alias(c) for c in "wg"], *[F.when(F.col(f"_x.{c}") == 1, at).alias(f"{c}_at") for c in "wg"])
    return _matched(rows.groupBy(*key, "word").agg(F.sum("w").alias("w"), F.sum("g").alias("g"), F.min("w_at").alias("w_at"), F.min("g_at").alias("g_at")), key, show)


def _matched(counted: DataFrame, key: list[str], show: int) -> DataFrame:
    more = lambda x, y, lost: F.struct(F.lit(lost).alias("lost"), (F.col(x) - F.col(y)).alias("n"), F.col(f"{x}_at").alias("at"))
    d = F.when(F.col("w") > F.col("g"), more("w", "g", True)).when(F.col("w") < F.col("g"), more("g", "w", False))
    first = Window.partitionBy(*key, "lost").orderBy("at", "word")
    ranked = counted.withColumn("d", F.when(F.col("word").isNotNull(), d)).select(*key, "word", "w", "g", "d.*").withColumn("rank", F.row_number().over(first))
    shown = F.col("lost").isNotNull() & (F.col("rank") <= show)
    listed = lambda lost: F.sort_array(F.collect_list(F.when(shown & (F.col("lost") == lost), F.struct("rank", "word", "n"))))
    # Each word is there at least once, so the first words are enough.
    words = lambda c: F.coalesce(F.slice(F.flatten(F.transform(c, lambda w: F.array_repeat(w["word"], F.least(w["n"], F.lit(show)).cast("int")))), 1, show), F.array().cast("array<string>"))
    return _shares(ranked, key, listed(True).alias("missing"), listed(False).alias("extra")).select(*key, "precision", "recall", words("missing").alias("missing"), words("extra").alias("extra"))


#: Words that a pair must share among the rarest before it is counted, if so many must be shared at all; parts in which words are numbered.
OVERLAP, PARTS = 8, 1024


def match_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: float = 0.5, step: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> DataFrame:
    """left_id, right_id, matched, left_words, right_words of pairs in which right has at least ``least`` of left's words, with their counts.

    Of W words, a text that must have M lacks no more than W - M, so of any W - M + t words it has t (all M, if these are fewer). The rarest
    of right's words are taken, so pairs are made by words that few texts have; only pairs that share ``OVERLAP`` of these are counted
    in the rest. Right's texts are dealt once, by their id, so what a text shares with left is summed where it is; of their words, only
    those that left has are shuffled, as numbers.

    left's words are read several times and are expected to be few beside right's; ``step`` may write them, see sources.scratch.
    """
    left, right = left.filter(F.col(left_id).isNotNull()), right.filter(F.col(right_id).isNotNull()).select(right_id, "text")
    a = word_counts(left, [left_id]).withColumnRenamed("n", "a")
    part = Window.partitionBy("_part").orderBy("word")
    known = a.select("word").distinct().withColumn("_part", F.pmod(F.xxhash64("word"), F.lit(PARTS)))
    known = step(known.select("word", ((F.row_number().over(part) - 1) * PARTS + F.col("_part")).alias("_word")), "words")
    found = lambda texts, words: texts.select(right_id, F.explode(words).alias("word")).join(known, "word").drop("word")
    rare = found(right, F.array_distinct(X.words(F.col("text")))).groupBy("_word").agg(F.count("*").alias("texts"))
    of = Window.partitionBy(left_id)
    before = F.sum("a").over(of.orderBy(F.coalesce("texts", F.lit(0)), "_word").rowsBetween(Window.unboundedPreceding, -1))
    ranked = a.join(known, "word").join(rare, "_word", "left").withColumn("w", F.sum("a").over(of)).withColumn("before", F.coalesce(before, F.lit(0)))
    ranked = ranked.withColumn("must", F.ceil(F.col("w") * least))
    ranked = step(ranked.select(left_id, "_word", "a", "w", "must", (F.col("before") < F.col("w") - F.col("must") + OVERLAP).alias("probe")), "ranked")
    dealt = right.repartition(right_id)
    b = found(dealt, X.words(F.col("text"))).groupBy(right_id, "_word").agg(F.count("*").alias("b"))
    probes = ranked.filter("probe").select(left_id, "_word", "a", "w", "must")
    pairs = b.join(probes, "_word").groupBy(left_id, right_id).agg(F.sum(F.least("a", "b")).alias("first"), F.max("w").alias("w"), F.max("must").alias("must"))
    pairs = pairs.filter(F.col("first") >= F.least(F.lit(OVERLAP), "must"))
    rest = ranked.filter("NOT probe").select(left_id, "_word", "a")
    counted = pairs.join(rest, left_id, "left").join(b, [right_id, "_word"], "left").groupBy(left_id, right_id)
    # What only one of the two has is null here, and adds nothing.
    more = F.coalesce(F.sum(F.when(F.col("b").isNotNull(), F.least("a", "b"))), F.lit(0))
    out = counted.agg((F.max("first") + more).alias("matched"), F.max("w").alias(f"{left_id}_words"), F.max("must").alias("must")).filter("matched >= must").drop("must")
    sizes = dealt.select(right_id, F.size(X.words(F.col("text"))).alias("_size")).groupBy(right_id).agg(F.sum("_size").alias(f"{right_id}_words"))
    return out.join(sizes, right_id)


def multiset_difference(wanted: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """by, n: rows of wanted beyond those of found, with their counts."""
    a, b = wanted.groupBy(*by).agg(F.count("*").alias("a")), found.groupBy(*by).agg(F.count("*").alias("b"))
    return a.join(b, by, "left").select(*by, (F.col("a") - F.coalesce("b", F.lit(0))).alias("n")).filter("n > 0")


def units(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, unit_id, page, text: what a review sees, blocks with text and cells of tables.

    cells: doc_id, page_index, block_id, row, col, text.
    """
    prefix = F.concat(F.lit("p"), (F.col("page_index") + 1).cast("string"), F.lit(":"), F.col("block_id"))
    page = (F.col("page_index") + 1).alias("page")
    a = blocks.filter("type <> 'table' AND coalesce(text, '') <> ''").select("doc_id", prefix.alias("unit_id"), page, "text")
    b = cells.select("doc_id", F.concat(prefix, F.lit(":c"), F.col("row").cast("string"), F.lit(","), F.col("col").cast("string")).alias("unit_id"), page, "text")
    return a.unionByName(b)


def pack(texts: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """Adds batch: consecutive texts go into a batch until the next would pass ``limit`` characters.

    A sweep over each group in order, which holds the number and size of the open batch only.
    """
    sized = texts.select(*by, *order, F.length("text").alias("_n"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.select(*order).schema.fields)
    return texts.join(over_groups(sized, by, order, lambda: _packing(order, limit), f"{columns}, batch int"), [*by, *order])


def _packing(order: list[str], limit: int) -> Callable[[dict], tuple]:
    batch = size = 0

    def step(x: dict) -> tuple:
        nonlocal batch, size
        n = x["_n"] or 0
        if size > 0 and size + n > limit:
            batch, size = batch + 1, 0
        size += n
        return (*(x[c] for c in order), batch)

    return step


def host_corrections(texts: DataFrame, domains: DataFrame, key: list[str]) -> DataFrame:
    """key, before, after: names of hosts with Cyrillic letters that resemble one known domain.

    A token near just one domain (two characters more or less, similarity 0.8) becomes it. If it is near none, a prefix
    that ends before a capital letter may be a host that was joined to what follows; it must be the only such. Tokens and prefixes
    meet only domains of like length, prefixes only those with the same last label.
    """
    boundary = r"(?<![\p{L}\p{N}_.-])[\p{L}\p{N}_-]{2,}(?:\.[\p{L}\p{N}_-]{2,})+(?![\p{L}\p{N}_-]|\.[\p{L}\p{N}_-])"
    tokens = texts.select(*key, F.explode(F.regexp_extract_all(F.col("text"), F.lit(boundary), F.lit(0))).alias("token")).filter(F.col("token").rlike(X.RUSSIAN)).distinct()
    known = domains.select("domain", F.length("domain").alias("size"), F.element_at(F.split("domain", r"\."), -1).alias("label"), X.fold(F.col("domain")).alias("look")).distinct()
    # Each different token is judged once, whatever its texts.
    kinds = tokens.select("token").distinct()
    like = lambda n: F.explode(F.sequence(n - 2, n + 2)).alias("size")
    whole = kinds.select("token", X.review_look(F.col("token")).alias("seen"), like(F.length("token"))).join(known, "size").filter(X.similarity(F.col("seen"), F.col("look")) >= 0.8)
    near = whole.groupBy("token").agg(F.count("*").alias("n_near"), F.min("domain").alias("near"))
    n = F.length("token")
    capital = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda s: F.substring("token", s + 1, F.lit(1)).rlike(r"^\p{Lu}$"))
    cut = kinds.select("token", F.explode(capital).alias("s")).select("token", F.expr("substring(token, 1, s)").alias("before"), "s")
    cut = cut.withColumn("last", F.element_at(F.split("before", r"\."), -1)).filter("last <> ''").withColumn("seen", X.review_look(F.col("before")))
    # A prefix ends with a point and a last label, as it looks; it is up to two characters shorter or longer than the domain.
    prefixes = cut.select("token", "before", "seen", F.element_at(F.split("seen", r"\."), -1).alias("label"), like(F.col("s"))).filter(F.col("seen").contains("."))
    found = prefixes.join(known, ["size", "label"]).filter((F.col("before") != F.col("domain")) & (X.similarity(F.col("seen"), F.col("look")) >= 0.8))
    joined = found.groupBy("token").agg(F.count("*").alias("n_joined"), F.min(F.struct("before", "domain")).alias("joined"))
    judged = kinds.join(near, "token", "left").join(joined, "token", "left")
    one = F.when(F.col("n_near") == 1, F.struct(F.col("token").alias("before"), F.col("near").alias("after"))).when(F.col("n_near").isNull() & (F.col("n_joined") == 1), F.struct(F.col("joined.before").alias("before"), F.col("joined.domain").alias("after")))
    return tokens.join(judged.select("token", one.alias("c")).filter("c IS NOT NULL"), "token").select(*key, "c.before", "c.after")


def verified(corrections: DataFrame, texts: DataFrame, domains: list[str], sure: float = 0.97) -> DataFrame:
    """The proposed corrections (unit_id, before, after, confidence) that may be applied without asking.

    The text holds the word once and as a whole word, the change is one of recognition, and of several proposals for
    a word the first by ``n`` stands.
    """
    joined = corrections.filter(F.col("before") != F.col("after")).join(texts.select("unit_id", "text"), "unit_id")
    parts = F.size(F.split("text", F.concat(F.lit("\\Q"), "before", F.lit("\\E"))))
    bounded = F.expr(r"""text RLIKE concat('(?<![\\p{L}\\p{N}_./\\\\-])\\Q', before, '\\E(?![\\p{L}\\p{N}_/\\\\-])')""")
    good = joined.filter((F.col("confidence") >= sure) & (parts == 2) & bounded & X.valid_correction(F.col("before"), F.col("after")) & (~F.col("before").contains(".") | F.col("after").isin(*domains)))
    first = Window.partitionBy("unit_id", "before").orderBy("n")
    return good.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").select("unit_id", "before", "after", "confidence")


def apply_corrections(texts: DataFrame, corrections: DataFrame) -> DataFrame:
    """The texts with their corrections, all at once."""
    lists = corrections.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("before", "after"))).alias("edits"))
    joined = texts.join(lists, "unit_id", "left")
    before, after = F.col("edits.before"), F.col("edits.after")
    return joined.withColumn("text", F.when(F.col("edits").isNotNull(), replaced(F.col("text"), before, after)).otherwise(F.col("text"))).drop("edits")


def vote(readings: DataFrame, key: list[str], least: float = 0.85) -> DataFrame:
    """key, text, confidence: the reading that two or more attempts agree on, each sure enough; of several the surest."""
    agreed = readings.filter("text <> ''").groupBy(*key, "text").agg(F.count("*").alias("n"), F.min("confidence").alias("low"), F.avg("confidence").alias("confidence")).filter((F.col("n") >= 2) & (F.col("low") >= least))
    best = agreed.groupBy(*key).agg(F.max(F.struct("confidence", "text")).alias("b"))
    return best.select(*key, "b.text", "b.confidence")
