"""Quality rules with adaptive thresholds, in DataFrame operations alone.

Each text gives counts (symbols, repeated lines, words in repeated windows, length of words). Their rates are whole multiples
of 2**-20 and go into bins that grow with the value, ``PARTS`` to each doubling, so there is no preset range. The counts of
documents by bin are the quantile sketch of a group: a quantile is off by a 32nd of its value at most, sketches of parts of
the data merge by adding counts, and the result is the same however the rows were dealt out.

There is one sketch for each language and source. Those of its language and of all documents are blended in, each with the
weight of ``BLEND`` documents, so small groups lean on them, large ones hardly do, and nothing jumps at any size. A rate
may pass the ninetieth percentile of its group by ``FENCE`` times the distance from the median to it (and word lengths may fall short
of the tenth likewise). A distance counts for at least one event in a document of the group's median length, since rates come in such
steps: where most texts have no symbol at all, a few symbols are no fault, and how few follows from the group's own lengths. An event is
a symbol, a repeated line, or for words in repeated windows those of two lines of median length. The limits are joined back to the
documents.

Defined results: null and blank texts have no words and fail the base rule; null languages and sources are groups
of their own; repeated rows count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, scope, stash, words_of

#: Rate -> (count, of, what one event adds to the count in terms of the medians of lengths, whether low values are judged too).
RATES = {
    "symbols": ("n_symbols", "n_words", "1L", False),
    "word_length": ("word_chars", "n_words", "1L", True),
    "lines": ("n_dup_lines", "n_lines", "1L", False),
    "repeats": ("n_repeat_words", "n_words", "2L * line_words_5", False),
}
#: Lengths whose medians say what one event amounts to.
LENGTHS = {"n_words": "n_words", "n_lines": "n_lines", "line_words": "n_words {div} greatest(n_lines, 1)"}
FENCE, BLEND, PARTS, SCALE = 4, 25, 32, 1 << 20
#: Weights are whole numbers of this part of a document, so sums don't depend on their order.
UNIT = 1 << 10
SYMBOLS = r"[#*$%&|<>]"
#: SQL for a hash of the window of array w that begins at i.
WINDOW_HASH = "xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))"


def _repeat_words(w: str, window_hash: str = WINDOW_HASH) -> str:
    """SQL for the words of array ``w`` that lie in a 3-word window found twice or more.

    A window becomes one long: the upper bits of its hash, then its position, so one sort of longs brings equal
    windows together. Each is compared with the one before, word by word. If all neighbours with equal bits are equal, so are
    all windows with these bits; if any are not, the text's windows are sorted by their words instead.
    """
    at = lambda x, k: f"get({w}, int({x} & z.m) + {k})"
    packed = f"sort_array(transform(sequence(0, size({w}) - 3), i -> shiftleft(shiftrightunsigned({window_hash.format(w=w)}, y.p), y.p) | bigint(i)))"
    # 0: another window than the one before, 1: the same, 2: only the bits agree.
    agrees = " AND ".join(f"{at('x', k)} = {at('get(z.s, j - 1)', k)}" for k in range(3))
    codes = f"transform(z.s, (x, j) -> if(j = 0 OR shiftrightunsigned(x ^ get(z.s, j - 1), z.p) <> 0, 0, if({agrees}, 1, 2)))"
    twice = "transform(filter(c.s, (x, j) -> get(c.c, j) = 1 OR coalesce(get(c.c, j + 1), 0) = 1), x -> x & c.m)"
    sorted_words = f"sort_array(transform(sequence(0, size({w}) - 3), i -> named_struct('a', get({w}, i), 'b', get({w}, i + 1), 'c', get({w}, i + 2), 'i', bigint(i))))"
    alike = lambda a, b: f"({a}.a = {b}.a AND {a}.b = {b}.b AND {a}.c = {b}.c)"
    by_words = f"flatten(transform(array({sorted_words}), g -> transform(filter(g, (x, j) -> coalesce({alike('x', 'get(g, j + 1)')}, false) OR if(j > 0, {alike('x', 'get(g, j - 1)')}, false)), x -> x.i)))"
    spread = "aggregate(transform(v, (x, j) -> least(3L, coalesce(get(v, j + 1) - x, 3L))), 0L, (a, b) -> a + b)"
    bits = f"transform(array(int(ceil(log2(size({w}) + 1)))), p -> named_struct('p', p))"
    steps = f"transform({bits}, y -> named_struct('p', y.p, 'm', shiftleft(1L, y.p) - 1, 's', {packed}))"
    steps = f"transform({steps}, z -> named_struct('s', z.s, 'm', z.m, 'c', {codes}))"
    steps = f"transform({steps}, c -> sort_array(if(array_contains(c.c, 2), {by_words}, {twice})))"
    return f"if(size({w}) < 4, 0L, transform({steps}, v -> {spread})[0])"


def measure(docs: DataFrame, window_hash: str = WINDOW_HASH) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(docs["text"], F.lit(""))
    read = docs.select("doc_id", "lang", "source", text.alias("text"))
    # A generator computes the array of words once, whatever refers to it.
    one = F.expr(f"inline(transform(array(words), w -> named_struct('n_words', bigint(size(w)), 'word_chars', bigint(length(array_join(w, ''))), 'n_repeat_words', {_repeat_words('w', window_hash)})))")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_symbols = F.regexp_count("text", F.lit(SYMBOLS)).cast("long")
    read = read.select("doc_id", "lang", "source", words_of(F.col("text")).alias("words"), n_symbols.alias("n_symbols"), F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))[0].alias("lines"))
    read = read.select("doc_id", "lang", "source", "n_symbols", "lines", one)
    return read.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), (F.col("lines.n") - F.col("lines.d")).alias("n_dup_lines"), "n_repeat_words")


def base_failed(least_words: int = 50, most_repeats: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def values() -> dict[str, Column]:
    """Each rate as a whole number of 2**-20, and the lengths; null where a text has nothing to count in."""
    rates = {k: F.when(F.col(of) > 0, F.expr(f"({n} * {SCALE}L) div {of}")) for k, (n, of, _, _) in RATES.items()}
    return rates | {k: F.expr(v.format(div="div")) for k, v in LENGTHS.items()}


def bin_of(value: Column) -> Column:
    """Values under PARTS have bins of their own; each doubling above has PARTS bins."""
    shift = F.greatest(F.length(F.bin(value)) - (PARTS.bit_length()), F.lit(0))
    return F.call_function("shiftright", value, shift) + shift * PARTS


def value_of(bin_: Column) -> Column:
    """The least value of a bin."""
    shift = F.greatest(F.floor(bin_ / PARTS) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", bin_ - shift * PARTS, shift)


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, rate, bin, n over the documents that pass the base rule. Adding n merges sketches."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("value")) for k, v in values().items()])
    rows = measured.filter(~base_failed()).select("lang", "source", F.inline(pairs)).filter("value IS NOT NULL")
    return rows.groupBy("lang", "source", "rate", bin_of(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))


def _packed(sketches: DataFrame, *by: str, documents: int | None = None) -> DataFrame:
    """One row a group and rate: its bins and their weights, or those of a group of so many documents."""
    rows = sketches.groupBy(*by, "rate").agg(F.collect_list(F.struct("bin", "n")).alias("pairs"), F.sum("n").alias("total"))
    weight = (lambda x: x["n"] * UNIT) if documents is None else (lambda x: F.expr(f"{documents * UNIT}L") * x["n"])
    scaled = F.transform("pairs", lambda x: F.struct(x["bin"].alias("bin"), weight(x).alias("w")))
    if documents is not None:
        scaled = F.expr(f"transform(pairs, x -> named_struct('bin', x.bin, 'w', ({documents * UNIT}L * x.n) div total))")
    return rows.select(*by, "rate", scaled.alias("bins"))


def quantiles(sketches: DataFrame) -> DataFrame:
    """lang, source, rate, q1, q5, q9: the tenths of each group with its language's and all documents' blended in."""
    langs = _packed(merge(sketches, "lang"), "lang", documents=BLEND).select(F.col("lang").alias("l_lang"), F.col("rate").alias("l_rate"), F.col("bins").alias("l_bins"))
    whole = _packed(merge(sketches), documents=BLEND).select(F.col("rate").alias("a_rate"), F.col("bins").alias("a_bins"))
    joined = _packed(sketches, "lang", "source").join(langs, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate"))).join(whole, F.col("rate") == F.col("a_rate"))
    blended = joined.select("lang", "source", "rate", F.array_sort(F.concat("bins", "l_bins", "a_bins")).alias("bins"))
    blended = blended.withColumn("total", F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x["w"]))
    # The first bin up to which there is a tenth, half, or nine tenths of the weight.
    reached = lambda s, x, t: F.when(s[f"q{t}"].isNull() & (10 * (s["upto"] + x["w"]) >= t * F.col("total")), x["bin"]).otherwise(s[f"q{t}"]).alias(f"q{t}")
    start = F.struct(F.lit(0).cast("long").alias("upto"), *[F.lit(None).cast("long").alias(f"q{t}") for t in (1, 5, 9)])
    found = F.aggregate("bins", start, lambda s, x: F.struct((s["upto"] + x["w"]).alias("upto"), *[reached(s, x, t) for t in (1, 5, 9)]))
    return blended.select("lang", "source", "rate", found.alias("q")).select("lang", "source", "rate", *[value_of(F.col(f"q.q{t}")).alias(f"q{t}") for t in (1, 5, 9)])


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source -> low_<rate>, high_<rate>: the limits of values."""
    q = lambda rate, t: F.max(F.when(F.col("rate") == rate, F.col(f"q{t}"))).alias(f"{rate}_{t}")
    wide = quantiles(sketches).groupBy("lang", "source").agg(*[q(k, t) for k in (*RATES, *LENGTHS) for t in (1, 5, 9)])
    out = []
    for k, (_, of, event, both) in RATES.items():
        grain = F.expr(f"{SCALE}L * {event} div greatest({of}_5, 1L)")
        out.append((F.col(f"{k}_9") + FENCE * F.greatest(F.col(f"{k}_9") - F.col(f"{k}_5"), grain)).alias(f"high_{k}"))
        out.append((F.col(f"{k}_1") - FENCE * F.greatest(F.col(f"{k}_5") - F.col(f"{k}_1"), grain) if both else F.lit(0).cast("long")).alias(f"low_{k}"))
    return wide.select("lang", "source", *out)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    limits = limits.withColumnRenamed("lang", "g_lang").withColumnRenamed("source", "g_source")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    fits = F.lit(True)
    found = values()
    for k in RATES:
        fits = fits & F.coalesce(found[k].between(F.col(f"low_{k}"), F.col(f"high_{k}")), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fits)


def quality_rules(docs: DataFrame) -> DataFrame:
    measured = stash(measure(docs), "measured")
    with scope(docs.sparkSession):
        limits = keep(stash(thresholds(stash(sketch(measured), "sketch")), "limits"))
    return judge(measured, limits)


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL_VALUES = {k: f"CASE WHEN {of} > 0 THEN {n} * {SCALE} // {of} END" for k, (n, of, _, _) in RATES.items()} | {k: v.format(div="//") for k, v in LENGTHS.items()}
_SQL_SHIFT = "greatest(length(bin({v})) - 6, 0)"
_SQL_VALUE = "((bin - {s} * 32) << {s})".format(s="greatest(bin // 32 - 1, 0)")
OP3_SQL = (
    r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)
), again AS (
  SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, gram) AS c FROM wins) WHERE c > 1
), cover AS (
  SELECT k, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY k
), lines AS (
  SELECT k, count(*)::BIGINT AS n_lines, count(DISTINCT line)::BIGINT AS n_different
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k
), m AS (
  SELECT t.k, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines - n_different, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN cover ON cover.k = t.k LEFT JOIN lines ON lines.k = t.k
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
"""
    + ",\n".join(f"         {v} AS v_{k}" for k, v in _SQL_VALUES.items())
    + "\n  FROM m\n), vals AS (\n"
    + "\n  UNION ALL ".join(f"SELECT coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source, '{k}' AS rate, v_{k} AS v FROM f WHERE NOT base_failed AND v_{k} IS NOT NULL" for k in _SQL_VALUES)
    + f"\n), sk AS (\n  SELECT lang, source, rate, (v >> {_SQL_SHIFT.format(v='v')}) + 32 * {_SQL_SHIFT.format(v='v')} AS bin, count(*) AS n FROM vals GROUP BY ALL\n), groups AS (\n  SELECT DISTINCT lang, source, rate FROM sk\n"
    + f"""), parts AS (
  SELECT lang, source, rate, bin, {UNIT} * n AS w FROM sk
  UNION ALL
  SELECT g.lang, g.source, g.rate, bin, w FROM groups g JOIN
    (SELECT lang, rate, bin, {BLEND * UNIT} * n // sum(n) OVER (PARTITION BY lang, rate)::BIGINT AS w FROM (SELECT lang, rate, bin, sum(n)::BIGINT AS n FROM sk GROUP BY ALL)) l ON l.lang = g.lang AND l.rate = g.rate
  UNION ALL
  SELECT g.lang, g.source, g.rate, bin, w FROM groups g JOIN
    (SELECT rate, bin, {BLEND * UNIT} * n // sum(n) OVER (PARTITION BY rate)::BIGINT AS w FROM (SELECT rate, bin, sum(n)::BIGINT AS n FROM sk GROUP BY ALL)) a ON a.rate = g.rate
), upto AS (
  SELECT lang, source, rate, bin, sum(w) OVER (PARTITION BY lang, source, rate ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY lang, source, rate) AS total
  FROM (SELECT lang, source, rate, bin, sum(w) AS w FROM parts GROUP BY ALL)
), q AS (
  SELECT lang, source, rate, min(CASE WHEN 10 * upto >= total THEN {_SQL_VALUE} END) AS q1, min(CASE WHEN 10 * upto >= 5 * total THEN {_SQL_VALUE} END) AS q5,
         min(CASE WHEN 10 * upto >= 9 * total THEN {_SQL_VALUE} END) AS q9
  FROM upto GROUP BY lang, source, rate
), lim AS (
  SELECT q.*, q9 + {FENCE} * greatest(q9 - q5, grain) AS high, CASE WHEN q.rate = 'word_length' THEN q1 - {FENCE} * greatest(q5 - q1, grain) ELSE 0 END AS low
  FROM (SELECT q.*, {SCALE} * CASE q.rate WHEN 'repeats' THEN 2 * r.q5 ELSE 1 END // greatest(l.q5, 1) AS grain
        FROM q JOIN q l ON l.lang = q.lang AND l.source = q.source AND l.rate = CASE q.rate WHEN 'lines' THEN 'n_lines' ELSE 'n_words' END
        JOIN q r ON r.lang = q.lang AND r.source = q.source AND r.rate = 'line_words') q
)
"""
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed"""
    + "".join(f"\n  AND NOT EXISTS (SELECT 1 FROM lim WHERE lim.lang = coalesce(f.lang, chr(1)) AND lim.source = coalesce(f.source, chr(1)) AND rate = '{k}' AND (v_{k} > high OR v_{k} < low))" for k in RATES)
    + " AS kept\nFROM f\n"
)
