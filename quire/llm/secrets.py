"""Secret scans: fixed patterns, and a battery of randomness tests for what no pattern names.

A candidate is a maximal run of 20 or more characters of one of the usual text encodings, so NAME=VALUE, path_a/key and
the like give their parts; runs of several encodings at one place are one candidate. "=" is of no encoding, but ends
one as padding. Its encoding is inferred as the smallest alphabet that holds it.

The battery asks whether the candidate is an even draw from that alphabet: chi-squared for uniformity (too uneven or too
even), runs above and below the middle of the alphabet, and serial correlation of neighbours, combined by Simes' rule.
The null hypothesis of the scan is the opposite, that the candidate is written: characters stay within one class (small, capital,
digit, mark) from one to the next with probability ``STAY``, letters have the frequencies of written language, and digits
tend to repeat or count on. The ratio of a candidate's probability as an even draw, from an encoding that is any of them with equal
probability, to its probability as written has a mean of at most 1 over what is written. It is multiplied by the battery's combined p-value, a factor of at most 1, so the mean stays
at most 1 and the inverse of the product is a valid p-value: each test takes from a candidate exactly as many decades as it speaks
against an even draw, without a fixed cut. Over all candidates of the corpus these p-values are held to a false discovery rate of
``RATE`` by the step-up rule, with weights by length (mean 1), since long secrets are likelier real. The rule needs only a
histogram of p-values, which is summed over all documents.

Defined results: a null text is empty; empty texts have no spans; candidates within a span of a pattern add nothing;
repeated rows are each scanned and counted; an empty table gives an empty table; further columns are ignored (redact:
kept). Positions are code points.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import scope, stash

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind -> (pattern, group that is measured, its least length).
PATTERNS = {"assign": (re.compile(ASSIGN, re.ASCII | re.IGNORECASE), 2, 6), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]{24,}"), 0, 24)}
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_PADDING = re.compile(r"={1,2}(?![A-Za-z0-9+/_=-])")
#: What a text must match to be looked at, for a scanner that takes linear time.
SIEVES = {"assign": "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]", "access": "AKIA[A-Z0-9]", "hex": "[0-9a-f]{24}", "random": CANDIDATE.pattern.replace("{20,}", "{20}")}
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet to the largest.
ALPHABETS = {"decimal": _DIGITS, "hex": _DIGITS + "abcdef", "hex capitals": _DIGITS + "ABCDEF", "small": _LOW, "capitals": _UP, "base32": _UP + "234567", "base36": _DIGITS + _LOW, "base62": _UP + _LOW + _DIGITS, "base64": _UP + _LOW + _DIGITS + "+/", "base64url": _UP + _LOW + _DIGITS + "-_"}
_SETS = [(k, frozenset(v), {c: i for i, c in enumerate(v)}) for k, v in ALPHABETS.items()]
#: Maximal runs of each encoding; every one lies in a run of CANDIDATE.
_RUNS = [re.compile(f"[{re.escape(v)}]{{{LEAST},}}") for v in ALPHABETS.values()]
STAY, RATE = 0.9, 0.001
#: Histogram of -10 log10 p: its last bin, p of 1e-100, holds all above. Weights grow with length up to LONGEST.
LAST_BIN, LONGEST = 1000, 64


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(places: list[int], letters: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for places in an alphabet of so many letters."""
    n = len(places)
    expected, df = n / letters, letters - 1
    chi = sum(c * c for c in Counter(places).values()) / expected - n
    # The cube root of chi-squared over its degrees of freedom is near normal.
    uniform = 2 * _tail(abs((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [2 * x >= letters for x in places]
    a = sum(high)
    b = n - a
    runs = 1 + sum(map(operator.ne, high, high[1:]))
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs_p = 2.0 ** (1 - n)
    total = sum(places)
    spread = sum(map(operator.mul, places, places)) - total * total / n
    if spread > 0:
        # The sum over neighbours of the products of their distances from the mean.
        near = sum(map(operator.mul, places, places[1:])) - total / n * (2 * total - places[0] - places[-1]) + (n - 1) * (total / n) ** 2
        serial = 2 * _tail(abs(near / spread + 1 / n) * math.sqrt(n))
    else:
        serial = 0.0
    return uniform, min(runs_p, 1.0), min(serial, 1.0)


def combined(p_values: tuple[float, ...]) -> float:
    """Simes' p-value for the hypothesis that all the tests' hypotheses hold."""
    ordered = sorted(p_values)
    return min(1.0, *(p * len(ordered) / (i + 1) for i, p in enumerate(ordered)))


#: Rough shares of the letters a to z in written English, German, French and Spanish taken together.
_LETTERS = (850, 150, 320, 450, 1480, 135, 180, 320, 720, 35, 65, 440, 260, 810, 590, 220, 50, 660, 740, 730, 420, 120, 110, 25, 80, 40)
#: Shares of steps from a digit to the next (modulo 10) in written numbers: repeated, counting on, counting back, any other.
_STEPS = (0.25, 0.25, 0.1)
_CLASSES = str.maketrans({**dict.fromkeys(_LOW, "a"), **dict.fromkeys(_UP, "A"), **dict.fromkeys(_DIGITS, "0"), **dict.fromkeys("+/-_", "+")})
#: Log of a character's share in its class; a digit's after a character that is none.
_WITHIN = {c: math.log(_LETTERS[i % 26] / sum(_LETTERS)) for i, c in enumerate(_LOW + _UP)} | dict.fromkeys(_DIGITS, math.log(1 / 10)) | dict.fromkeys("+/-_", math.log(1 / 4))
_AFTER = {f"{i}{(i + d) % 10}": math.log({0: _STEPS[0], 1: _STEPS[1], 9: _STEPS[2]}.get(d, (1 - sum(_STEPS)) / 7) * 10) for i in range(10) for d in range(10)}


def evidence(token: str, letters: int) -> float:
    """log10 of the probability of token as written over that as an even draw from so many letters, of any encoding."""
    classes = token.translate(_CLASSES)
    text = math.log(1 / 4) + sum(map(_WITHIN.__getitem__, token))
    stays = sum(map(operator.eq, classes, classes[1:]))
    text += stays * math.log(STAY) + (len(token) - 1 - stays) * math.log((1 - STAY) / 3)
    if "00" in classes:
        text += sum(_AFTER.get(x + y, 0.0) for x, y in zip(token, token[1:]))
    return (text + len(token) * math.log(letters)) / math.log(10) + math.log10(len(ALPHABETS))


def examine(token: str) -> tuple[str, float]:
    """Encoding, and log10 of the p-value against written text; 0 at most."""
    body = token.rstrip("=")
    chars = set(body)
    for name, alphabet, place in _SETS:
        if body and chars <= alphabet:
            log_p = evidence(body, len(place))
            if log_p < 0:
                log_p -= math.log10(max(combined(battery([place[c] for c in body], len(place))), 1e-300))
            return name, min(log_p, 0.0)
    return "other", 0.0


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Spans of the patterns as (start, kind, end), and candidates outside them as (start, end, log10 p)."""
    base = []
    for kind, (pattern, group, least) in enumerate(PATTERNS.values()):
        base += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    base.sort()
    found, at_base, covered = [], 0, 0
    for run in CANDIDATE.finditer(text):
        for at, end in sorted({m.span() for each in _RUNS for m in each.finditer(text, *run.span())}):
            # Both lists are in order of their starts: covered is the farthest end of the spans that start here or before.
            while at_base < len(base) and base[at_base][0] <= at:
                covered = max(covered, base[at_base][2])
                at_base += 1
            if end <= covered:
                continue
            padding = _PADDING.match(text, end)
            found.append((at, padding.end() if padding else end, examine(text[at:end])[1]))
    return base, found


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,log_p:double>>"


def _scan_all(texts: pa.Array) -> tuple[list, list]:
    look = None
    for sieve in SIEVES.values():
        hit = pc.fill_null(pc.match_substring_regex(texts, sieve), False)
        look = hit if look is None else pc.or_(look, hit)
    both = [scan(t.as_py()) if x.as_py() else ([], []) for t, x in zip(texts, look)]
    return [[dict(zip(("start", "kind", "end"), y)) for y in x] for x, _ in both], [[dict(zip(("start", "end", "log_p"), y)) for y in x] for _, x in both]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base, found of every document."""
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, found = _scan_all(b.column(1))
            span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("log_p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(found, cand)], ["doc_id", "base", "found"])

    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, base {_SPAN}, found {_FOUND}")


def _bin(start, end, log_p, mean: float):
    """Column: -10 log10 of the p-value over its weight, as a whole number from 0 to LAST_BIN."""
    weight = F.least(end - start, F.lit(LONGEST)) / F.lit(mean)
    return F.least(F.greatest(F.floor(-10 * (log_p - F.log10(weight))), F.lit(0)), F.lit(LAST_BIN))


def threshold(found: DataFrame, rate: float = RATE) -> tuple[float, float]:
    """(mean weight, least bin) of the step-up rule over all candidates in column found."""
    each = found.select(F.explode("found").alias("x")).select("x.*")
    total = each.agg(F.count("*").alias("n"), F.sum(F.least(F.col("end") - F.col("start"), F.lit(LONGEST))).alias("length")).first()
    if not total["n"]:
        return 1.0, math.inf
    mean = total["length"] / total["n"]
    # At most LAST_BIN + 1 rows come to the driver, whatever the corpus.
    bins = each.groupBy(_bin(F.col("start"), F.col("end"), F.col("log_p"), mean).alias("bin")).count().collect()
    held, best = 0, math.inf
    for b, n in sorted(((r["bin"], r["count"]) for r in bins), reverse=True):
        held += n
        if 10 ** (-b / 10) <= rate * held / total["n"]:
            best = b
    return mean, best


def discovered(start: int, end: int, log_p: float, mean: float, least: float) -> bool:
    return min(max(math.floor(-10 * (log_p - math.log10(min(end - start, LONGEST) / mean))), 0), LAST_BIN) >= least


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base, spans of every document; spans are base and the discoveries, by start, kind and end."""
    rows = stash(scanned(docs), "scanned")
    mean, least = threshold(rows, rate)
    better = lambda x: _bin(x["start"], x["end"], x["log_p"], mean) >= F.lit(least)
    more = F.transform(F.filter("found", better), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def redact(docs: DataFrame, rate: float = RATE, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with every span of a secret in text replaced by mark; n_chars follows where it is there."""
    with scope(docs.sparkSession):
        mean, least = threshold(stash(scanned(docs).select("found"), "scanned"), rate)

    @arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t, base, found in zip(texts, *_scan_all(texts)):
            text = t.as_py()
            spans = sorted([(x["start"], x["end"]) for x in base] + [(x["start"], x["end"]) for x in found if discovered(x["start"], x["end"], x["log_p"], mean, least)])
            parts, at = [], 0
            for s, e in spans:
                if s >= at:
                    parts += [text[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, text[at:]]) if spans else text)
        return pa.array(out, pa.string())

    columns = [clean(docs["text"].cast("string")).alias("text") if c == "text" else docs[c] for c in docs.columns]
    out = docs.select(*columns)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _written(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) AS bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
