"""Text functions as Spark columns; only ``composed`` leaves the built-in ones.

Words are runs of letters, digits and underscores of any script; white space is that of Unicode with the four
separators U+001C to U+001F. ``fold`` is full case folding for the letters that occur: lower case, and ss for sharp s.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import StringType

BLANK = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
INK = "[^" + BLANK[1:]
WORD = r"[\p{L}\p{N}_]"
CYRILLIC = r"[Ѐ-ԯ]"
LATIN = r"[A-Za-zÀ-ɏ]"
RUSSIAN = "[А-Яа-яЁё]"

# Letters that look alike, from Cyrillic to Latin. The three comparisons use different sets.
REVIEW_LETTERS = ("роуистаехкмвнп", "poyucmaexkmbhn")
SHORT_VALUE_LETTERS = ("авсенкмортху", "abcehkmoptxy")
WORD_LETTERS = ("АВЕКМНОРСТХУаекорсух", "ABEKMHOPCTXYaekopcyx")
CASE_ENDINGS = ("а", "у", "ы", "и", "е", "ом", "ой", "ам", "ами", "ов", "ах")
MEMORY_PHRASES = ("out of memory", "failed to allocate", "unable to allocate", "insufficient memory", "bad allocation", "bad_alloc")


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: The same characters, one by one.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def spaced(text: Column) -> Column:
    """Every blank as a space, which costs far less than to match all of them by a pattern."""
    return F.translate(text, BLANKS, " " * len(BLANKS))


def squeeze(text: Column) -> Column:
    """Words between blanks, joined by one space."""
    return F.btrim(F.regexp_replace(spaced(text), " +", " "), F.lit(" "))


def ink_count(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, ""))


def run_count(text: Column) -> Column:
    """Words between blanks."""
    one = squeeze(text)
    return F.when(one == "", 0).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1)


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1))


def count_chars(text: Column, kind: str) -> Column:
    """Characters of a class. What is left without them is measured, which is cheaper than to list them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def script_count(text: Column, scripts: Sequence[str] = ("cyrillic", "latin")) -> Column:
    """Characters of the scripts; none belongs to both."""
    parts = {"cyrillic": CYRILLIC, "latin": LATIN}
    return sum((count_chars(text, parts[s]) for s in scripts), F.lit(0))


def mixed_words(text: Column) -> Column:
    """Words with letters of both scripts; a text with one script is not cut into words."""
    words = F.split(squeeze(text), " ")
    both = text.rlike(CYRILLIC) & text.rlike(LATIN)
    return F.when(both, F.size(F.filter(words, lambda w: w.rlike(CYRILLIC) & w.rlike(LATIN)))).when(text.isNotNull(), 0)


def is_mixed_word(text: Column) -> Column:
    return text.rlike("[A-Za-z]") & text.rlike(RUSSIAN)


def text_layer(text: Column, least: int = 20, script: float = 0.35, control: float = 0.05, replacement: float = 0.01, mixed: float = 0.25, scripts: Sequence[str] = ("cyrillic", "latin")) -> Column:
    """absent, garbage or valid. Null counts as absent."""
    # What costs a pass over the text is asked for only where it can matter, and once.
    some = lambda t, kind: F.when(t.rlike(kind), count_chars(t, kind)).otherwise(0)
    parts = {"cyrillic": CYRILLIC, "latin": LATIN}

    def judged(t: Column, ink: Column) -> Column:
        length = F.length(t)
        scarce = ratio(sum((some(t, parts[s]) for s in scripts), F.lit(0)), ink) < script
        controls = ratio(some(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), length) > control
        marks = ratio(length - F.length(F.replace(t, F.lit("\ufffd"), F.lit(""))), length) > replacement
        # Without mixed words, how many words there are doesn't matter.
        mixes = bound(mixed_words(t), lambda n: F.when(n > 0, ratio(n, run_count(t)) > mixed).otherwise(mixed < 0))
        return F.when(ink == 0, "absent").when(F.length(strip(t)) < least, "garbage").when(scarce | controls | marks | mixes, "garbage").otherwise("valid")

    return bound(or_empty(text), lambda t: bound(ink_count(t), lambda ink: judged(t, ink)))


def clean(text: Column) -> Column:
    """Without soft hyphens and hyphenation at line ends; runs of spaces and tabs become one space."""
    out = F.replace(text, F.lit("­"), F.lit(""))
    out = F.regexp_replace(out, f"-{BLANK}*\\n{BLANK}*", "")
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(or_empty(text)), F.lit("ё"), F.lit("е")), F.lit(f"{WORD}+"), F.lit(0))


def first_word(text: Column) -> Column:
    """The first of ``words``, empty where there is none."""
    return F.regexp_extract(F.replace(F.lower(or_empty(text)), F.lit("ё"), F.lit("е")), f"{WORD}+", 0)


def folded_words(text: Column) -> Column:
    return F.regexp_extract_all(fold(or_empty(text)), F.lit(f"{WORD}+"), F.lit(0))


def word_key(text: Column) -> Column:
    return F.array_join(folded_words(text), "")


def ink_key(text: Column) -> Column:
    return F.translate(fold(or_empty(text)), BLANKS, "")


def margin_key(text: Column) -> Column:
    """What running headers share from page to page: words without digits."""
    out = F.regexp_replace(fold(or_empty(text)), r"[^\p{L}\p{N}_]+", " ")
    return squeeze(F.regexp_replace(out, r"\p{Nd}+", ""))


def look(text: Column, letters: tuple[str, str], folded: bool = True) -> Column:
    return F.translate(fold(text) if folded else text, *letters)


def review_look(text: Column) -> Column:
    return look(text, REVIEW_LETTERS)


def short_value_look(text: Column) -> Column:
    return squeeze(look(text, SHORT_VALUE_LETTERS))


def word_look(text: Column) -> Column:
    return fold(look(text, WORD_LETTERS, folded=False))


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def similar(a: Column, b: Column, least: float) -> Column:
    """Whether ``similarity`` is at least ``least``: equal texts aren't compared, and edits are counted only as far as they may go."""
    longest = F.greatest(F.length(a), F.length(b))
    # One edit more than may be, so that rounding decides nothing.
    edits = F.call_function("levenshtein", a, b, (F.floor(longest * (1 - least)) + 1).cast("int"))
    return F.when(a == b, True).otherwise((edits >= 0) & (1 - edits / longest >= least))


def numbers(text: Column, several: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)" + ("*" if several else "?")), F.lit(0))


def operators(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[<>≤≥±=]+"), F.lit(0))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once for the row even where use has it within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_subsequence(old: Column, new: Column) -> Column:
    """Whether the items of old occur in new in their order."""
    return bound(old, lambda o: F.aggregate(new, F.lit(0), lambda i, w: F.when(F.coalesce(F.get(o, i) == w, F.lit(False)), i + 1).otherwise(i)) == F.size(o))


def keeps_values(old: Column, new: Column) -> Column:
    """Numbers and signs of old survive in new, in order."""
    tokens = lambda x: F.regexp_extract_all(x, F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*|[<>≤≥±=+*/%()\[\]_-]"), F.lit(0))
    return is_subsequence(tokens(old), tokens(new))


def extends(old: Column, new: Column) -> Column:
    """All tokens of old, signs too, occur in new in order, and new has more."""
    tokens = lambda x: F.regexp_extract_all(fold(x), F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_\s]"), F.lit(0))
    return (F.size(tokens(old)) > 0) & (F.size(tokens(new)) > F.size(tokens(old))) & is_subsequence(tokens(old), tokens(new))


def extends_words(old: Column, new: Column) -> Column:
    a, b = folded_words(old), folded_words(new)
    return (F.size(a) > 0) & (F.size(b) > F.size(a)) & is_subsequence(a, b)


def same_words(a: Column, b: Column) -> Column:
    tokens = lambda x: F.regexp_extract_all(fold(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return tokens(a) == tokens(b)


def accepts_cell(old: Column, new: Column, keeps_words: Column) -> Column:
    """Whether a reread of a cell may replace it; keeps_words: no word of old is deleted, see operators.align."""
    trailing = same_words(old, new) & new.rlike(f"_+{BLANK}*$") & ~old.rlike(f"_+{BLANK}*$")
    near = (similarity(squeeze(fold(old)), squeeze(fold(new))) >= 0.7) & (F.length(new) >= F.length(old) * 0.9) & keeps_words
    safe = keeps_values(old, new) & ~trailing & is_subsequence(numbers(old), numbers(new)) & is_subsequence(operators(old), operators(new))
    return (strip(new) != "") & ((strip(old) == "") | (safe & (extends(old, new) | near)))


def choose_path(primary: Column, other: Column) -> Column:
    """A second reading of a path replaces the first if it is near, keeps its long names and has more Cyrillic letters."""
    names = F.regexp_extract_all(primary, F.lit("[A-Za-z_]{8,}"), F.lit(0))
    count = lambda x: F.regexp_count(x, F.lit(RUSSIAN))
    # The similarity, which takes by far the most time, is asked last.
    better = primary.contains("\\") & primary.rlike(RUSSIAN) & (count(other) > count(primary)) & F.forall(names, lambda n: other.contains(n)) & (similarity(fold(primary), fold(other)) >= 0.8)
    return F.when(better, other).otherwise(primary)


def confirms_short_value(text: Column, confidence: Column, other: Column, other_confidence: Column) -> Column:
    short = run_count(text).between(1, 3)
    return F.coalesce((confidence >= 0.55) & short & (other_confidence >= 0.45) & (short_value_look(text) == short_value_look(strip(other))), F.lit(False))


@arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """The text with letters and their accents as one character where there is one; no built-in function has normal forms."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def same_visible_line(a: Column, b: Column) -> Column:
    """Same look, whether accents are written as part of their letters or after them."""
    return (strip(a) != "") & (short_value_look(composed(a)) == short_value_look(composed(b)))


def takes_latin_reading(first: Column, second: Column, confidence: Column) -> Column:
    """Whether a sure Latin reading resolves a word of mixed scripts."""
    a, b = strip(first), strip(second)
    shape = b.rlike(r"^[A-Za-z0-9_./\\-]+[.,;:!?]?$") & (F.regexp_count(b, F.lit("[A-Za-z]")) >= 4)
    return is_mixed_word(first) & (confidence >= 0.98) & shape & (F.abs(F.length(a) - F.length(b)) <= 2) & (similarity(word_look(a), word_look(b)) >= 0.4)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal first characters."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).when(F.size(differ) == 0, n).otherwise(F.get(differ, F.lit(0)) - 1)


def valid_correction(before: Column, after: Column) -> Column:
    """Whether a proposed correction of a word repairs recognition and nothing else."""
    a, b = fold(before), fold(after)
    shape = before.rlike(rf"^[\p{{L}}\p{{N}}_.\-/\\]+$") & after.rlike(rf"^[\p{{L}}\p{{N}}_.-]+$")
    plain = ~before.rlike(r"\p{Nd}|[_/\\]") & ~after.rlike(r"\p{Nd}|[_/\\]") & (before.contains(".") | ~after.contains("."))
    negated = F.lit(False)
    for prefix in ("не", "без"):
        negated = negated | (a == F.concat(F.lit(prefix), b)) | (b == F.concat(F.lit(prefix), a))
    stem = common_prefix(a, b)
    ending = lambda x: F.substr(x, stem + 1).isin(*CASE_ENDINGS)
    declined = before.rlike(f"^{RUSSIAN}+$") & after.rlike(f"^{RUSSIAN}+$") & (stem >= 3) & ending(before) & ending(after)
    sizes = F.length(before).between(4, 64) & (F.length(after) <= 64) & (a != b)
    return sizes & shape & plain & ~negated & ~declined & (similarity(review_look(before), review_look(after)) >= 0.6)


def chunks(text: Column, limit: int) -> Column:
    """Greedy packing of words with the blanks after them; a word over the limit stands alone.

    A chunk goes from a word on as far as it may and a word begins or the text ends; where there is no such place, it is that word.
    """
    packed = f"{INK}(?s:.{{0,{limit - 1}}})(?:(?<={BLANK})(?={INK})|\\z)"
    return F.regexp_extract_all(text, F.lit(f"{packed}|{INK}+{BLANK}*"), F.lit(0))


def contents_entry(text: Column) -> Column:
    """Parts of a line of a table of contents: (title, page), or null."""
    return F.when(text.rlike(r"^(\d+(?:\.\d+)*\.\s+.+?)\s+(\d{1,4})$"), F.struct(F.regexp_extract(text, r"^(\d+(?:\.\d+)*\.\s+.+?)\s+(\d{1,4})$", 1).alias("title"), F.regexp_extract(text, r"^(\d+(?:\.\d+)*\.\s+.+?)\s+(\d{1,4})$", 2).alias("page")))


def list_display(kind: Column, text: Column) -> Column:
    """A list item without a mark of its own gets a bullet."""
    return F.when((kind == "list_item") & ~text.rlike(r"^\s*(?:[•●▪◦]|[-–—]\s|\d+[.)]\s)"), F.concat(F.lit("• "), text)).otherwise(text)


def is_memory_failure(message: Column) -> Column:
    return F.lower(or_empty(message)).rlike("|".join(MEMORY_PHRASES))
