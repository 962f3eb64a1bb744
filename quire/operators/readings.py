"""What several readings of the same ink decide: lines, words, paths and cells read again by other readers or in other pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


# Confidences and similarities by which a reading is taken.
UNCERTAIN, LONGEST, BOTH, LETTERS, SURE, SOMEWHAT, NEAR = 0.85, 500, 0.65, 12, 0.92, 0.6, 0.9


def _plain(text: Column) -> Column:
    return X.squeeze(X.fold(text))


def uncertain_line(text: Column, confidence: Column, second: Column, second_score: Column, third: Column, third_score: Column) -> Column:
    """(text, confidence) of a line read with little confidence, if a second reader settles it; else null.

    Numbers must agree. A long line that both read alike stays, with its own confidence; a sure second reading takes its place if
    it is near, or if it is read so again from a cleaner picture (third).
    """
    other = X.strip(X.or_empty(second))
    asked = (confidence < UNCERTAIN) & (F.length(text) <= LONGEST) & (other != "") & (X.numbers(text) == X.numbers(other))
    letters = X.count_chars(text, r"\p{L}")
    agreed = (confidence >= BOTH) & (second_score >= BOTH) & (_plain(text) == _plain(other)) & (X.run_count(text) > 3) & (letters >= LETTERS)
    near = (confidence >= SOMEWHAT) & (X.similarity(_plain(text), _plain(other)) >= NEAR)
    again = F.coalesce((X.strip(third) == other) & (third_score >= SURE), F.lit(False))
    pair = lambda t, c: F.struct(t.alias("text"), c.cast("double").alias("confidence"))
    sure = F.coalesce(second_score >= SURE, F.lit(False))
    return F.when(asked & agreed, pair(text, confidence)).when(asked & sure & near, pair(other, second_score)).when(asked & sure & again, pair(other, F.least(second_score, third_score)))


def joined_words(words: Column, least: float = 0.9) -> Column:
    """(text, confidence) of a line read word by word: three to sixty words, all of them sure; else null. words: text, score."""
    good = F.forall(words, lambda w: F.coalesce((X.strip(w["text"]) != "") & (w["score"] >= least), F.lit(False)))
    text = F.array_join(F.transform(words, lambda w: X.strip(w["text"])), " ")
    mean = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["score"]) / F.size(words)
    return F.when(F.size(words).between(3, 60) & good, F.struct(text.alias("text"), mean.alias("confidence")))


def joined_path(parts: Column, least: float = 0.9, shortest: int = 8) -> Column:
    """(text, confidence) of a path read between its strokes: parts with text and score, null where there is no ink."""
    read = F.filter(parts, lambda p: p["text"].isNotNull())
    good = F.forall(read, lambda p: (X.strip(p["text"]) != "") & F.coalesce(p["score"] >= least, F.lit(False)))
    text = F.array_join(F.transform(parts, lambda p: X.strip(X.or_empty(p["text"]))), "\\")
    lowest = F.array_min(F.transform(read, lambda p: p["score"]))
    return F.when((F.size(parts) >= 3) & (F.size(read) > 0) & good & (F.length(text) >= shortest), F.struct(text.alias("text"), lowest.alias("confidence")))


def refined_words(text: Column, readings: Column, sure: float = 0.98) -> Column:
    """The text with its words of mixed scripts as they were read alone, where that is sure and alike.

    readings: (text, score) of each piece of ink. Where their number differs from that of the words, only the first pair is sure to
    belong together.
    """
    words = F.split(X.squeeze(text), " ")

    def word(w: Column, i: Column) -> Column:
        piece = F.get(readings, i)
        alone = X.strip(piece["text"])
        fits = X.is_mixed_word(w) & (piece["score"] >= sure) & (alone != "") & ~alone.contains(" ") & (F.abs(F.length(alone) - F.length(w)) <= 2) & (X.similarity(X.fold(w), X.fold(alone)) >= 0.2)
        placed = (F.size(readings) == F.size(words)) | (i == 0)
        return F.when(F.coalesce(fits & placed, F.lit(False)), alone).otherwise(w)

    return F.when(F.exists(words, X.is_mixed_word) & (F.size(readings) > 0), F.array_join(F.transform(words, word), " ")).otherwise(text)


def confirmed(lines: DataFrame, key: list[str], sure: float = 0.9, alike: float = 0.95) -> DataFrame:
    """key, confirmed: whether a second reader (second, score) reads every line (text) of a block nearly alike."""
    same = F.coalesce((F.col("score") >= sure) & (X.similarity(_plain(F.col("text")), _plain(X.or_empty(F.col("second")))) >= alike), F.lit(False))
    return lines.groupBy(*key).agg(F.bool_and(same).alias("confirmed"))


def cell_text(found: DataFrame, key: list[str], least: float = 0.9) -> DataFrame:
    """key, text: what was detected in the crop of a cell, from the top and the left.

    found: key, x0, y0, x1, y1 within the crop, width and height of the crop, text, score. What is unsure, blank or sticks out is left out.
    """
    inside = (F.col("x0") >= -1) & (F.col("y0") >= -1) & (F.col("x1") <= F.col("width") + 1) & (F.col("y1") <= F.col("height") + 1)
    good = F.when(inside & (F.col("score") >= least) & (X.strip(F.col("text")) != ""), F.struct("y0", "x0", X.strip(F.col("text")).alias("text")))
    return found.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(good)), lambda x: x["text"]), " ").alias("text"))


def rereading_budget(cells: DataFrame, page: list[str], order: list[str], detections: int = 20, alternates: int = 80) -> DataFrame:
    """Adds detect and alternate: whether a cell of a page (empty, uncertain) may be detected anew, or read by another reader."""
    rank = lambda c: F.sum(F.col(c).cast("int")).over(Window.partitionBy(*page).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("detect", F.col("empty") & (rank("empty") <= detections)).withColumn("alternate", F.col("uncertain") & (rank("uncertain") <= alternates))
