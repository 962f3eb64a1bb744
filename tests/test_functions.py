"""Text and geometry functions on small literal cases."""

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import align
from quire.operators.jobs import progress


def value(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, status",
    [
        (None, "absent"),
        ("  \n\t ", "absent"),
        ("short", "garbage"),
        ("A long enough line of plain text", "valid"),
        ("Достаточно длинная строка текста", "valid"),
        ("1234567890 1234567890 1234567890", "garbage"),
        ("text with a control \x01\x02\x03 here", "garbage"),
        ("text with a replacement \ufffd character", "garbage"),
        ("cлово wорд tекст мiх plain words", "garbage"),
    ],
)
def test_text_layer(spark, text, status):
    assert spark.createDataFrame([(text,)], "t string").select(X.text_layer(F.col("t")).alias("x")).first().x == status


@pytest.mark.parametrize("text, clean", [("soft\u00adhyphen", "softhyphen"), ("bro-\n  ken", "broken"), ("a \t  b", "a b"), ("  x \n", "x"), ("well-known", "well-known")])
def test_clean(spark, text, clean):
    assert value(spark, X.clean(F.col("t")), t=text) == clean


@pytest.mark.parametrize(
    "before, after, valid",
    [
        ("формата", "формату", False),
        ("допускается", "не допускается", False),
        ("допускается", "недопускается", False),
        ("неправильный", "правильный", False),
        ("2025", "2026", False),
        ("file_name.dat", "file.dat", False),
        ("МТУРЕ", "MTYPE", True),
        ("докумеит", "документ", True),
    ],
)
def test_valid_correction(spark, before, after, valid):
    assert value(spark, X.valid_correction(F.col("a"), F.col("b")), a=before, b=after) is valid


def test_similarity(spark):
    rows = spark.createDataFrame([("", "", 1.0), ("été", "ete", 1 / 3), ("abc", "abc", 1.0), ("abcd", "ab", 0.5)], "a string, b string, s double")
    for r in rows.select("s", X.similarity(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == pytest.approx(r.s)


def test_three_looks_differ(spark):
    assert value(spark, X.review_look(F.col("t")), t="Роит") == "poum"
    assert value(spark, X.short_value_look(F.col("t")), t=" Рот  Х") == "pot x"
    assert value(spark, X.word_look(F.col("t")), t="РОТ") == "pot"


@pytest.mark.parametrize("old, new, keeps, extends", [("a 1 = 2", "a 1 = 2 b", True, True), ("a 1 = 2", "a 2 = 1", False, False), ("x + y", "x y more", False, False), ("word", "word", True, False), ("one two", "one and two", True, True)])
def test_guards(spark, old, new, keeps, extends):
    assert value(spark, X.keeps_values(F.col("a"), F.col("b")), a=old, b=new) is keeps
    assert value(spark, X.extends(F.col("a"), F.col("b")), a=old, b=new) is extends


@pytest.mark.parametrize("old, new, accepted", [("", "new", True), ("old", " ", False), ("10 kg", "10 kg net", True), ("10 kg", "11 kg", False), ("name", "name__", False), ("a<b", "a b", False)])
def test_accepts_cell(spark, old, new, accepted):
    assert value(spark, X.accepts_cell(F.col("a"), F.col("b"), align.keeps_words(F.col("a"), F.col("b"))), a=old, b=new) is accepted


def test_path_choice(spark):
    c = X.choose_path(F.col("a"), F.col("b"))
    assert value(spark, c, a="с:\\пaпка", b="с:\\папка") == "с:\\папка"
    assert value(spark, c, a="с:\\LongName_пaпка", b="с:\\папка") == "с:\\LongName_пaпка"
    assert value(spark, c, a="plain", b="план") == "plain"


def test_chunks(spark):
    assert value(spark, X.chunks(F.col("t"), 8), t="aa bb cc dddddddddddd e  f") == ["aa bb ", "cc ", "dddddddddddd ", "e  f"]
    assert value(spark, X.chunks(F.col("t"), 8), t="") == []


def test_words_and_keys(spark):
    assert value(spark, X.words(F.col("t")), t="Ёлка, naïve_x ½ 2") == ["елка", "naïve_x", "½", "2"]
    assert value(spark, X.margin_key(F.col("t")), t="Page 12 — Straße: 7") == "page strasse"


@pytest.mark.parametrize("message, found", [("Unable to allocate 24.9 MiB", True), ("invalid input", False), (None, False)])
def test_memory_messages(spark, message, found):
    assert spark.createDataFrame([(message,)], "m string").select(X.is_memory_failure(F.col("m")).alias("x")).first().x is found


def test_progress(spark):
    assert value(spark, progress(F.lit(15), F.lit(15), F.lit("running"))) == 90
    assert value(spark, progress(F.lit(15), F.lit(15), F.lit("completed"))) == 100


def test_replace_all():
    assert align.replace_all("тест тестовый alpha beta", {"тест": "факт", "alpha": "beta", "beta": "gamma"}) == "факт тестовый beta gamma"


def test_alignment():
    assert align.keeps("a b c", "a x b c") and not align.keeps("a b c", "a c")
    assert align.merge("one two three", "one three") == "one two three"
    assert align.divide("a b c d".split(), [1, 1, 1, 1], [2, 2]) == ["a b", "c d"]
    assert align.divide(["a"], [1], [1, 1]) == ["a", ""]


def test_geometry(spark):
    box = lambda *x: G.box(*map(F.lit, x))
    assert value(spark, G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert value(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert value(spark, G.rotate(box(1, 2, 3, 4), F.lit(10), F.lit(20), F.lit(90))).asDict() == {"x0": 16, "y0": 1, "x1": 18, "y1": 3}
    assert value(spark, G.rotate(box(1, 2, 3, 4), F.lit(10), F.lit(20), F.lit(45))) is None
    assert value(spark, G.bounded_dpi(F.lit(595.0), F.lit(842.0), F.lit(300))) == 300
    assert value(spark, G.bounded_dpi(F.lit(0.0), F.lit(842.0), F.lit(300))) is None


def test_bounded_dpi_is_the_largest_that_fits(spark):
    import math
    import random

    rng = random.Random(1)
    rows = [(rng.uniform(1, 20000), rng.uniform(1, 20000), rng.randint(1, 1200)) for _ in range(300)]
    got = spark.createDataFrame(rows, "w double, h double, d int").select("w", "h", "d", G.bounded_dpi(F.col("w"), F.col("h"), F.col("d")).alias("x")).collect()
    for r in got:
        fits = [s for s in range(1, r.d + 1) if math.ceil(r.w * s / 72) * math.ceil(r.h * s / 72) <= 40_000_000 and max(math.ceil(r.w * s / 72), math.ceil(r.h * s / 72)) <= 12_000]
        assert r.x == (max(fits) if fits else None)


@pytest.mark.parametrize("a, b, same", [("caf\u00e9", "cafe\u0301", True), ("\u0439од", "и\u0306од", True), ("\u212b", "\u00c5", True), ("cafe\u0301", "cafe", False), ("Рот", "Pot", True), (" ", " ", False), ("e\u0301 e", "\u00e9e", False)])
def test_accents_written_apart_look_the_same(spark, a, b, same):
    assert value(spark, X.same_visible_line(F.col("a"), F.col("b")), a=a, b=b) is same
