"""Files are packed, fitted and read with no more passes than they need."""

import random

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.sinks import pdf
from quire.sources import pdf as pdf_source


def _word_by_word(text, room, size):
    out, space = [], pdf.width(" ", size)
    for line in text.split("\n"):
        held, used, ink = [], 0.0, False
        for w in line.split(" "):
            more = pdf.width(w, size)
            if ink and used + space + more > room:
                out.append(" ".join(held))
                held, used, ink = [w], more, w != ""
            else:
                used, ink = used + more + (space if held else 0.0), ink or w != ""
                held.append(w)
        out.append(" ".join(held))
    return out


def _fitted_by_trial(text, room, height, size):
    while size > pdf.LEAST:
        lines = _word_by_word(text, room, size)
        if len(lines) * size * pdf.LEADING <= height + 2 and max(pdf.width(x, size) for x in lines) <= room + 2:
            return lines, size
        size -= 0.5
    return _word_by_word(text, room, pdf.LEAST), pdf.LEAST


def test_texts_fit_as_if_packed_word_by_word():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "w", "i", "x" * 40, " ", " ", "  ", "\n", "ß"]) for _ in range(rng.randrange(60)))
        room, size = rng.choice([1.0, 20.0, 59.4, 108.0, 220.0, rng.random() * 200]), rng.choice([4.0, 9.0, 11.0, 12.0])
        assert pdf.wrapped(text, room, size) == _word_by_word(text, room, size)
        height = rng.choice([1.0, 12.0, 40.0, 200.0])
        assert pdf.fitted(text, room, height, size) == _fitted_by_trial(text, room, height, size)


def test_sizes_at_which_all_words_are_too_wide_are_not_packed(monkeypatch):
    sizes, packed = [], pdf._packed
    monkeypatch.setattr(pdf, "_packed", lambda m, room, size: sizes.append(size) or packed(m, room, size))
    pdf.fitted("word " * 500, 450.0, 12.0, 11.0)
    assert sizes == [pdf.LEAST]


def test_codes_of_two_bytes_are_looked_up_together():
    font = pdf_source._codes(b"beginbfchar <0041> <0042> <d835> <d835> <dcb3> <dcb3> endbfchar beginbfrange <0100> <0102> <0061> endbfrange")
    assert pdf_source._decoded(bytes.fromhex("00410100010201030041"), font) == "Bac�B"
    assert pdf_source._decoded(bytes.fromhex("d835dcb30041"), font).encode("utf-16-be", "surrogatepass").hex() == "d835dcb30042"
    assert pdf_source._decoded(b"\x00A\x00", font) == "B�" and font.letters


def test_words_of_a_text_layer_are_not_counted_without_mixed_ones(spark):
    texts = ["", "  ", "short", "plain words of a text layer " * 3, "обычный текст на странице " * 3, "сlоsе ореn wоrds оf two sсriрts", "one сlоsе word among many other plain ones here", "\x01\x02\x03 with controls all over here", "bad � marks � in this text here", "12345 67890 12345 67890 12345", None]
    status = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(X.text_layer(F.col("text"))).collect()]
    assert status == ["absent", "absent", "garbage", "valid", "valid", "garbage", "valid", "garbage", "garbage", "garbage", "absent"]
