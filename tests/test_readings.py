"""Second readings, and bundles of files."""

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import readings as R
from quire.sinks import bundles, render
from tests.test_operators import block, frame

LONG = "a line of several words that both readers see"


@pytest.mark.parametrize(
    "text, confidence, second, score, third, third_score, want",
    [
        (LONG, 0.7, LONG.upper(), 0.7, None, None, (LONG, 0.7)),
        (LONG, 0.9, LONG, 0.99, None, None, None),
        (LONG, 0.7, LONG[:-1] + "x", 0.95, None, None, (LONG[:-1] + "x", 0.95)),
        (LONG, 0.5, "quite another line", 0.95, "quite another line", 0.93, ("quite another line", 0.93)),
        (LONG, 0.5, "quite another line", 0.95, "something else", 0.99, None),
        ("total 12,5", 0.7, "total 12,6", 0.99, "total 12,6", 0.99, None),
        (LONG, 0.7, None, None, None, None, None),
        ("x" * 501, 0.7, "x" * 501, 0.99, None, None, None),
    ],
)
def test_uncertain_lines(spark, text, confidence, second, score, third, third_score, want):
    row = spark.createDataFrame([(text, confidence, second, score, third, third_score)], "a string, b double, c string, d double, e string, f double")
    x = row.select(R.uncertain_line(*map(F.col, "abcdef")).alias("x")).first().x
    assert (tuple(x) if x else None) == want


def test_words_and_paths(spark):
    pieces = lambda *x: [(t, s) for t, s in x]
    rows = [(pieces(("one", 0.95), (" two ", 0.9), ("three", 1.0)),), (pieces(("one", 0.95), ("two", 0.9)),), (pieces(("one", 0.95), ("two", 0.5), ("x", 1.0)),), (pieces((None, None), ("folder", 0.95), ("file", 0.9)),)]
    got = spark.createDataFrame(rows, "p array<struct<text:string,score:double>>").select(R.joined_words(F.col("p")).alias("w"), R.joined_path(F.col("p")).alias("p")).collect()
    assert got[0].w.text == "one two three" and abs(got[0].w.confidence - 0.95) < 1e-9 and [r.w for r in got[1:]] == [None] * 3
    assert tuple(got[0].p) == ("one\\two\\three", 0.9) and got[1].p is None and got[2].p is None and tuple(got[3].p) == ("\\folder\\file", 0.9)


def test_mixed_words_take_sure_readings(spark):
    piece = "p array<struct<text:string,score:double>>"
    case = lambda text, p: spark.createDataFrame([(text, p)], f"t string, {piece}").select(R.refined_words(F.col("t"), F.col("p")).alias("x")).first().x
    assert case("сервер mаil работает", [("сервер", 1.0), ("mail", 0.99), ("работает", 1.0)]) == "сервер mail работает"
    assert case("сервер mаil работает", [("сервер", 1.0), ("mail", 0.9), ("работает", 1.0)]) == "сервер mаil работает"
    assert case("сервер mаil", [("сервер", 1.0)]) == "сервер mаil" and case("mаil сервер", [("mail", 0.99)]) == "mail сервер"
    assert case("no mixed words", [("x", 1.0)]) == "no mixed words"


def test_cells_and_blocks(spark):
    found = spark.createDataFrame([(1, 50.0, 0.0, 90.0, 9.0, 100.0, 20.0, "b", 0.95), (1, 0.0, 0.0, 40.0, 9.0, 100.0, 20.0, "a", 0.95), (1, 0.0, 10.0, 40.0, 19.0, 100.0, 20.0, "c", 0.95), (1, 0.0, 10.0, 140.0, 19.0, 100.0, 20.0, "out", 0.95), (2, 0.0, 0.0, 9.0, 9.0, 100.0, 20.0, "unsure", 0.5)], "k long, x0 double, y0 double, x1 double, y1 double, width double, height double, text string, score double")
    assert {r.k: r.text for r in R.cell_text(found, ["k"]).collect()} == {1: "a b c", 2: ""}
    lines = spark.createDataFrame([(1, LONG, LONG.upper(), 0.95), (1, LONG, LONG, 0.99), (2, LONG, None, 0.99), (3, LONG, LONG, 0.8)], "k long, text string, second string, score double")
    assert {r.k: r.confirmed for r in R.confirmed(lines, ["k"]).collect()} == {1: True, 2: False, 3: False}


def test_bundles(spark):
    b = frame(spark, block("a", (50, 50, 300, 70), "Some text", ord=0))
    pages = spark.createDataFrame([(1, 0, "ok", 595.0, 842.0, 72)], "doc_id long, page_index int, status string, width_pt double, height_pt double, dpi int")
    sources = spark.createDataFrame([(1, "f.pdf", "0", "pdf")], "doc_id long, file string, sha256 string, kind string")
    models = render.stored(b, pages, sources, "e")
    files = {r.name: bytes(r.content) for r in bundles.bundle(models, render.markdown(b, L.attach_captions(b)), render.html(b, 595.0, 842.0), ("docx", "pdf_searchable"), docx=True).collect()}
    assert set(files) == {*bundles.ALWAYS, "document-searchable.pdf", "document.docx"}
    assert json.loads(files["output-policy.json"]) == {"outputs": ["docx", "pdf_searchable"], "docx": True} and files["document-flow.pdf"].startswith(b"%PDF")
    assert len(set(bundles.bundle(models, render.markdown(b, L.attach_captions(b)), render.html(b, 595.0, 842.0), ("docx",)).toPandas()["name"])) == 6


def test_reports(spark):
    checks = spark.createDataFrame([(1, "b", "WARN", "x"), (1, "a", "PASS", "y"), (2, "a", "FAIL", "z")], "doc_id long, check string, status string, detail string")
    got = {r.doc_id: json.loads(r.content) for r in bundles.verification_reports(checks).collect()}
    assert got[1] == {"ok": True, "result": "WARN", "checks": [{"check": "a", "status": "PASS", "detail": "y"}, {"check": "b", "status": "WARN", "detail": "x"}]} and not got[2]["ok"]
    metrics = spark.createDataFrame([(1, 3)], "doc_id long, pages long")
    results = spark.createDataFrame([(1, "WARN")], "doc_id long, result string")
    assert json.loads(bundles.metrics_reports(metrics, results).first().content) == {"pages": 3, "verification": "WARN"}


def test_images_in_pages(spark):
    b = frame(spark, block("f", (50, 50, 300, 70), kind="figure", file="images/f.png"), block("g", (50, 90, 300, 99), kind="figure", file="images/g.jpg", ord=1))
    images = spark.createDataFrame([(1, "images/f.png", b"abc")], "doc_id long, file string, content binary")
    html = render.html(b, 595.0, 842.0, images).first().html
    assert '<img src="data:image/png;base64,YWJj"' in html and '<img src="images/g.jpg"' in html


def test_assembled_pages(spark):
    from quire.operators import page

    rows, lines = [], []
    for p in range(4):
        rows += [block("h", (50, 20, 300, 32), f"Report of May, page {p}", ord=0, page=p), block("a", (50, 100, 300, 112), "first line", ord=1, page=p), block("b", (50, 200, 150, 212), "left part", ord=2, page=p), block("c", (160, 200, 300, 212), "right part", ord=3, page=p), block("e", (50, 200, 300, 212), "left part right part", ord=4, page=p)]
        lines += [(1, p, 1, "a lost line", 0.9, 50.0, 150.0, 300.0, 162.0), (1, p, 2, "first line of them", 0.96, 50.0, 100.0, 300.0, 112.0)]
    read = spark.createDataFrame(lines, "doc_id long, page_index int, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in page.assembled(frame(spark, *rows), read, 842.0, 595.0).orderBy("page_index", "ord").collect():
        got.setdefault(r.page_index, []).append((r.ord, r.block_id, r.text))
    assert got == {p: [(0, "a", "first line of them"), (1, "line-1", "a lost line"), (2, "b", "left part"), (3, "c", "right part")] for p in range(4)}
