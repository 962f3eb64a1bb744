"""Layout, tables, texts and checks on small documents."""

import pytest
from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import match, refine, tables, typography
from quire.quality import checks as C

BLOCK = "doc_id long, page_index int, block_id string, type string, text string, ord int, x0 double, y0 double, x1 double, y1 double, confidence double, file string, source_label string"


def block(block_id, box, text=None, kind="text", ord=0, page=0, confidence=0.9, file=None, label=None):
    return (1, page, block_id, kind, text, ord, *map(float, box), confidence, file, label)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), BLOCK)


def greedy_columns(boxes, gap=18.0):
    columns = []
    for b in sorted(boxes, key=lambda b: (b[1], b[2], b[0])):
        home = next((c for c in columns if b[1] <= max(x[3] for x in c) + gap and b[3] >= min(x[1] for x in c) - gap), None)
        home.append(b) if home is not None else columns.append([b])
    columns.sort(key=lambda c: min(x[1] for x in c))
    return [b[0] for c in columns for b in sorted(c, key=lambda b: (b[2], b[1], b[0]))]


def test_reading_order_equals_greedy_columns(spark):
    import random

    rng = random.Random(7)
    rows = []
    for p in range(300):
        for i in range(rng.randint(1, 12)):
            x, y, w = rng.randint(0, 200), rng.randint(0, 50), rng.randint(1, 60)
            rows.append(block(f"b{i:02d}", (x, y, x + w, y + 5), "t", page=p))
    got = {}
    for r in L.reading_order(frame(spark, *rows).drop("ord")).orderBy("page_index", "ord").collect():
        got.setdefault(r.page_index, []).append(r.block_id)
    for p in range(300):
        assert got[p] == greedy_columns([(r[2], r[6], r[7], r[8]) for r in rows if r[1] == p])


def test_captions_take_the_nearest_figure_and_the_last_caption_stays(spark):
    b = frame(spark, block("f1", (0, 100, 50, 150), kind="figure", ord=0), block("f2", (0, 300, 50, 350), kind="figure", ord=1), block("c1", (0, 155, 50, 165), "one", "caption", 2), block("c2", (0, 170, 50, 180), "two", "caption", 3), block("c3", (200, 355, 250, 365), "other column", "caption", 4))
    assert [(r.figure_id, r.caption_id) for r in L.attach_captions(b).collect()] == [("f1", "c2")]


def test_echo_of_two_parts(spark):
    b = frame(spark, block("a", (30, 30, 120, 45), "УТВЕРЖДЕНЫ", ord=0), block("b", (140, 30, 220, 45), "Приложение", ord=1), block("e", (30, 30, 220, 45), "УТВЕРЖДЕНЫ Приложение", ord=2))
    assert [r.block_id for r in L.echoes(b).collect()] == ["e"]
    assert [r.block_id for r in L.contained_duplicates(b).collect()] == ["e"]
    assert L.echoes(b.filter("block_id <> 'b'")).count() == 0


def figure(size, at=(100, 100), label=None):
    return block("f", (*at, at[0] + size[0], at[1] + size[1]), kind="figure", file="f.png", label=label)


@pytest.mark.parametrize(
    "glyph, size, label, leak, pictogram",
    [("Х", (15, 30), None, 0, 1), ("ТЕКСТ", (15, 30), None, 1, 0), ("1", (15, 30), None, 1, 0), ("Х", (100, 100), None, 1, 0), ("Х", (15, 30), "ocr_image_fallback", 1, 0), ("Х", (15, 30), "graphic_field", 1, 0)],
)
def test_leaks_and_pictograms(spark, glyph, size, label, leak, pictogram):
    b = frame(spark, figure(size, label=label), block("t", (105, 124, 113, 132), glyph, ord=1))
    assert L.figure_leaks(b).count() == leak and L.figure_leaks(b, pictograms=True).count() == pictogram


def test_repeated_margins(spark):
    rows = [block("h", (50, 20, 300, 35), f"Report of May, page {p}", page=p) for p in range(4)] + [block("b", (50, 400, 300, 415), "Body text that repeats", ord=1, page=p) for p in range(4)]
    got = L.repeated_margins(frame(spark, *rows), 842.0, 595.0).collect()
    assert sorted((r.page_index, r.block_id, r.new_type) for r in got) == [(p, "h", "header") for p in range(4)]
    assert L.repeated_margins(frame(spark, *rows[:2], *rows[4:]), 842.0, 595.0).count() == 0


def test_recovered_lines(spark):
    b = frame(spark, block("a", (50, 100, 300, 115), "first line", ord=0), block("b", (50, 200, 300, 215), "second", ord=1))
    lines = spark.createDataFrame([(1, 0, 1, "first line", 0.9, 50.0, 100.0, 300.0, 115.0), (1, 0, 2, "lost line", 0.9, 50.0, 150.0, 300.0, 165.0), (1, 0, 3, "lost line", 0.9, 50.0, 151.0, 300.0, 166.0), (1, 0, 4, "unsure", 0.5, 50.0, 300.0, 300.0, 315.0), (1, 0, 5, "at the foot", 0.8, 50.0, 820.0, 300.0, 830.0)], "doc_id long, page_index int, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = L.recover_lines(b, lines, 842.0).orderBy("ord").collect()
    assert [(r.block_id, r.type) for r in got] == [("a", "text"), ("line-2", "text"), ("b", "text"), ("line-5", "footer")]
    empty = L.recover_lines(b.limit(0), lines, 842.0).orderBy("ord").collect()
    assert [r.block_id for r in empty] == ["line-1", "line-2", "line-5"]


def test_push_down(spark):
    b = frame(spark, block("a", (0, 10, 100, 20), "x", ord=0), block("b", (0, 15, 100, 25), "y", ord=1), block("c", (200, 15, 300, 25), "z", ord=2)).withColumn("needed", F.lit(12.0))
    assert {r.block_id: r.top for r in L.push_down(b).collect()} == {"a": 10.0, "b": 23.0, "c": 15.0}


CELL = "t long, row int, col int, rowspan int, colspan int, text string, x0 double, y0 double, x1 double, y1 double, cell_seq int"


def test_placements_keep_texts_of_doubled_slots(spark):
    c = spark.createDataFrame([(1, 0, 0, 2, 2, "a", 0.0, 0.0, 20.0, 20.0, 0), (1, 1, 1, 1, 1, "b", 10.0, 10.0, 20.0, 20.0, 1), (1, 1, 1, 1, 1, " b ", 10.0, 10.0, 20.0, 20.0, 2), (1, 0, 2, 1, 1, "c", 20.0, 0.0, 30.0, 10.0, 3)], CELL)
    assert sorted((r.row, r.col, r.rowspan, r.colspan, r.text) for r in tables.placements(c, ["t"]).collect()) == [(0, 0, 2, 2, "a\nb"), (0, 2, 1, 1, "c")]
    assert [(r.row, r.col) for r in tables.missing_slots(c, ["t"]).collect()] == [(1, 2)]


def test_table_html_escapes_and_spans(spark):
    c = spark.createDataFrame([(1, 0, 0, 1, 2, "Сумма < 100 & НДС", 0.0, 0.0, 1.0, 1.0, 0), (1, 1, 1, 1, 1, '"q"', 0.0, 0.0, 1.0, 1.0, 1)], CELL)
    assert tables.to_html(c, ["t"]).first().html == '<table><tr><td rowspan="1" colspan="2">Сумма &lt; 100 &amp; НДС</td></tr><tr><td></td><td rowspan="1" colspan="1">&quot;q&quot;</td></tr></table>'


def test_grow_rows(spark):
    need = spark.createDataFrame([(1, 0, 0, 2, 30.0), (1, 1, 1, 1, 5.0)], "t long, row int, col int, rowspan int, needed double")
    heights = spark.createDataFrame([(1, 0, 10.0), (1, 1, 10.0)], "t long, at int, size double")
    assert [r.size for r in tables.grow_rows(need, heights, ["t"]).orderBy("at").collect()] == [15.0, 15.0]


def test_text_match(spark):
    a, b = spark.createDataFrame([(1, "слово слово"), (2, "")], "k long, text string"), spark.createDataFrame([(1, "слово"), (2, "extra")], "k long, text string")
    got = {r.k: r for r in match.text_match(a, b, ["k"]).collect()}
    assert (got[1].recall, got[1].precision, got[1].missing, got[1].extra) == (0.5, 1.0, ["слово"], [])
    assert (got[2].recall, got[2].extra) == (0.0, ["extra"])


def test_host_corrections(spark):
    t = spark.createDataFrame([(1, "stоrе.ехample.сотНовый.Список file_name.dat"), (2, "other.сотНовый.Список"), (3, "stоrе.ехample.com")], "unit_id long, text string")
    domains = spark.createDataFrame([("store.example.com",), ("data.example.net",)], "domain string")
    edits = match.host_corrections(t, domains, ["unit_id"])
    from quire.operators.align import replace_all

    by_id = {r.unit_id: (r.before, r.after) for r in edits.collect()}
    assert set(by_id) == {1, 3}
    assert replace_all("stоrе.ехample.сотНовый.Список file_name.dat", dict([by_id[1]]), open_end=True) == "store.example.comНовый.Список file_name.dat"


def test_verified_corrections(spark):
    t = spark.createDataFrame([("u", "докумеит один раз"), ("v", "докумеит и докумеит")], "unit_id string, text string")
    c = spark.createDataFrame([("u", "докумеит", "документ", 0.99, 0), ("u", "докумеит", "документы", 0.99, 1), ("u", "один", "один", 1.0, 2), ("v", "докумеит", "документ", 0.99, 3), ("u", "раз", "рас", 0.5, 4)], "unit_id string, before string, after string, confidence double, n int")
    good = match.verified(c, t, [])
    assert [(r.unit_id, r.after) for r in good.collect()] == [("u", "документ")]
    assert {r.unit_id: r.text for r in match.apply_corrections(t, good).collect()} == {"u": "документ один раз", "v": "докумеит и докумеит"}


def test_vote(spark):
    r = spark.createDataFrame([(1, "a", 0.9), (1, "a", 0.86), (1, "b", 0.99), (2, "x", 0.9), (2, "x", 0.5)], "k long, text string, confidence double")
    assert [(x.k, x.text) for x in match.vote(r, ["k"]).collect()] == [(1, "a")]


def test_low_confidence_becomes_an_image_and_a_whole_page_does_not(spark):
    b = frame(spark, block("t", (30, 30, 450, 65), "Документ проверен", confidence=0.2), block("p", (0, 0, 595, 842), "page", confidence=0.1, ord=1))
    targets = refine.unreadable_blocks(b, 595.0, 842.0)
    assert {r.block_id: r.status for r in targets.collect()} == {"t": "replaced", "p": "refused"}
    out = {r.block_id: r for r in refine.replace_regions(b, targets).collect()}
    assert (out["t"].type, out["t"].text, out["t"].source_label, out["t"].x0) == ("figure", None, "ocr_image_fallback", 30.0)
    assert (out["p"].type, out["p"].text) == ("text", "page")


def test_one_cell_becomes_an_image(spark):
    c = spark.createDataFrame([(1, 0, 0, 1, 1, "BAD", 0.0, 0.0, 1.0, 1.0, 0), (1, 0, 1, 1, 1, "GOOD", 1.0, 0.0, 2.0, 1.0, 1)], CELL)
    cells, images = refine.replace_cells(c, c.filter("text = 'BAD'").select("t", "row", "col"), ["t"])
    assert [r.text for r in cells.orderBy("col").collect()] == ["", "GOOD"] and images.count() == 1


def test_gaps_of_form_fields(spark):
    lines = spark.createDataFrame([(1, 0, "l", 0.0, 10.0, 100.0, 20.0)], "doc_id long, page_index int, line_id string, x0 double, y0 double, x1 double, y1 double")
    rules = spark.createDataFrame([(1, 0, 20.0, 18.0, 40.0, 19.0), (1, 0, 60.0, 21.0, 70.0, 22.0), (1, 0, 80.0, 50.0, 90.0, 51.0)], "doc_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.x0, r.x1) for r in refine.reserve_gaps(lines, rules).orderBy("n").collect()] == [(0.0, 20.0), (40.0, 60.0), (70.0, 100.0)]


def test_typography(spark):
    runs = spark.createDataFrame([("text", "A", 10.0, False, False, "x" * 90), ("text", "A", 12.0, False, False, "x" * 20), ("text", "A", 14.0, False, False, "x"), ("text", "B", 9.0, False, False, "x" * 30)], "role string, family string, size double, bold boolean, italic boolean, text string")
    s = typography.standard(runs).first()
    assert (s.family, s.size, s.sizes) == ("A", 10.0, [10.0, 12.0])


def test_checks(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    pages = spark.createDataFrame([(1, 0, "ok", 100.0, 100.0), (1, 1, "degraded", 100.0, 100.0)], "doc_id long, page_index int, status string, width_pt double, height_pt double")
    b = frame(spark, block("a", (0, 0, 50, 50), "text"), block("b", (90, 0, 101, 10), "x", ord=1))
    assert {r.doc_id: r.status for r in C.page_count(docs, pages).collect()} == {1: "WARN", 2: "FAIL"}
    assert {r.doc_id: r.detail for r in C.boxes(docs, b, pages).collect()}[1] == "page 1, block b"
    assert {r.doc_id: r.status for r in C.ocr_text(docs, b).collect()} == {1: "PASS", 2: "FAIL"}
    both = C.report(C.page_count(docs, pages), C.ocr_text(docs, b))
    assert {r.doc_id: (r.result, r.ok) for r in C.result(both).collect()} == {1: ("WARN", True), 2: ("FAIL", False)}


def test_review_reports(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    r = spark.createDataFrame([(1, "review-after.json", "partial", True, []), (1, "review-before.json", "completed", False, ["pdf_text_missing"])], "doc_id long, name string, status string, review_required boolean, kinds array<string>")
    got = {x.check: (x.status, x.detail) for x in C.reviews(docs, r).collect()}
    assert got == {"document_review": ("WARN", "review-after.json: partial"), "export_text_integrity": ("FAIL", "review-before.json: pdf_text_missing")}


@pytest.mark.parametrize("path, safe", [("a/b.png", True), ("../b.png", False), ("/b.png", False), ("C:\\b.png", False), ("a/../b", False), ("", False)])
def test_safe_path(spark, path, safe):
    assert spark.createDataFrame([(path,)], "p string").select(F.coalesce(C.safe_path(F.col("p")), F.lit(False)).alias("x")).first().x is safe


def test_contents(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    poor = frame(spark, block("h", (0, 0, 10, 10), "Содержание"), block("n", (0, 20, 10, 30), "3", ord=1))
    rich = frame(spark, block("h", (0, 0, 10, 10), "СОДЕРЖАНИЕ"), block("n", (0, 20, 10, 30), "\n".join(f"{i}. Chapter with a name {i}" for i in range(4)), ord=1))
    assert C.contents(docs, poor).first().status == "WARN" and C.contents(docs, rich).first().status == "PASS"
