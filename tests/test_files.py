"""PDF and DOCX files written and read back."""

import io
import zipfile

import pytest

from quire.sinks import docx as W
from quire.sinks import pdf as P
from quire.sources import docx as D
from quire.sources import pdf as R


def block(i, kind, text=None, at=(50, 50, 300, 80), **more):
    return {"id": f"b{i}", "type": kind, "order": i, "bbox": dict(zip(("x0", "y0", "x1", "y1"), map(float, at))), "text": text} | more


def cell(row, col, text, at):
    return {"row": row, "col": col, "text": text, "bbox": dict(zip(("x0", "y0", "x1", "y1"), map(float, at)))}


MODEL = {
    "pages": [
        {"width_pt": 595.0, "height_pt": 842.0, "blocks": [block(0, "heading", "Заголовок (a) \\ <b> & 𝒳"), block(1, "text", "some words " * 12, (50, 90, 250, 130)), block(2, "table", None, (50, 200, 250, 260), table={"cells": [cell(0, 0, "1 < 2", (50, 200, 150, 230)), cell(1, 1, "last", (150, 230, 250, 260))]}), block(3, "figure", None, (300, 300, 400, 400), figure={"file": "images/f.png"})]},
        {"width_pt": 400.0, "height_pt": 300.0, "blocks": []},
    ]
}
WORDS = "Заголовок (a) \\ <b> & 𝒳 " + "some words " * 12 + "1 < 2 last images/f.png"


def test_positional_pdf():
    pages = R.read_pdf(P.positional(MODEL))
    assert [(p.width, p.height, p.hidden) for p in pages] == [(595.0, 842.0, False), (400.0, 300.0, False)]
    assert pages[0].text.split() == WORDS.split() and pages[1].text == ""


def test_flowing_pdf_goes_on_another_page():
    many = {"pages": [{"width_pt": 595.0, "height_pt": 842.0, "blocks": [block(i, "text", f"line {i}") for i in range(200)]}]}
    pages = R.read_pdf(P.flow(many))
    assert len(pages) > 3 and " ".join(p.text for p in pages).split() == " ".join(f"line {i}" for i in range(200)).split()
    assert R.read_pdf(P.flow(MODEL))[0].text.split() == WORDS.split()


def test_dense_grid_keeps_the_last_cell_of_a_slot():
    assert P.dense([cell(0, 1, "a", (0,) * 4), cell(1, 0, "b", (0,) * 4), cell(0, 1, "c", (0,) * 4)]) == [["", "c"], ["b", ""]]


def plain_pdf(content: bytes, font: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>") -> bytes:
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 100 200] >>", b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F 4 0 R >> >> /Contents 5 0 R >>", font, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, p) for i, p in enumerate(parts)) + b"trailer << /Root 1 0 R >>"


def test_simple_fonts_escapes_and_hidden_text():
    page = R.read_pdf(plain_pdf(rb"BT /F 12 Tf 10 100 Td (a\(b\)\\ \101) Tj 0 -14 Td [(x) -20 (y)] TJ ET"))[0]
    assert (page.width, page.height, page.text, page.hidden) == (100.0, 200.0, "a(b)\\ A\nxy", False)
    assert R.read_pdf(plain_pdf(b"BT 3 Tr /F 12 Tf 10 100 Td (secret) Tj ET"))[0].hidden


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.7 nothing", plain_pdf(b"") + b" /Encrypt 9 0 R"])
def test_files_that_cannot_be_read(data):
    with pytest.raises(ValueError):
        R.read_pdf(data)


def test_docx_objects_and_tables():
    data = W.document(MODEL)
    assert D.canvases(data) == [(2, 2, 0, None)]
    found = D.objects(data)
    assert [(f[0], f[1], f[3]) for f in found] == [(0, 1, True), (0, 2, True), (0, 3, True), (0, 4, True)]
    assert " ".join(f[-1] for f in found).split() == WORDS.split()
    ((page, number, exact, rows, total, border, frame),) = D.tables(data)
    assert (page, number, exact, rows) == (0, 0, True, 2) and total + rows * border + 1 <= frame + 0.1


def test_styles_are_inherited():
    w = f'xmlns:w="{W._NAMES["w"]}"'
    styles = f'<w:styles {w}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Base"/><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H"><w:name w:val="heading 1"/><w:basedOn w:val="N"/><w:rPr><w:b/><w:sz w:val="32"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="S"><w:name w:val="Sub"/><w:basedOn w:val="H"/><w:rPr><w:i/><w:b w:val="0"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="L"><w:name w:val="loop"/><w:basedOn w:val="L"/></w:style></w:styles>'
    run = lambda t, p="": f"<w:r>{p}<w:t>{t}</w:t></w:r>"
    body = f'<w:p>{run("plain")}</w:p><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr>{run("head")}</w:p><w:p><w:pPr><w:pStyle w:val="S"/></w:pPr>{run("sub", "<w:rPr><w:sz w:val=\"18\"/></w:rPr>")}</w:p><w:p><w:pPr><w:pStyle w:val="L"/></w:pPr>{run("loop")}</w:p><w:tbl><w:tr><w:tc><w:p>{run("cell")}</w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    assert D.runs(out.getvalue()) == [("text", "Base", 10.0, False, False, "plain"), ("heading", "Base", 16.0, True, False, "head"), ("heading", "Base", 9.0, False, True, "sub"), ("text", "Base", 10.0, False, False, "loop"), ("table", "Base", 10.0, False, False, "cell")]


def test_files_in_tables(spark):
    good, rows = W.document(MODEL), [(1, b"no zip"), (3, None)]
    files = spark.createDataFrame([*rows, (2, good)], "doc_id long, content binary")
    got = {r.doc_id: r for r in D.read(files, D.canvases, D.CANVASES).collect()}
    assert got[2].n == 2 and got[1].error and got[3].error
    assert {r.doc_id for r in D.read(files, D.objects, D.OBJECTS).collect()} == {2}
    pdfs = spark.createDataFrame([*rows, (2, P.positional(MODEL))], "doc_id long, content binary")
    assert sorted((r.doc_id, r.page_index) for r in R.pdf_pages(pdfs).collect()) == [(1, -1), (2, 0), (2, 1), (3, -1)]
