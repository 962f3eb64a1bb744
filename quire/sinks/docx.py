"""DOCX files of stored models: one canvas paragraph a page, to which every block is anchored at its place.

Tables stand in frames of their own, with fixed row heights, so nothing moves another page's objects.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from ..operators.typography import BODY, STYLES
from .pdf import FONT, files, fitted

#: Lengths in English metric units and in twentieths of a point; fixed values of the format.
EMU, TWENTIETHS = 12700, 20
CANVAS = "PageCanvas"
#: Room of a frame around a table: a point, and a half rule a row.
FRAME, RULE = 1.0, 0.5
_NAMES = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "wps": "http://schemas.microsoft.com/office/word/2010/wordprocessingShape",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
}
_TYPES = """<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>"""
_RELATIONS = """<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/%s" Target="%s"/></Relationships>"""


_REFUSED = re.compile("[^\t\n -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]+")


def _allowed(text: str) -> str:
    """Text without the characters that XML can't hold."""
    return _REFUSED.sub("", text)


def _run(text: str, size: float, bold: bool, italic: bool) -> str:
    marks = "<w:b/>" * bold + "<w:i/>" * italic
    return f'<w:r><w:rPr><w:rFonts w:ascii="{FONT}" w:hAnsi="{FONT}" w:cs="{FONT}"/>{marks}<w:sz w:val="{round(size * 2)}"/></w:rPr><w:t xml:space="preserve">{escape(_allowed(text))}</w:t></w:r>'


def _paragraphs(text: str, box: dict, style: tuple[float, bool, bool]) -> str:
    lines, size = fitted(text, max(1.0, box["x1"] - box["x0"]), max(1.0, box["y1"] - box["y0"]), style[0])
    plain = '<w:pPr><w:spacing w:before="0" w:after="0"/></w:pPr>'
    return "".join(f"<w:p>{plain}{_run(x, size, *style[1:])}</w:p>" for x in lines)


def _anchor(number: int, name: str, box: dict, inner: str, page: dict) -> str:
    """A frame with its content, placed from the corner of the page and kept on it."""
    x, y = (max(0.0, box[n]) for n in ("x0", "y0"))
    wide, tall = max(1.0, min(box["x1"], page["width_pt"]) - x), max(1.0, min(box["y1"], page["height_pt"]) - y)
    size = f'cx="{round(wide * EMU)}" cy="{round(tall * EMU)}"'
    place = "".join(f'<wp:position{axis} relativeFrom="page"><wp:posOffset>{round(v * EMU)}</wp:posOffset></wp:position{axis}>' for axis, v in (("H", x), ("V", y)))
    shape = f'<wps:wsp><wps:cNvSpPr txBox="1"/><wps:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></wps:spPr><wps:txbx><w:txbxContent>{inner}</w:txbxContent></wps:txbx><wps:bodyPr lIns="0" tIns="0" rIns="0" bIns="0"/></wps:wsp>'
    graphic = f'<a:graphic><a:graphicData uri="{_NAMES["wps"]}">{shape}</a:graphicData></a:graphic>'
    return f'<w:r><w:drawing><wp:anchor distT="0" distB="0" distL="0" distR="0" simplePos="0" relativeHeight="{number}" behindDoc="0" locked="1" layoutInCell="1" allowOverlap="1"><wp:simplePos x="0" y="0"/>{place}<wp:extent {size}/><wp:effectExtent l="0" t="0" r="0" b="0"/><wp:wrapNone/><wp:docPr id="{number}" name={quoteattr(_allowed(name))}/>{graphic}</wp:anchor></w:drawing></w:r>'


def _table(block: dict) -> tuple[str, float]:
    """The table's XML and its height with rules; a slot that no cell owns is empty."""
    cells = {(c["row"], c["col"]): c for c in block["table"].get("cells") or []}
    rows, cols = 1 + max((r for r, _ in cells), default=0), 1 + max((c for _, c in cells), default=0)
    box = block["bbox"]
    height = max(8.0, (box["y1"] - box["y0"] - FRAME) / rows - RULE)
    width = round((box["x1"] - box["x0"]) / cols * TWENTIETHS)
    out = []
    for r in range(rows):
        texts = []
        for c in range(cols):
            text = (cells.get((r, c)) or {}).get("text") or ""
            inside = {"x0": 0, "x1": width / TWENTIETHS - 4, "y0": 0, "y1": height}
            texts.append(f'<w:tc><w:tcPr><w:tcW w:w="{width}" w:type="dxa"/></w:tcPr>{_paragraphs(text, inside, BODY)}</w:tc>')
        out.append(f'<w:tr><w:trPr><w:trHeight w:val="{int(height * TWENTIETHS)}" w:hRule="exact"/></w:trPr>{"".join(texts)}</w:tr>')
    rule = round(RULE * 8)
    sides = "".join(f'<w:{s} w:val="single" w:sz="{rule}" w:space="0" w:color="000000"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    grid = "".join(f'<w:gridCol w:w="{width}"/>' for _ in range(cols))
    return f'<w:tbl><w:tblPr><w:tblW w:w="{width * cols}" w:type="dxa"/><w:tblBorders>{sides}</w:tblBorders><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{"".join(out)}</w:tbl><w:p/>', rows * (height + RULE) + FRAME


def document(model: dict) -> bytes:
    """The file of a model."""
    body, number = [], 0
    pages = model["pages"]
    for page in pages:
        anchors = []
        for b in page.get("blocks") or []:
            number += 1
            if b.get("table"):
                inner, needed = _table(b)
                box = b["bbox"] | {"y1": max(b["bbox"]["y1"], b["bbox"]["y0"] + needed)}
                anchors.append(_anchor(number, f"table {b['id']}", box, inner, page))
            else:
                text = b["figure"]["file"] if b.get("figure") else b.get("text") or ""
                anchors.append(_anchor(number, f"{b['type']} {b['id']}", b["bbox"], _paragraphs(text, b["bbox"], STYLES.get(b["type"], BODY)), page))
        size = f'<w:pgSz w:w="{round(page["width_pt"] * TWENTIETHS)}" w:h="{round(page["height_pt"] * TWENTIETHS)}"/><w:pgMar w:top="0" w:right="0" w:bottom="0" w:left="0" w:header="0" w:footer="0" w:gutter="0"/>'
        last = page is pages[-1]
        section = "" if last else f"<w:sectPr>{size}</w:sectPr>"
        body.append(f'<w:p><w:pPr><w:pStyle w:val="{CANVAS}"/>{section}</w:pPr>{"".join(anchors)}</w:p>' + (f"<w:sectPr>{size}</w:sectPr>" if last else ""))
    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in _NAMES.items())
    styles = f'<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="{CANVAS}"><w:name w:val="Page canvas"/><w:basedOn w:val="Normal"/></w:style>'
    parts = {
        "[Content_Types].xml": _TYPES,
        "_rels/.rels": _RELATIONS % ("officeDocument", "word/document.xml"),
        "word/_rels/document.xml.rels": _RELATIONS % ("styles", "styles.xml"),
        "word/styles.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:styles xmlns:w="{_NAMES["w"]}">{styles}</w:styles>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document {spaces}><w:body>{"".join(body)}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            # Lone surrogates, which no UTF-8 holds, were dropped before.
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), text.encode())
    return out.getvalue()


def docx(models: DataFrame) -> DataFrame:
    """doc_id, docx of stored models (doc_id, json)."""
    return files(models, "docx", document)
