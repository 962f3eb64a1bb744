"""What DOCX files hold: objects on their canvases, tables in frames, and styled runs with the styles they inherit."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..sinks.docx import _NAMES, CANVAS, EMU, TWENTIETHS

_W = "{" + _NAMES["w"] + "}"
OBJECTS = "doc_id long, page_index int, object_id int, name string, from_page boolean, x double, y double, width double, height double, text string"
TABLES = "doc_id long, page_index int, table_no int, exact boolean, rows int, row_sum double, border double, frame_height double"
CANVASES = "doc_id long, n int, sections int, body_tables int, error string"
#: All three, of one file a row; the objects without their texts.
STRUCTURE = "doc_id long, n int, sections int, body_tables int, error string, objects array<struct<page_index: int, object_id: int, name: string, from_page: boolean, x: double, y: double, width: double, height: double>>, tables array<struct<page_index: int, table_no: int, exact: boolean, rows: int, row_sum: double, border: double, frame_height: double>>"
RUNS = "doc_id long, role string, family string, size double, bold boolean, italic boolean, text string"


def _part(data: bytes, name: str, most: int = 64 << 20) -> ET.Element | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if name not in z.namelist():
            return None
        if z.getinfo(name).file_size > most:
            raise ValueError(f"{name} is too large")
        text = z.read(name)
    if b"<!DOCTYPE" in text[:1000]:
        raise ValueError("document types are not read")
    return ET.fromstring(text)


def _body(data: bytes) -> tuple[ET.Element, list[ET.Element]]:
    root = _part(data, "word/document.xml")
    body = root.find("w:body", _NAMES) if root is not None else None
    if body is None:
        raise ValueError("no document")
    canvases = [p for p in body.findall("w:p", _NAMES) if (s := p.find("w:pPr/w:pStyle", _NAMES)) is not None and s.get(f"{_W}val") == CANVAS]
    return root, canvases


def canvases(data: bytes) -> list[tuple]:
    return _canvases(*_body(data))


def _canvases(root: ET.Element, found: list[ET.Element]) -> list[tuple]:
    return [(len(found), len(root.findall(".//w:sectPr", _NAMES)), len(root.find("w:body", _NAMES).findall("w:tbl", _NAMES)), None)]


def objects(data: bytes) -> list[tuple]:
    return _objects(_body(data)[1])


def _objects(found: list[ET.Element], texts: bool = True) -> list[tuple]:
    out = []
    for page, canvas in enumerate(found):
        for anchor in canvas.iterfind(".//wp:anchor", _NAMES):
            about, extent = anchor.find("wp:docPr", _NAMES), anchor.find("wp:extent", _NAMES)
            sides = [anchor.find(f"wp:position{axis}", _NAMES) for axis in "HV"]
            at = [float(s.find("wp:posOffset", _NAMES).text) / EMU for s in sides]
            text = ["\n".join("".join(t.text or "" for t in p.iterfind(".//w:t", _NAMES)) for p in anchor.iterfind(".//w:p", _NAMES))] if texts else []
            out.append((page, int(about.get("id")), about.get("name"), all(s.get("relativeFrom") == "page" for s in sides), *at, float(extent.get("cx")) / EMU, float(extent.get("cy")) / EMU, *text))
    return out


def tables(data: bytes) -> list[tuple]:
    return _tables(_body(data)[1])


def _tables(found: list[ET.Element]) -> list[tuple]:
    out = []
    for page, canvas in enumerate(found):
        for anchor in canvas.iterfind(".//wp:anchor", _NAMES):
            frame = float(anchor.find("wp:extent", _NAMES).get("cy")) / EMU
            for table in anchor.iterfind(".//w:tbl", _NAMES):
                rows = table.findall("w:tr", _NAMES)
                heights = [r.find("w:trPr/w:trHeight", _NAMES) for r in rows]
                exact = all(h is not None and h.get(f"{_W}hRule") == "exact" for h in heights)
                sides = [table.find(f"w:tblPr/w:tblBorders/w:{s}", _NAMES) for s in ("top", "bottom")]
                # A rule is given in eighths of a point; two neighbours share one.
                border = sum(float(s.get(f"{_W}sz", "0")) / 8 for s in sides if s is not None) / 2
                total = sum(float(h.get(f"{_W}val", "0")) / TWENTIETHS for h in heights if h is not None)
                out.append((page, len(out), exact, len(rows), total, border, frame))
    return out


def _properties(r: ET.Element | None) -> dict:
    if r is None:
        return {}
    on = lambda e: e.get(f"{_W}val", "1") not in ("0", "false", "none")
    out = {}
    if (f := r.find("w:rFonts", _NAMES)) is not None and (name := f.get(f"{_W}ascii") or f.get(f"{_W}hAnsi")):
        out["family"] = name
    if (s := r.find("w:sz", _NAMES)) is not None:
        out["size"] = float(s.get(f"{_W}val")) / 2
    for key, tag in (("bold", "w:b"), ("italic", "w:i")):
        if (e := r.find(tag, _NAMES)) is not None:
            out[key] = on(e)
    return out


def runs(data: bytes) -> list[tuple]:
    """Role, family, size, bold, italic and text of every run: its own properties over those of its styles, nearest first.

    A paragraph's role is heading if a style it has or inherits is called so, text otherwise, table within tables.
    """
    root, sheet = _part(data, "word/document.xml"), _part(data, "word/styles.xml")
    if root is None:
        raise ValueError("no document")
    styles = {s.get(f"{_W}styleId"): s for s in sheet.iterfind("w:style", _NAMES)} if sheet is not None else {}
    defaults = _properties(sheet.find("w:docDefaults/w:rPrDefault/w:rPr", _NAMES)) if sheet is not None else {}
    normal = next((k for k, s in styles.items() if s.get(f"{_W}default") == "1" and s.get(f"{_W}type") == "paragraph"), None)

    def chain(name: str | None) -> list[ET.Element]:
        out: list[ET.Element] = []
        while name in styles and styles[name] not in out:
            out.append(styles[name])
            base = styles[name].find("w:basedOn", _NAMES)
            name = base.get(f"{_W}val") if base is not None else None
        return out

    held = {id(p): True for t in root.iterfind(".//w:tbl", _NAMES) for p in t.iterfind(".//w:p", _NAMES)}
    found = []
    for p in root.iterfind(".//w:p", _NAMES):
        style = p.find("w:pPr/w:pStyle", _NAMES)
        parents = chain(style.get(f"{_W}val") if style is not None else normal)
        names = [n.get(f"{_W}val", "").lower() for s in parents if (n := s.find("w:name", _NAMES)) is not None]
        role = "table" if id(p) in held else "heading" if any(n.startswith(("heading", "title")) for n in names) else "text"
        for r in p.findall("w:r", _NAMES):
            text = "".join(t.text or "" for t in r.findall("w:t", _NAMES))
            own = r.find("w:rPr/w:rStyle", _NAMES)
            levels = [_properties(r.find("w:rPr", _NAMES)), *(_properties(s.find("w:rPr", _NAMES)) for s in [*chain(own.get(f"{_W}val") if own is not None else None), *parents]), defaults]
            known: dict = {}
            for level in levels:
                known = level | known
            if text:
                found.append((role, known.get("family"), known.get("size"), known.get("bold", False), known.get("italic", False), text))
    return found


#: What a file may do that can't be read.
_WRONG = (ValueError, KeyError, AttributeError, ET.ParseError, zipfile.BadZipFile)
#: Objects and tables that a task passes on together, about.
MOST_ROWS = 10_000


def structure(files: DataFrame) -> DataFrame:
    """Rows of STRUCTURE of files (doc_id, content), each read once: what ``read`` finds as CANVASES, OBJECTS and TABLES."""
    kinds = to_arrow_schema(files.sparkSession.createDataFrame([], STRUCTURE).schema)
    items = [[f.name for f in kinds.field(c).type.value_type] for c in ("objects", "tables")]

    def listed(names: list[str], what: Callable[[], list[tuple]]) -> list[dict]:
        try:
            return [dict(zip(names, r)) for r in what()]
        except _WRONG:
            return []

    def row(doc_id: int, data: bytes) -> tuple:
        try:
            root, found = _body(data)
            first = _canvases(root, found)[0]
        except _WRONG as e:
            return doc_id, None, None, None, f"{type(e).__name__}: {e}"[:200], [], []
        return doc_id, *first, listed(items[0], lambda: _objects(found, False)), listed(items[1], lambda: _tables(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
        for batch in batches:
            rows, size = [], 0
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append(row(doc_id, content.as_py() or b""))
                size += 1 + len(rows[-1][5]) + len(rows[-1][6])
                if size >= MOST_ROWS:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return files.select("doc_id", "content").mapInArrow(run, STRUCTURE)


def read(files: DataFrame, what: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``what`` finds in files (doc_id, content). Files that can't be read have none, but for their error in CANVASES."""
    kinds = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    tells = schema == CANVASES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [(doc_id, *r) for r in what(content.as_py() or b"")]
                except _WRONG as e:
                    rows = [(doc_id, None, None, None, f"{type(e).__name__}: {e}"[:200])] if tells else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return files.select("doc_id", "content").mapInArrow(run, schema)
