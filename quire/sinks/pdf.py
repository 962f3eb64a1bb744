"""PDF files of stored models: every block at its place, or text and tables flowing down A4 pages.

Text is painted, so it is visible and can be searched. The font is named, not embedded: a text's codes are those of
Unicode, a table of the file says so to readers, and widths are those of ``typography.ADVANCE``.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import A4
from ..operators.typography import ADVANCE, BODY, OTHER_ADVANCE, STYLES

FONT, LEADING, LEAST, MARGIN = "Arial", 1.2, 4.0, 56.0


class _Advances(dict):
    """Advance of a character in thousandths of the size, found when it is first met."""

    def __missing__(self, c: str) -> int:
        self[c] = next((n for p, n in ADVANCE.values() if re.fullmatch(p, c)), OTHER_ADVANCE)
        return self[c]


_ADVANCES = _Advances()


def width(text: str, size: float) -> float:
    """Width of a text in points."""
    return sum(map(_ADVANCES.__getitem__, text)) * size / 1000


def wrapped(text: str, room: float, size: float) -> list[str]:
    """Lines of the text, words packed greedily."""
    return [" ".join(x) for x, _ in _packed(_measured(text), room, size)]


#: Words up to so many characters whose widths are kept, and how many of them.
SHORT, KEPT = 32, 1 << 16


def _units(word: str) -> int:
    return sum(map(_ADVANCES.__getitem__, word))


_known_units = lru_cache(KEPT)(_units)


def _measured(text: str) -> list[tuple[list[str], list[int]]]:
    """Words of each line of the text, and where each ends if a blank follows it, in thousandths of whatever size they are set in."""
    blank = _ADVANCES[" "]
    return [(words, list(accumulate((_known_units(w) if len(w) <= SHORT else _units(w)) + blank for w in words))) for words in (line.split(" ") for line in text.split("\n"))]


#: Thousandths of a size by which sums of widths in points may differ from those in whole numbers, and more.
UNSURE = 0.01


def _packed(measured: list[tuple[list[str], list[int]]], room: float, size: float) -> list[tuple[list[str], int]]:
    """Words of each line in this room, and the line's width in thousandths of the size."""
    out, blank, most = [], _ADVANCES[" "], room * 1000 / size
    for words, ends in measured:
        start, before, n = 0, 0, len(words)
        while start < n:
            # The first word that ends beyond the room opens a line, but for one before which there are blanks only.
            limit = before + blank + most
            stop = bisect_right(ends, limit, start)
            if any(abs(ends[i] - limit) < UNSURE for i in (stop - 1, stop) if start < i < n):
                stop = _stop(words, ends, start, room, size)
            else:
                first = start
                while first < n and not words[first]:
                    first += 1
                stop = min(n, max(stop, first + 1))
            out.append((words[start:stop], ends[stop - 1] - before - blank))
            start, before = stop, ends[stop - 1]
    return out


def _stop(words: list[str], ends: list[int], start: int, room: float, size: float) -> int:
    """Where the line from ``start`` ends, by sums in points."""
    blank = _ADVANCES[" "]
    space, used, ink = blank * size / 1000, 0.0, False
    for i in range(start, len(words)):
        more = (ends[i] - (ends[i - 1] if i else 0) - blank) * size / 1000
        if ink and used + space + more > room:
            return i
        used += more + (space if i > start else 0.0)
        ink = ink or words[i] != ""
    return len(words)


def fitted(text: str, room: float, height: float, size: float) -> tuple[list[str], float]:
    """Lines and size: the largest size in half points, from ``size`` down, at which the text fits its box, else the least."""
    measured = _measured(text)
    blank, given = _ADVANCES[" "], len(measured)
    total = sum(ends[-1] for _, ends in measured) - given * blank
    while size > LEAST:
        # So many lines have room; if all words take more than that many full ones, they needn't be packed to see that they don't fit.
        lines = int((height + 2) / (size * LEADING) + 1e-9)
        if lines >= given and total <= lines * (room + 2) * 1000 / size + (lines - given) * blank + UNSURE * lines:
            packed = _packed(measured, room, size)
            if len(packed) * size * LEADING <= height + 2 and max(x for _, x in packed) * size / 1000 <= room + 2:
                return [" ".join(x) for x, _ in packed], size
        size -= 0.5
    return [" ".join(x) for x, _ in _packed(measured, room, LEAST)], LEAST


class Canvas:
    """Operators of one page; places are from its upper left corner."""

    def __init__(self, page_width: float, page_height: float):
        self.size, self.parts, self.letters = (page_width, page_height), [], set()
        self.image = None

    def text(self, x: float, y: float, line: str, size: float, bold: bool = False) -> None:
        """A line whose upper edge is at y."""
        if line:
            codes = line.encode("utf-16-be", "surrogatepass").hex()
            self.letters.update(line)
            self.parts.append(f"BT /{'F2' if bold else 'F1'} {size:.2f} Tf 1 0 0 1 {x:.2f} {self.size[1] - y - size * 0.8:.2f} Tm <{codes}> Tj ET")

    def box(self, x0: float, y0: float, x1: float, y1: float) -> None:
        self.parts.append(f"{x0:.2f} {self.size[1] - y1:.2f} {x1 - x0:.2f} {y1 - y0:.2f} re S")

    def block(self, text: str, box: dict, size: float, bold: bool = False) -> None:
        lines, size = fitted(text, max(1.0, box["x1"] - box["x0"]), max(1.0, box["y1"] - box["y0"]), size)
        for i, line in enumerate(lines):
            self.text(box["x0"], box["y0"] + i * size * LEADING, line, size, bold)


def image_document(images: list, dpi: int = 300) -> bytes:
    """Frames (arrays of gray or red, green and blue) as pages of their own size, without loss."""
    pages = []
    for image in images:
        height, width_ = image.shape[:2]
        page = Canvas(width_ * 72 / dpi, height * 72 / dpi)
        page.image = image
        page.parts.append(f"q {page.size[0]:.2f} 0 0 {page.size[1]:.2f} 0 0 cm /I Do Q")
        pages.append(page)
    return document(pages)


_MAP = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Unicode def /CMapType 2 def
1 begincodespacerange <0000> <ffff> endcodespacerange
%s
endcmap end end"""


def _unicode_map(letters: set[str]) -> bytes:
    """Every code that occurs is the letter with that number; letters beyond 16 bits are two codes."""
    codes = [x.encode("utf-16-be", "surrogatepass").hex() for x in letters]
    rows = [f"<{x}> <{x}>" for x in sorted({x[i : i + 4] for x in codes for i in range(0, len(x), 4)})]
    parts = [rows[i : i + 100] for i in range(0, len(rows), 100)]
    return _MAP % "\n".join(f"{len(p)} beginbfchar\n" + "\n".join(p) + "\nendbfchar" for p in parts).encode()


def document(pages: list[Canvas]) -> bytes:
    """The file of these pages."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(data: bytes) -> bytes:
        packed = zlib.compress(data)
        return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed)

    root, tree = add(b""), add(b"")
    mapped = add(stream(_unicode_map(set().union(*(p.letters for p in pages)))))
    fonts = []
    for name in (FONT, f"{FONT},Bold"):
        about = add(f"<< /Type /FontDescriptor /FontName /{name} /Flags 32 /FontBBox [-200 -250 1200 950] /ItalicAngle 0 /Ascent 905 /Descent -212 /CapHeight 716 /StemV 80 >>".encode())
        inner = add(f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /{name} /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor {about} 0 R /DW {OTHER_ADVANCE} >>".encode())
        fonts.append(add(f"<< /Type /Font /Subtype /Type0 /BaseFont /{name} /Encoding /Identity-H /DescendantFonts [{inner} 0 R] /ToUnicode {mapped} 0 R >>".encode()))
    kids = []
    for page in pages:
        content, picture = add(stream("\n".join(["0.5 w", *page.parts]).encode("ascii"))), ""
        if page.image is not None:
            high, wide = page.image.shape[:2]
            space = "DeviceRGB" if page.image.ndim == 3 else "DeviceGray"
            head = f"/Type /XObject /Subtype /Image /Width {wide} /Height {high} /ColorSpace /{space} /BitsPerComponent 8 ".encode()
            picture = f"/XObject << /I {add(stream(page.image.tobytes()).replace(b'<< ', b'<< ' + head, 1))} 0 R >> "
        kids.append(add(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {page.size[0]:.2f} {page.size[1]:.2f}] /Resources << {picture}/Font << /F1 {fonts[0]} 0 R /F2 {fonts[1]} 0 R >> >> /Contents {content} 0 R >>".encode()))
    objects[root - 1] = f"<< /Type /Catalog /Pages {tree} 0 R >>".encode()
    objects[tree - 1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>".encode()
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, root, start)
    return bytes(out)


def _style(kind: str) -> tuple[float, bool]:
    size, bold, _ = STYLES.get(kind, BODY)
    return size, bold


def positional(model: dict) -> bytes:
    """The model's pages with every block at its place; figures are frames with the names of their files."""
    pages = []
    for page in model["pages"]:
        canvas = Canvas(page["width_pt"], page["height_pt"])
        for b in page.get("blocks") or []:
            if b.get("table"):
                for c in b["table"].get("cells") or []:
                    canvas.box(*(c["bbox"][n] for n in ("x0", "y0", "x1", "y1")))
                    canvas.block(c.get("text") or "", c["bbox"], BODY[0])
            elif b.get("figure"):
                canvas.box(*(b["bbox"][n] for n in ("x0", "y0", "x1", "y1")))
                canvas.text(b["bbox"]["x0"] + 2, b["bbox"]["y0"] + 2, b["figure"]["file"], 6.0)
            else:
                canvas.block(b.get("text") or "", b["bbox"], *_style(b["type"]))
        pages.append(canvas)
    return document(pages or [Canvas(*A4)])


def dense(cells: list[dict]) -> list[list[str]]:
    """The texts of a table by row and column; empty where no cell begins, and of several cells the last."""
    rows = 1 + max((c["row"] for c in cells), default=-1)
    cols = 1 + max((c["col"] for c in cells), default=-1)
    out = [[""] * cols for _ in range(rows)]
    for c in cells:
        out[c["row"]][c["col"]] = c.get("text") or ""
    return out


def flow(model: dict) -> bytes:
    """Texts and tables in reading order down A4 pages."""
    room, pages = A4[0] - 2 * MARGIN, [Canvas(*A4)]
    at = MARGIN

    def space(height: float) -> Canvas:
        nonlocal at
        if at + height > A4[1] - MARGIN and at > MARGIN:
            pages.append(Canvas(*A4))
            at = MARGIN
        return pages[-1]

    for page in model["pages"]:
        for b in sorted(page.get("blocks") or [], key=lambda b: b["order"]):
            if b.get("table"):
                grid = dense(b["table"].get("cells") or [])
                for row in grid:
                    step = room / max(1, len(row))
                    lines = [wrapped(t, step - 6, 9.0) for t in row]
                    height = max(map(len, lines), default=1) * 9.0 * LEADING + 4
                    canvas = space(height)
                    for i, texts in enumerate(lines):
                        canvas.box(MARGIN + i * step, at, MARGIN + (i + 1) * step, at + height)
                        for j, t in enumerate(texts):
                            canvas.text(MARGIN + i * step + 3, at + 2 + j * 9.0 * LEADING, t, 9.0)
                    at += height
                continue
            size, bold = _style(b["type"])
            text = b["figure"]["file"] if b.get("figure") else b.get("text") or ""
            for line in wrapped(text, room, size) if text else []:
                space(size * LEADING).text(MARGIN, at, line, size, bold)
                at += size * LEADING
            at += 4
    return document(pages)


#: Files that a task passes on together: a batch of models may be many times as large once they are written.
FILES = 64


def files(models: DataFrame, name: str, write: Callable[[dict], bytes]) -> DataFrame:
    """doc_id and the file ``write`` makes of each stored model (doc_id, json), a few in memory at a time; null where there is no model."""
    known = models.select("doc_id", "json")
    kinds = to_arrow_schema(T.StructType([known.schema["doc_id"], T.StructField(name, T.BinaryType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FILES):
                some = batch.slice(start, FILES)
                made = [write(json.loads(m.as_py())) if m.as_py() else None for m in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(kinds[0].type), pa.array(made, pa.binary())], schema=kinds)

    return known.mapInArrow(run, T.StructType([known.schema["doc_id"], T.StructField(name, T.BinaryType())]))


def positional_pdf(models: DataFrame) -> DataFrame:
    """doc_id, pdf of stored models (doc_id, json)."""
    return files(models, "pdf", positional)


def flow_pdf(models: DataFrame) -> DataFrame:
    return files(models, "pdf", flow)
