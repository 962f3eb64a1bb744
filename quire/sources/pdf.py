"""The text layer of PDF files: pages with their size, text, and whether some of it is painted invisibly.

Read are files whose objects stand in plain sight, with streams packed by Flate or not at all; others give an error
for the whole file, as do encrypted ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_REF = rb"(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


@dataclass
class Page:
    width: float
    height: float
    text: str
    hidden: bool


def _stream(body: bytes) -> bytes:
    head, _, rest = body.partition(b"stream")
    data = rest.lstrip(b"\r").removeprefix(b"\n")
    data = data[: data.rfind(b"endstream")]
    if b"/FlateDecode" in head:
        return zlib.decompressobj().decompress(data)
    if b"/Filter" in head:
        raise ValueError("a stream is packed in a way that isn't read")
    return data


def _refs(body: bytes, name: bytes) -> list[int]:
    found = re.search(rb"/" + name + rb"\s*(?:\[([^\]]*)\]|" + _REF + rb")", body)
    if not found:
        return []
    return [int(found[2])] if found[2] else [int(x) for x in re.findall(_REF, found[1])]


class _Letters(dict):
    """What a map says of each code of two bytes, by the code's number."""

    def __init__(self, codes: _Codes):
        super().__init__()
        self.codes = codes

    def __missing__(self, n: int) -> str:
        self[n] = self.codes[n.to_bytes(2, "big")]
        return self[n]


class _Codes(dict):
    """What a map to Unicode says of each code; ranges are looked up when a code is first met."""

    def __init__(self):
        super().__init__()
        self.ranges: list[tuple[int, int, int, int]] = []
        self.letters = _Letters(self)

    def __missing__(self, code: bytes) -> str:
        n = int.from_bytes(code, "big")
        found = next((to + n - first for size, first, last, to in self.ranges if size == len(code) and first <= n <= last), None)
        self[code] = "�" if found is None else found.to_bytes(4 if found > 0xFFFF else 2, "big").decode("utf-16-be", "surrogatepass")
        return self[code]

    @property
    def size(self) -> int:
        return self.ranges[0][0] if self.ranges else len(next(iter(self), b"x"))


@lru_cache(1 << 16)
def _of_hex(digits: bytes) -> tuple[bytes, str]:
    raw = bytes.fromhex(digits.decode())
    return raw, raw.decode("utf-16-be", "surrogatepass")


def _codes(cmap: bytes) -> _Codes:
    out = _Codes()
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<(\w+)>\s*<(\w+)>", part):
            out[bytes.fromhex(code.decode()) if len(code) % 4 else _of_hex(code)[0]] = _of_hex(to)[1]
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for first, last, to in re.findall(rb"<(\w+)>\s*<(\w+)>\s*<(\w+)>", part):
            out.ranges.append((len(first) // 2, int(first, 16), int(last, 16), int(to, 16)))
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = token[1:-1].translate(None, b" \t\n\r\f\v")
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)


def _shown(content: bytes, fonts: dict[bytes, _Codes | None]) -> tuple[str, bool]:
    """Text of a page's operators, a line for each place it goes down to, and whether any is invisible."""
    stack: list[bytes] = []
    lines: list[list[str]] = [[]]
    font: _Codes | None = None
    mode, hidden, row = 0, False, None
    for token in _TOKEN.findall(content):
        # Tokens that begin so are strings, lists, names and numbers; the others are operators.
        if token[:1] in b"(<[]/+-.0123456789":
            stack.append(token)
            continue
        if token == b"Tf" and len(stack) >= 2:
            font = fonts.get(stack[-2][1:])
        elif token == b"Tr" and stack:
            mode = int(float(stack[-1]))
        elif token in (b"Tm", b"Td", b"TD") and len(stack) >= 2:
            now = round(float(stack[-1]), 1)
            if token != b"Tm" and now or token == b"Tm" and now != row:
                lines.append([])
            row = now if token == b"Tm" else row
        elif token in (b"T*", b"'", b'"'):
            lines.append([])
        if token in (b"Tj", b"TJ", b"'", b'"'):
            texts = [_decoded(_string(t), font) for t in stack if t[:1] in b"(<"]
            hidden = hidden or mode == 3 and any(x.strip() for x in texts)
            lines[-1].append("".join(texts))
        stack = []
    joined = (" ".join(x for x in parts if x) for parts in lines)
    text = "\n".join(x for x in joined if x)
    return text.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace"), hidden


def _decoded(raw: bytes, font: _Codes | None) -> str:
    if font is None:
        return raw.decode("cp1252", "replace")
    size = font.size
    if size == 2 and len(raw) % 2 == 0:
        text = raw.decode("utf-16-be", "surrogatepass")
        # As many letters as codes: none of them were taken for a pair, so all can be looked up at once.
        if len(text) * 2 == len(raw):
            return text.translate(font.letters)
    return "".join(font[raw[i : i + size]] for i in range(0, len(raw), size))


def read_pdf(data: bytes) -> list[Page]:
    """The pages of a file, in order."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    objects = {int(n): body for n, _, body in _OBJECT.findall(data)}
    if b"/Encrypt" in data:
        raise ValueError("the file is encrypted")
    root = re.search(rb"/Root\s+" + _REF, data)
    if not root or int(root[1]) not in objects:
        raise ValueError("the file has no catalogue in plain sight")
    out: list[Page] = []
    maps: dict[int, _Codes | None] = {}

    def mapped(font: int) -> _Codes | None:
        if font not in maps:
            to = _refs(objects.get(font, b""), b"ToUnicode")
            maps[font] = _codes(_stream(objects[to[0]])) if to else None
        return maps[font]

    def walk(n: int, box: bytes | None, resources: bytes) -> None:
        body = objects[n]
        size = re.search(rb"/MediaBox\s*\[([^\]]*)\]", body)
        box = size[1] if size else box
        held = _refs(body, b"Resources")
        resources = objects[held[0]] if held else body if b"/Resources" in body else resources
        if re.search(rb"/Type\s*/Pages\b", body):
            for kid in _refs(body, b"Kids"):
                walk(kid, box, resources)
            return
        x0, y0, x1, y1 = map(float, (box or b"0 0 612 792").split())
        fonts = {name: mapped(int(ref)) for name, ref in re.findall(rb"/(\w+)\s+" + _REF, resources) if re.search(rb"/Type\s*/Font\b", objects.get(int(ref), b""))}
        content = b"\n".join(_stream(objects[c]) for c in _refs(body, b"Contents"))
        out.append(Page(x1 - x0, y1 - y0, *_shown(content, fonts)))

    for tree in _refs(objects[int(root[1])], b"Pages"):
        walk(tree, None, b"")
    return out


#: Pages that a task passes on together, or fewer if their texts are long.
MOST_ROWS, MOST_LETTERS = 256, 1 << 20
PAGES = "doc_id long, page_index int, width_pt double, height_pt double, text string, hidden boolean, error string"


def pdf_pages(files: DataFrame) -> DataFrame:
    """Rows of PAGES of files (doc_id, content); a file that can't be read is one row with page_index -1 and its error."""
    kinds = to_arrow_schema(files.sparkSession.createDataFrame([], PAGES).schema)

    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    new = [(doc_id, i, p.width, p.height, p.text, p.hidden, None) for i, p in enumerate(read_pdf(content.as_py() or b""))]
                except (ValueError, KeyError, zlib.error, RecursionError) as e:
                    new = [(doc_id, -1, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                rows += new
                size += sum(len(r[4] or "") for r in new)
                if len(rows) >= MOST_ROWS or size >= MOST_LETTERS:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return files.select("doc_id", "content").mapInArrow(run, PAGES)
