"""Images as arrays: PNG and PGM, rules and grids, fills, masks, orientation, crops.

Everything here works on one page or crop, in memory; over many it runs in the tasks of ``over_pages``. An image is
an array of gray values, or of red, green and blue.
"""

from __future__ import annotations

import base64
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .engines import read_pgm

_MAGIC = b"\x89PNG\r\n\x1a\n"
Box = tuple[int, int, int, int]

# Gray levels below which there is ink, and sizes by which shapes are told apart, in pixels unless said otherwise.
INK, RULE_INK = 170, 180
#: Least lengths of rules as a part of the width and height, and in pixels; shares of the table that a separator crosses.
GRID_PARTS, GRID_LEAST, GRID_SHARES = (4, 8), 20, (0.5, 0.35)
#: Longest break of a separator, as a share of the narrowest cell beside the separators that cross it.
BREAK = 0.5
#: Spread of a colour, share of a filled cell.
COLORED, FILLED = 50, 0.3
#: How much larger the share of blank columns must be than that of blank rows before a page may be turned.
TURNED = 0.1


def read_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG without interlacing; transparency is laid over white, a palette resolved."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG image")
    at, packed, palette = 8, b"", None
    width = height = depth = kind = interlaced = 0
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed += body
        at += size + 12
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if depth != 8 or interlaced or not channels:
        raise ValueError("only 8-bit PNG images without interlacing are read")
    rows = np.frombuffer(zlib.decompress(packed, bufsize=max(1, height * (1 + width * channels))), np.uint8).reshape(height, 1 + width * channels)
    plain = rows[:, 1:] if not rows[:, 0].any() else _unfiltered(rows[:, 0], rows[:, 1:].astype(np.int64), channels).astype(np.uint8)
    out = plain.reshape(height, width, channels)
    if kind == 3:
        return palette[out[:, :, 0]]
    if kind in (4, 6):
        share = out[:, :, -1:] / 255
        out = np.rint(out[:, :, :-1] * share + 255 * (1 - share)).astype(np.uint8)
    return out[:, :, 0] if out.shape[2] == 1 else out


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    above = np.zeros(rows.shape[1], np.int64)
    for kind, row in zip(kinds.tolist(), rows):
        if kind == 2:
            row += above
        elif kind == 1:
            row[:] = np.cumsum(row.reshape(-1, step), 0).reshape(-1)
        elif kind:
            for i in range(len(row)):
                left = row[i - step] if i >= step else 0
                if kind == 3:
                    row[i] += (left + above[i]) // 2
                else:
                    corner = above[i - step] if i >= step else 0
                    guess = left + above[i] - corner
                    row[i] += min((abs(guess - left), 0, left), (abs(guess - above[i]), 1, above[i]), (abs(guess - corner), 2, corner))[2]
                row[i] &= 255
        row &= 255
        above = row
    return rows


def write_png(image: np.ndarray, level: int = -1) -> bytes:
    def part(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    height, width = image.shape[:2]
    rows = np.ascontiguousarray(image, np.uint8).reshape(height, -1)
    packed = zlib.compress(np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return _MAGIC + part(b"IHDR", head) + part(b"IDAT", packed) + part(b"IEND", b"")


def read_image(data: bytes, most_pixels: int = 40_000_000, most_side: int = 12_000) -> np.ndarray:
    """A PNG or PGM image within the limits of a page."""
    image = read_png(data) if data[:8] == _MAGIC else read_pgm(data)
    if image.shape[0] * image.shape[1] > most_pixels or max(image.shape[:2]) > most_side:
        raise ValueError("the image has too many pixels")
    return image


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def runs(mask: np.ndarray, least: int) -> np.ndarray:
    """What of the mask lies in horizontal runs of at least so many pixels."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    long = end - start >= least
    change = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    change[row[long], start[long]] = 1
    change[row[long], end[long]] = -1
    return np.cumsum(change, 1)[:, :-1] > 0


def run_sums(mask: np.ndarray, least: int) -> np.ndarray:
    """How many pixels of each row of the mask lie in horizontal runs of at least so many pixels."""
    height, width = mask.shape
    framed = np.zeros((height, width + 1), bool)
    framed[:, :width] = mask
    flat = framed.reshape(-1)
    # Each row ends with a pixel that isn't set, so runs begin and end in turn.
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    if len(flat) and flat[0]:
        edges = np.r_[0, edges]
    start, size = edges[::2], edges[1::2] - edges[::2]
    long = size >= least
    return np.bincount(start[long] // (width + 1), size[long], height).astype(np.int64)


def rules(mask: np.ndarray, across: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Horizontal and vertical rules of at least these lengths."""
    return runs(mask, across), runs(mask.T, down).T


def centers(counts: np.ndarray, threshold: float, gap: int = 4) -> list[float]:
    """Middles of the groups of places with a count above the threshold."""
    groups: list[list[int]] = []
    for at in np.flatnonzero(counts > threshold).tolist():
        if groups and at - groups[-1][-1] <= gap:
            groups[-1].append(at)
        else:
            groups.append([at])
    return [sum(g) / len(g) for g in groups]


#: Parts of a folded image, at most, that are gone through one by one.
FEW = 2048


class _Folded:
    """A mask whose equal neighbouring rows and columns are one each: drawings have few different ones."""

    def __init__(self, cells: list[list[bool]], tops: list[int], lefts: list[int]):
        #: tops and lefts: where each row and column begins, and the end.
        self.cells, self.tops, self.lefts = cells, tops, lefts

    def turned(self) -> _Folded:
        return _Folded(list(map(list, zip(*self.cells))), self.lefts, self.tops)

    def run_sums(self, least: int) -> list[int]:
        """``run_sums`` of each of the different rows."""
        out = []
        for row in self.cells:
            total, begin = 0, None
            for x, ink in zip(self.lefts, [*row, False]):
                if ink and begin is None:
                    begin = x
                elif not ink and begin is not None:
                    total += x - begin if x - begin >= least else 0
                    begin = None
            out.append(total)
        return out

    def centers(self, counts: list[int], threshold: float, gap: int = 4) -> list[float]:
        """``centers`` of counts of the different rows."""
        groups: list[list[int]] = []
        for n, a, b in zip(counts, self.tops, self.tops[1:]):
            if n > threshold:
                if not groups or a - groups[-1][2] > gap:
                    groups.append([0, 0, 0])
                # Sum, number and last of the places.
                groups[-1][:] = groups[-1][0] + (a + b - 1) * (b - a) // 2, groups[-1][1] + b - a, b - 1
        return [total / n for total, n, _ in groups]

    def longest_break(self, at: float, across: list[float]) -> float:
        """Of the rows around a place, the longest stretch between the ends of ``across`` in which none has ink."""
        low, high, left, right = max(0, int(at) - 3), int(at) + 4, int(across[0]), int(across[-1]) + 1
        first, last = bisect_right(self.lefts, left) - 1, bisect_left(self.lefts, right)
        rows = [r[first:last] for r in self.cells[bisect_right(self.tops, low) - 1 : bisect_left(self.tops, high)]]
        # Most separators have no break at all.
        if any(map(all, rows)):
            return 0.0
        longest, end = 0, left
        for ink, a, b in zip(map(any, zip(*rows)), self.lefts[first:], self.lefts[first + 1 :]):
            if ink:
                longest, end = max(longest, a - end), b
        return float(max(longest, min(right, self.lefts[-1]) - end))


def _folded(mask: np.ndarray) -> _Folded | None:
    """The folded mask, or None if it has too many parts, as scanned pages do."""
    if not mask.size:
        return None
    cuts = lambda differ: [0, *(np.flatnonzero(differ) + 1).tolist()]
    tops = cuts((mask[1:] != mask[:-1]).any(1))
    if len(tops) > FEW:
        return None
    rows = mask[tops]
    lefts = cuts((rows[:, 1:] != rows[:, :-1]).any(0))
    if len(tops) * len(lefts) > FEW:
        return None
    return _Folded(rows[:, lefts].tolist(), [*tops, mask.shape[0]], [*lefts, mask.shape[1]])


def grid(image: np.ndarray, dark: int = RULE_INK) -> tuple[list[float], list[float]]:
    """Where the columns and rows of a ruled table are parted, in pixels."""
    mask = gray(image) < dark
    return _parted(mask, _folded(mask))


def _parted(mask: np.ndarray, folded: _Folded | None) -> tuple[list[float], list[float]]:
    height, width = mask.shape
    across, down = max(GRID_LEAST, width // GRID_PARTS[0]), max(GRID_LEAST, height // GRID_PARTS[1])
    if folded is not None:
        turned = folded.turned()
        return turned.centers(turned.run_sums(down), height * GRID_SHARES[1]), folded.centers(folded.run_sums(across), width * GRID_SHARES[0])
    return centers(run_sums(mask.T, down), height * GRID_SHARES[1]), centers(run_sums(mask, across), width * GRID_SHARES[0])


def unbroken(image: np.ndarray, xs: list[float], ys: list[float], dark: int = RULE_INK) -> bool:
    """Whether no separator of a grid has a break as long as half of the narrowest cell it passes, so that no cells are merged."""
    mask = gray(image) < dark
    return _whole(mask, _folded(mask), xs, ys)


def whole_grid(image: np.ndarray, dark: int = RULE_INK) -> tuple[list[float], list[float], bool]:
    """``grid``, and whether it is there and ``unbroken``."""
    mask = gray(image) < dark
    folded = _folded(mask)
    xs, ys = _parted(mask, folded)
    return xs, ys, bool(xs and ys and _whole(mask, folded, xs, ys))


def _whole(mask: np.ndarray, folded: _Folded | None, xs: list[float], ys: list[float]) -> bool:
    def longest_break(lines: np.ndarray | _Folded, at: float, across: list[float]) -> float:
        if folded is not None:
            return lines.longest_break(at, across)
        strip = lines[max(0, int(at) - 3) : int(at) + 4, int(across[0]) : int(across[-1]) + 1].any(0)
        # Most separators have no break at all.
        if strip.all():
            return 0.0
        inked = np.flatnonzero(strip)
        return float(np.diff(np.r_[-1, inked, len(strip)]).max()) - 1

    level, upright = (mask, mask.T) if folded is None else (folded, folded.turned())
    sides = [(lines, places, across, BREAK * min(b - a for a, b in zip(across, across[1:]))) for lines, places, across in ((upright, xs, ys), (level, ys, xs)) if len(across) > 1]
    return all(longest_break(lines, at, across) < most for lines, places, across, most in sides for at in places)


def may_be_turned(image: np.ndarray, dark: int = INK) -> bool:
    """Whether blank lines run down the inked part of a page rather than across it; a gate before anything is read."""
    mask = gray(image) < dark
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows):
        return False
    blank = lambda at: 1 - len(at) / (at[-1] - at[0] + 1)
    return bool(blank(columns) > blank(rows) + TURNED)


def _hex(rgb: np.ndarray) -> str:
    return "#" + bytes(rgb.astype(np.uint8).tolist()).hex()


def fill_color(image: np.ndarray, least: int = COLORED, share: float = FILLED) -> str | None:
    """The colour that fills a cell, as #rrggbb; coloured letters alone are too few."""
    colored = image.max(2).astype(int) - image.min(2) > least
    return _hex(np.median(image[colored], 0)) if colored.mean() > share else None


def components(mask: np.ndarray) -> list[tuple[Box, int]]:
    """Boxes and pixels of the connected parts of a mask, diagonals too, by their first pixel."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    up = np.arange(len(row))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        a, b = first[y - 1], first[y]
        while a < first[y] and b < first[y + 1]:
            if start[a] <= end[b] and start[b] <= end[a]:
                x, z = root(a), root(b)
                up[max(x, z)] = min(x, z)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    found: dict[int, list[int]] = {}
    for i in range(len(row)):
        own = found.setdefault(root(i), [int(start[i]), int(row[i]), int(end[i]), int(row[i]) + 1, 0])
        own[:] = [min(own[0], int(start[i])), own[1], max(own[2], int(end[i])), max(own[3], int(row[i]) + 1), own[4] + int(end[i] - start[i])]
    return [((a, b, c, d), n) for a, b, c, d, n in found.values()]


def masked(image: np.ndarray, boxes: list[Box]) -> np.ndarray:
    """The image with white in place of the boxes."""
    out = image.copy()
    for x0, y0, x1, y1 in boxes:
        out[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = 255
    return out


def turn(upright: float, left: float, right: float, least: float = 40, gain: float = 1.7, lead: float = 1.35) -> int:
    """Clockwise degrees by which a page is to be turned, from the sure characters read as it is and turned by 90 either way."""
    best, other = max(left, right), min(left, right)
    if best < max(least, upright * gain) or best < other * lead:
        return 0
    return 270 if left > right else 90


def oriented(image: np.ndarray, read: Callable[[np.ndarray], float]) -> tuple[np.ndarray, int]:
    """The image, turned where that reads far better, and the clockwise degrees; ``read`` counts sure characters."""
    if not may_be_turned(image):
        return image, 0
    degrees = turn(read(image), read(np.rot90(image)), read(np.rot90(image, 3)))
    return (image if not degrees else np.rot90(image, 4 - degrees // 90)), degrees


class FailureLog:
    """What went wrong while reading, within bounds: so many events, and so many bytes of pictures."""

    def __init__(self, events: int = 100, size: int = 64 << 20):
        self.left, self.room, self.events = events, size, []

    def add(self, kind: str, picture: bytes = b"", **about: object) -> bool:
        """Whether the event was kept; a picture for which there is no room is left out."""
        if self.left <= 0:
            return False
        self.left -= 1
        kept = len(picture) <= self.room
        self.room -= len(picture) if kept else 0
        self.events.append({"kind": kind, **about, "picture": picture if kept else b""})
        return True


def padded(image: np.ndarray, least: int) -> np.ndarray:
    """A thin crop with white around it, so that a reader takes it."""
    more = [max(0, least - n) for n in image.shape[:2]]
    edges = [(m // 2, m - m // 2) for m in more] + [(0, 0)] * (image.ndim - 2)
    return np.pad(image, edges, constant_values=255)


def preview(image: np.ndarray, most_side: int, degrees: int = 0) -> str:
    """A smaller picture as a data address; every pixel is the mean of those it stands for."""
    image = np.rot90(image, (4 - degrees // 90) % 4)
    step = max(1, -(-max(image.shape[:2]) // most_side))
    height, width = (n // step * step for n in image.shape[:2])
    small = image[:height, :width].reshape(height // step, step, width // step, step, -1).mean((1, 3))
    small = np.rint(small).astype(np.uint8)
    return "data:image/png;base64," + base64.b64encode(write_png(small[:, :, 0] if small.shape[2] == 1 else small)).decode()


def crop(image: np.ndarray, box: Box, page: int, number: int) -> tuple[str, bytes]:
    """Name and PNG of a figure cut from its page."""
    x0, y0, x1, y1 = box
    part = image[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]
    if not part.size:
        raise ValueError("an empty figure")
    return f"p{page:03d}_fig{number:02d}.png", write_png(part)


def page_batches(batches: Iterator[pa.RecordBatch], run: Callable[[dict], list[tuple]], kinds: pa.Schema, most_rows: int = 1000, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows that ``run`` makes of each page, so many together, or fewer if their texts and images are large."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
    rows, size = [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            new = run({name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns)})
            rows += new
            size += sum(len(x) for row in new for x in row if isinstance(x, (str, bytes)))
            if rows and (len(rows) >= most_rows or size >= most_bytes):
                yield made(rows)
                rows, size = [], 0
    if rows:
        yield made(rows)


def over_pages(pages: DataFrame, run: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``run`` makes of each page (a dict of its columns); one page at a time is in memory."""
    kinds = to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)
    return pages.mapInArrow(lambda batches: page_batches(batches, run, kinds), schema)
