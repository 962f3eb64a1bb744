"""Images: formats, rules, bands, marks, masks, orientation."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.sources import pixels as P


def white(h, w):
    return np.full((h, w), 255, np.uint8)


def table(xs=(5, 60, 120), ys=(5, 40, 80), size=(90, 130)):
    image = white(*size)
    for x in xs:
        image[ys[0] : ys[-1] + 2, x : x + 2] = 0
    for y in ys:
        image[y : y + 2, xs[0] : xs[-1] + 2] = 0
    return image


@pytest.mark.parametrize("shape", [(3, 5), (4, 7, 3), (1, 1)])
def test_png_round_trip(shape):
    image = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert (P.read_png(P.write_png(image)) == image).all()


def test_png_filters_and_transparency():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (10, 6, 4)).astype(np.uint8)
    rows, above = b"", np.zeros(24, int)
    for y in range(10):
        kind, row = y % 5, image[y].reshape(-1).astype(int)
        left, corner = np.r_[np.zeros(4, int), row[:-4]], np.r_[np.zeros(4, int), above[:-4]]
        guess = left + above - corner
        paeth = np.where((abs(guess - left) <= abs(guess - above)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - above) <= abs(guess - corner), above, corner))
        rows += bytes([kind]) + bytes(((row - [0 * row, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8))
        above = row
    part = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
    share = image[:, :, 3:] / 255
    assert (P.read_png(data) == np.rint(image[:, :, :3] * share + 255 * (1 - share))).all()
    with pytest.raises(ValueError):
        P.read_image(data, most_pixels=59)


def test_grid_of_a_ruled_table():
    image = table()
    xs, ys = P.grid(image)
    assert xs == [5.5, 60.5, 120.5] and ys == [5.5, 40.5, 80.5] and P.unbroken(image, xs, ys)
    image[7:40, 58:64] = 255  # the upper cells are merged
    assert not P.unbroken(image, xs, ys)
    gap = table()
    gap[20:30, 58:64] = 255  # a flaw of the print, not a merged cell
    assert P.unbroken(gap, xs, ys)


def test_components_equal_a_flood_fill():
    mask = np.random.default_rng(2).random((30, 40)) < 0.4
    left, want = mask.copy(), []
    for y, x in zip(*np.nonzero(mask)):
        if left[y, x]:
            todo, seen = [(y, x)], []
            left[y, x] = False
            while todo:
                a, b = todo.pop()
                seen.append((a, b))
                for c in range(max(0, a - 1), min(30, a + 2)):
                    for d in range(max(0, b - 1), min(40, b + 2)):
                        if left[c, d]:
                            left[c, d] = False
                            todo.append((c, d))
            ys, xs = zip(*seen)
            want.append(((min(xs), min(ys), max(xs) + 1, max(ys) + 1), len(seen)))
    assert sorted(P.components(mask)) == sorted(want)


def test_fills_of_cells():
    image = white(60, 120)
    image[10:20, 10:60:2] = 0
    color = np.zeros((20, 20, 3), np.uint8) + np.array([200, 30, 30], np.uint8)
    assert P.fill_color(color) == "#c81e1e" and P.fill_color(np.repeat(image[:, :, None], 3, 2)) is None


def test_masks_and_crops():
    image = table()
    assert (P.masked(image, [(0, 0, 130, 90)]) == 255).all() and image.min() == 0
    cell = white(40, 60)
    cell[0:2], cell[:, 0:2], cell[18:24, 20:30] = 0, 0, 0
    name, data = P.crop(cell, (20, 18, 30, 24), 3, 1)
    assert name == "p003_fig01.png" and (P.read_png(data) == 0).all()
    with pytest.raises(ValueError):
        P.crop(cell, (70, 0, 80, 10), 1, 1)
    assert P.padded(cell[:5], 32).shape == (32, 60)
    assert (P.read_png(__import__("base64").b64decode(P.preview(cell, 30).split(",")[1])).shape) == (20, 30)


def page_of_text():
    image = white(400, 400)
    for y in range(20, 380, 20):
        for x in range(20, 380, 12):
            image[y : y + 10, x : x + 8] = 0
    return image


def test_orientation_needs_a_clear_gain():
    upright = page_of_text()
    assert not P.may_be_turned(upright) and not P.may_be_turned(white(400, 400))
    upright[:, 20:380][upright[:, 20:380] == 0] = 0
    lines = white(400, 400)
    for y in range(20, 380, 24):
        lines[y : y + 10, 20:380] = np.where(np.arange(360) % 9 < 8, 0, 255)
    assert P.may_be_turned(np.rot90(lines)) and not P.may_be_turned(lines)
    assert [P.turn(*x) for x in ((10, 100, 20), (10, 20, 100), (90, 100, 20), (0, 100, 90), (0, 30, 0))] == [270, 90, 0, 0, 0]
    reads = lambda i: 500.0 if (i == lines).all() else 3.0
    turned, degrees = P.oriented(np.rot90(lines), reads)
    assert degrees == 90 and (turned == lines).all()


def test_pages_in_tasks(spark):
    rows = [(i, P.write_png(table(xs=(5, 30 + i, 120)))) for i in range(5)]
    pages = spark.createDataFrame(rows, "page long, image binary")
    out = P.over_pages(pages, lambda p: [(p["page"], n, x) for n, x in enumerate(P.grid(P.read_image(p["image"]))[0])], "page long, at int, x double")
    assert {(r.page, r.x) for r in out.collect() if r["at"] == 1} == {(i, 30.5 + i) for i in range(5)}


def test_failures_within_bounds():
    log = P.FailureLog(events=2, size=5)
    assert log.add("a", b"1234", page=1) and log.add("b", b"1234") and not log.add("c")
    assert [(e["kind"], e["picture"]) for e in log.events] == [("a", b"1234"), ("b", b"")]


def test_frames_as_pages():
    from quire.sinks import pdf
    from quire.sources.pdf import read_pdf

    frames = [white(144, 72), np.zeros((10, 20, 3), np.uint8)]
    data = pdf.image_document(frames, 72)
    assert [(p.width, p.height, p.text) for p in read_pdf(data)] == [(72.0, 144.0, ""), (20.0, 10.0, "")] and data.count(b"/Subtype /Image") == 2


def test_sums_of_runs_equal_their_masks():
    rng = np.random.default_rng(9)
    for shape, share in (((0, 5), 0.5), ((1, 1), 1.0), ((7, 40), 0.9), ((30, 3), 0.6), ((20, 50), 0.97), ((4, 6), 1.0)):
        mask = rng.random(shape) < share
        for least in (1, 3, 20):
            assert P.run_sums(mask, least).tolist() == P.runs(mask, least).sum(1).tolist()
            assert P.run_sums(mask.T, least).tolist() == P.runs(mask.T, least).sum(1).tolist()


def test_pages_go_out_together():
    schema = pa.schema([("page", pa.int64()), ("size", pa.int64())])
    images = [P.write_png(table(xs=(5, 30 + i, 120))) for i in range(3)]
    pages = [pa.RecordBatch.from_pydict({"page": list(range(s, s + 500)), "image": [images[i % 3] for i in range(s, s + 500)]}) for s in (0, 500, 1000)]
    out = list(P.page_batches(iter(pages), lambda p: [(p["page"], len(p["image"]))], schema, most_rows=1000))
    assert [b.num_rows for b in out] == [1000, 500]
    assert [r for b in out for r in b.to_pylist()] == [{"page": i, "size": len(images[i % 3])} for i in range(1500)]
    assert [b.num_rows for b in P.page_batches(iter(pages[:1]), lambda p: [(p["page"], 1)] if p["page"] < 2 else [], schema, most_bytes=0)] == [1, 1]
