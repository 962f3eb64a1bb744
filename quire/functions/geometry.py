"""Boxes as columns: structs of x0, y0, x1, y1 in points, origin at the top left."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A4 = (210 * 72 / 25.4, 297 * 72 / 25.4)


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))])


def of(prefix: str = "") -> Column:
    """The box in columns <prefix>x0 and so on."""
    return box(*[F.col(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1")])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column, least: float = 0.01) -> Column:
    return F.greatest(F.lit(least), width(b) * height(b))


def intersection(a: Column, b: Column) -> Column:
    across = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return across * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = width(a) * height(a) + width(b) * height(b) - both
    return F.when(union == 0, 0.0).otherwise(both / F.when(union != 0, union))


def contains(outer: Column, inner: Column, slack: float = 0.0) -> Column:
    return (inner["x0"] >= outer["x0"] - slack) & (inner["x1"] <= outer["x1"] + slack) & (inner["y0"] >= outer["y0"] - slack) & (inner["y1"] <= outer["y1"] + slack)


def grow(b: Column, by: float) -> Column:
    """The box and what lies up to ``by`` around it."""
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)


def within_page(b: Column, page_width: Column, page_height: Column) -> Column:
    return contains(box(F.lit(0), F.lit(0), page_width, page_height), b) & (b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"])


def flip(b: Column, page_height: Column) -> Column:
    """From an origin at the bottom left to one at the top left, or back."""
    return box(b["x0"], page_height - b["y1"], b["x1"], page_height - b["y0"])


def scale(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def move(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def rotate(b: Column, page_width: Column, page_height: Column, angle: Column) -> Column:
    """By a multiple of 90 degrees; null for other angles."""
    turn = F.pmod(angle, F.lit(360))
    return (
        F.when(turn == 0, b)
        .when(turn == 90, box(page_height - b["y1"], b["x0"], page_height - b["y0"], b["x1"]))
        .when(turn == 180, box(page_width - b["x1"], page_height - b["y1"], page_width - b["x0"], page_height - b["y0"]))
        .when(turn == 270, box(b["y0"], page_width - b["x1"], b["y1"], page_width - b["x0"]))
    )


def from_pixels(b: Column, dpi: Column, page_height: Column, bottom_left: Column) -> Column:
    """A box in pixels of a raster, in either origin, to points."""
    points = scale(b, 72.0 / dpi, 72.0 / dpi)
    return F.when(bottom_left, flip(points, page_height)).otherwise(points)


def keeps_figure(b: Column, page_width: Column, page_height: Column, blocks: Column, least=(32, 32), share: float = 0.001) -> Column:
    """Whether a figure is large enough, and no bare page."""
    big = (width(b) >= least[0]) & (height(b) >= least[1]) & (width(b) * height(b) / (page_width * page_height) >= share)
    return big & ~((width(b) >= page_width) & (height(b) >= page_height) & (blocks == 0))


def pixel_crop(b: Column, page_width: Column, page_height: Column, image_width: Column, image_height: Column) -> Column:
    """Whole pixels that cover the box, within the image."""
    sx, sy = image_width / page_width, image_height / page_height
    return F.struct(
        F.greatest(F.lit(0), F.floor(b["x0"] * sx)).alias("x0"),
        F.greatest(F.lit(0), F.floor(b["y0"] * sy)).alias("y0"),
        F.least(image_width, F.ceil(b["x1"] * sx)).cast("long").alias("x1"),
        F.least(image_height, F.ceil(b["y1"] * sy)).cast("long").alias("y1"),
    )


def margin_region(b: Column, page_width: Column, page_height: Column) -> Column:
    """header, footer, left, right or null: where repeated page furniture stands."""
    flat, tall = height(b) <= page_height * 0.06, (height(b) >= page_height * 0.25) & (width(b) <= page_width * 0.07)
    return (
        F.when(flat & (b["y0"] >= page_height * 0.87), "footer")
        .when(flat & (b["y1"] <= page_height * 0.10), "header")
        .when(tall & (b["x1"] <= page_width * 0.11), "left")
        .when(tall & (b["x0"] >= page_width * 0.89), "right")
    )


def a4_fit(page_width: Column, page_height: Column) -> Column:
    """Size of the A4 page that takes the page, and scale and offsets that centre it there."""
    wide = page_width > page_height
    w, h = F.when(wide, A4[1]).otherwise(A4[0]), F.when(wide, A4[0]).otherwise(A4[1])
    s = F.least(w / page_width, h / page_height)
    return F.struct(w.alias("width"), h.alias("height"), s.alias("scale"), ((w - page_width * s) / 2).alias("dx"), ((h - page_height * s) / 2).alias("dy"))


def even_cell(table: Column, row: Column, col: Column, rows: Column, cols: Column) -> Column:
    """The box of a cell in a table of equal rows and columns."""
    w, h = width(table) / cols, height(table) / rows
    return box(table["x0"] + col * w, table["y0"] + row * h, table["x0"] + (col + 1) * w, table["y0"] + (row + 1) * h)


def bounded_dpi(page_width: Column, page_height: Column, dpi: Column, max_pixels: int = 40_000_000, max_side: int = 12_000) -> Column:
    """The largest whole resolution, at most dpi, whose raster keeps both limits; null if none does.

    Rounding up to whole pixels costs one step, or rarely a few, below the resolution that exact sides allow.
    """
    allowed = F.least(dpi.cast("double"), 72 * F.sqrt(F.lit(max_pixels) / (page_width * page_height)), 72.0 * max_side / F.greatest(page_width, page_height))
    top = F.floor(allowed).cast("int")
    # A side of s pixels grows by less than one, so the product by less than two sides: some steps always make up for it.
    steps = F.sequence(F.greatest(F.lit(1), top - 100), F.greatest(F.lit(1), top))
    w, h = (lambda d: F.ceil(page_width * d / 72)), (lambda d: F.ceil(page_height * d / 72))
    fits = F.filter(steps, lambda d: (w(d) * h(d) <= max_pixels) & (F.greatest(w(d), h(d)) <= max_side))
    usable = (page_width > 0) & (page_height > 0) & (dpi > 0) & (page_width < math.inf) & (page_height < math.inf)
    return F.when(usable & (top >= 1), F.array_max(fits))
