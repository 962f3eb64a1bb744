"""Queries on boxes, made from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..model import bridge as B
from ..model.bridge import sql
from ..operators import jobs, layout

W, H = 600.0, 800.0


def boxes(spark, d):
    return B.boxes(B.table(spark, d, "embeddings"))


def overlap(spark, d):
    a, b = G.of("a_"), G.of("b_")
    r = lambda c: F.round(c, 6)
    return boxes(spark, d).select("vec_id", r(G.iou(a, b)).alias("iou"), r(G.intersection(a, b)).alias("both"), r(G.area(a)).alias("area"), G.contains(a, b, 50.0).alias("contains"), G.within_page(a, F.lit(W), F.lit(H)).alias("in_page"))


def transforms(spark, d):
    a = G.of("a_")
    t = boxes(spark, d).withColumn("turn", F.col("vec_id") % 4 * 90)
    out = {"flip": G.flip(a, H), "scale": G.scale(a, F.lit(0.5), F.lit(2.0)), "rotate": G.rotate(a, W, H, F.col("turn")), "pixels": G.from_pixels(a, F.lit(144), H, F.col("vec_id") % 2 == 0), "moved": G.move(a, F.lit(3.0), F.lit(-4.0))}
    return t.select("vec_id", *[F.round(c[n], 4).alias(f"{k}_{n}") for k, c in out.items() for n in ("x0", "y0", "x1", "y1")])


def a4(spark, d):
    fit = G.a4_fit(F.col("a_x1") + 50, F.col("a_y1") + 50)
    return boxes(spark, d).select("vec_id", *[(F.round(fit[n], 4) + 0.0).alias(n) for n in ("width", "height", "scale", "dx", "dy")])


def regions(spark, d):
    thin = G.box(F.col("a_x0"), F.col("a_y0"), F.col("a_x1"), F.col("a_y0") + (F.col("vec_id") % 5) * 20)
    side = G.box(F.when(F.col("vec_id") % 2 == 0, 10).otherwise(560), F.col("b_y0"), F.when(F.col("vec_id") % 2 == 0, 40).otherwise(590), F.col("b_y1"))
    far = G.box(F.col("a_x0"), F.lit(760.0), F.col("a_x1"), F.lit(770.0))
    return boxes(spark, d).select("vec_id", G.margin_region(thin, W, H).alias("thin"), G.margin_region(side, W, H).alias("side"), G.margin_region(far, W, H).alias("far"))


def figures(spark, d):
    a = G.of("a_")
    crop = G.pixel_crop(a, W, H, F.lit(1200), F.lit(1600))
    return boxes(spark, d).select("vec_id", G.keeps_figure(a, W, H, F.lit(0)).alias("kept"), *[crop[n].cast("long").alias(n) for n in ("x0", "y0", "x1", "y1")])


def merged(spark, d):
    t = boxes(spark, d).select((F.floor(F.col("vec_id") / 10)).alias("page"), F.col("vec_id").alias("n"), F.col("a_x0").alias("x0"), F.col("a_y0").alias("y0"), F.col("a_x1").alias("x1"), F.col("a_y1").alias("y1"))
    return layout.merge_overlapping(t, ["page"], 0.3)


def even_cells(spark, d):
    c = G.even_cell(G.of("a_"), F.col("vec_id") % 3, F.col("vec_id") % 4, F.lit(3), F.lit(4))
    return boxes(spark, d).select("vec_id", *[F.round(c[n], 4).alias(n) for n in ("x0", "y0", "x1", "y1")])


def dpi(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", (200 + F.col("o_custkey") % 3000).cast("double").alias("w"), (100 + F.floor("o_totalprice") % 7000).cast("double").alias("h"))
    return o.select("o_orderkey", G.bounded_dpi(F.col("w"), F.col("h"), F.lit(600)).alias("dpi"))


def uploads(spark, d):
    p = B.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.element_at(F.array(*map(F.lit, (".PDF", ".png", ".exe", ".jpeg", "", ".tar.gz", ".webp"))), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("name"))
    return p.select("p_partkey", jobs.accepted_upload(F.col("name")).alias("accepted"))


def digests(spark, d):
    return B.table(spark, d, "pages").select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))


QUERIES = {"g01_overlap": overlap, "g03_figure_filter": figures, "g04_merged_boxes": merged, "g05_transforms": transforms, "g07_a4_fit": a4, "g08_margin_regions": regions, "g10_even_cells": even_cells, "s03_upload_names": uploads, "s04_digests": digests, "s07_bounded_dpi": dpi}

_N = ("x0", "y0", "x1", "y1")
_ROUND = ", ".join
_THIN, _SIDE, _FAR = (
    ("a_x0", "a_y0", "a_x1", "a_y0 + (vec_id % 5) * 20"),
    ("CASE WHEN vec_id % 2 = 0 THEN 10 ELSE 560 END", "b_y0", "CASE WHEN vec_id % 2 = 0 THEN 40 ELSE 590 END", "b_y1"),
    ("a_x0", "760", "a_x1", "770"),
)
_REGION = lambda x0, y0, x1, y1: f"CASE WHEN ({y1}) - ({y0}) <= 48 AND ({y0}) >= 696 THEN 'footer' WHEN ({y1}) - ({y0}) <= 48 AND ({y1}) <= 80 THEN 'header' WHEN ({y1}) - ({y0}) >= 200 AND ({x1}) - ({x0}) <= 42 AND ({x1}) <= 66 THEN 'left' WHEN ({y1}) - ({y0}) >= 200 AND ({x1}) - ({x0}) <= 42 AND ({x0}) >= 534 THEN 'right' END"
_TURN = {
    "x0": "CASE vec_id % 4 WHEN 0 THEN a_x0 WHEN 1 THEN 800 - a_y1 WHEN 2 THEN 600 - a_x1 ELSE a_y0 END",
    "y0": "CASE vec_id % 4 WHEN 0 THEN a_y0 WHEN 1 THEN a_x0 WHEN 2 THEN 800 - a_y1 ELSE 600 - a_x1 END",
    "x1": "CASE vec_id % 4 WHEN 0 THEN a_x1 WHEN 1 THEN 800 - a_y0 WHEN 2 THEN 600 - a_x0 ELSE a_y1 END",
    "y1": "CASE vec_id % 4 WHEN 0 THEN a_y1 WHEN 1 THEN a_x1 WHEN 2 THEN 800 - a_y0 ELSE 600 - a_x0 END",
}
_EXPR = (
    [(f"flip_{n}", e) for n, e in zip(_N, ("a_x0", "800 - a_y1", "a_x1", "800 - a_y0"))]
    + [(f"scale_{n}", e) for n, e in zip(_N, ("a_x0 * 0.5::DOUBLE", "a_y0 * 2", "a_x1 * 0.5::DOUBLE", "a_y1 * 2"))]
    + [(f"rotate_{n}", _TURN[n]) for n in _N]
    + [(f"pixels_{n}", e) for n, e in zip(_N, ("a_x0 / 2", "CASE WHEN vec_id % 2 = 0 THEN 800 - a_y1 / 2 ELSE a_y0 / 2 END", "a_x1 / 2", "CASE WHEN vec_id % 2 = 0 THEN 800 - a_y0 / 2 ELSE a_y1 / 2 END"))]
    + [(f"moved_{n}", e) for n, e in zip(_N, ("a_x0 + 3", "a_y0 - 4", "a_x1 + 3", "a_y1 - 4"))]
)
_BOTH = "greatest(0, least(a_x1, b_x1) - greatest(a_x0, b_x0)) * greatest(0, least(a_y1, b_y1) - greatest(a_y0, b_y0))"
_A, _B2 = "(a_x1 - a_x0) * (a_y1 - a_y0)", "(b_x1 - b_x0) * (b_y1 - b_y0)"
ORACLES = {
    "g01_overlap": sql(
        f"""SELECT vec_id, round(CASE WHEN {_A} + {_B2} - {_BOTH} = 0 THEN 0 ELSE {_BOTH} / ({_A} + {_B2} - {_BOTH}) END, 6) AS iou, round({_BOTH}, 6) AS both, round(greatest(0.01::DOUBLE, {_A}), 6) AS area,
  b_x0 >= a_x0 - 50 AND b_x1 <= a_x1 + 50 AND b_y0 >= a_y0 - 50 AND b_y1 <= a_y1 + 50 AS contains, a_x0 >= 0 AND a_x1 <= 600 AND a_y0 >= 0 AND a_y1 <= 800 AS in_page FROM boxes""",
        "boxes",
    ),
    "g03_figure_filter": sql(
        f"""SELECT vec_id, a_x1 - a_x0 >= 32 AND a_y1 - a_y0 >= 32 AND {_A} / 480000 >= 0.001 AND NOT (a_x1 - a_x0 >= 600 AND a_y1 - a_y0 >= 800) AS kept,
  greatest(0, floor(a_x0 * 2))::BIGINT AS x0, greatest(0, floor(a_y0 * 2))::BIGINT AS y0, least(1200, ceil(a_x1 * 2))::BIGINT AS x1, least(1600, ceil(a_y1 * 2))::BIGINT AS y1 FROM boxes""",
        "boxes",
    ),
    "g05_transforms": sql("SELECT vec_id, " + ", ".join(f"round({e}, 4) AS {n}" for n, e in _EXPR) + " FROM boxes", "boxes"),
    "g07_a4_fit": sql(
        """SELECT vec_id, round(w, 4) AS width, round(h, 4) AS height, round(least(w / pw, h / ph), 4) AS scale, round((w - pw * least(w / pw, h / ph)) / 2, 4) + 0 AS dx, round((h - ph * least(w / pw, h / ph)) / 2, 4) + 0 AS dy
FROM (SELECT *, CASE WHEN pw > ph THEN 297 * 72 / 25.4::DOUBLE ELSE 210 * 72 / 25.4::DOUBLE END AS w, CASE WHEN pw > ph THEN 210 * 72 / 25.4::DOUBLE ELSE 297 * 72 / 25.4::DOUBLE END AS h FROM (SELECT vec_id, a_x1 + 50 AS pw, a_y1 + 50 AS ph FROM boxes))""",
        "boxes",
    ),
    "g08_margin_regions": sql(f"SELECT vec_id, {_REGION(*_THIN)} AS thin, {_REGION(*_SIDE)} AS side, {_REGION(*_FAR)} AS far FROM boxes", "boxes"),
    "g10_even_cells": sql(
        "SELECT vec_id, round(a_x0 + vec_id % 4 * (a_x1 - a_x0) / 4, 4) AS x0, round(a_y0 + vec_id % 3 * (a_y1 - a_y0) / 3, 4) AS y0, round(a_x0 + (vec_id % 4 + 1) * (a_x1 - a_x0) / 4, 4) AS x1, round(a_y0 + (vec_id % 3 + 1) * (a_y1 - a_y0) / 3, 4) AS y1 FROM boxes",
        "boxes",
    ),
    "s03_upload_names": "SELECT p_partkey, lower(regexp_extract(p_name || ['.PDF', '.png', '.exe', '.jpeg', '', '.tar.gz', '.webp'][p_partkey % 7 + 1], '\\.([^.]+)$', 1)) IN ('pdf', 'png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp') AS accepted FROM part",
    "s04_digests": "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes FROM pages",
    "s07_bounded_dpi": """SELECT o_orderkey, max(s)::INT AS dpi FROM (
  SELECT o_orderkey, w, h, unnest(range(1, 601)) AS s FROM (SELECT o_orderkey, (200 + o_custkey % 3000)::DOUBLE AS w, (100 + floor(o_totalprice)::BIGINT % 7000)::DOUBLE AS h FROM orders))
WHERE s <= floor(least(600, 72 * sqrt(40000000 / (w * h)), 72 * 12000 / greatest(w, h))) AND ceil(w * s / 72) * ceil(h * s / 72) <= 40000000 AND greatest(ceil(w * s / 72), ceil(h * s / 72)) <= 12000 GROUP BY o_orderkey""",
}
