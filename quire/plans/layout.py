"""Queries on the layout of pages: lines of documents as blocks, with a running header."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..model import bridge as B
from ..model.bridge import sql
from ..operators import layout as L
from ..operators import match, typography
from ..sources.scratch import kept

PAGE = L.PAGE
KEY = [*PAGE, "block_id"]


def blocks(spark, d):
    return B.with_headers(B.blocks(B.table(spark, d, "documents")))


#: Documents of a task, about, where they are dealt by document: what is made of a text is many times as large, so tasks go by documents, not by bytes.
DEALT = 8192


def dealt(spark, d):
    """The blocks, dealt by document before they are made: a text is shuffled once, and what is grouped by document or page stays where it is."""
    documents = B.table(spark, d, "documents").select("doc_id", "source", "text")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // DEALT))
    return B.with_headers_in_place(B.blocks(documents.repartition(tasks, "doc_id")))


def ordered(spark, d):
    return L.reading_order(blocks(spark, d))


def dealt_in_order(spark, d):
    """``ordered``, dealt by document. Not for plans that put several such tables together: see ``bridge.with_headers_in_place``."""
    return L.reading_order(dealt(spark, d))


def reading_order(spark, d):
    return ordered(spark, d).select(*KEY, "page_column", "ord")


def captions(spark, d):
    return L.attach_captions(ordered(spark, d))


def leaks(spark, d):
    """Figures are enlarged, so that some hold the text below them."""
    t = ordered(spark, d).withColumn("y1", F.when(F.col("type") == "figure", F.col("y1") + 36).otherwise(F.col("y1"))).withColumn("x1", F.when(F.col("type") == "figure", F.col("x0") + 300).otherwise(F.col("x1")))
    return L.figure_leaks(t)


def with_echoes(spark, d):
    """Each fifth pair of neighbouring lines is also there as one block over both."""
    o = dealt_in_order(spark, d)
    from pyspark.sql import Window

    after = Window.partitionBy("doc_id", "page_index", "page_column").orderBy("y0", "x0", "block_id")
    nxt = o.withColumn("next_text", F.lead("text").over(after)).withColumn("ny1", F.lead("y1").over(after)).withColumn("nx1", F.lead("x1").over(after))
    echo = {"block_id": F.concat(F.lit("e"), "block_id"), "type": F.lit("text"), "text": F.concat_ws(" ", "text", "next_text"), "y1": F.col("ny1"), "x1": F.greatest("x1", "nx1"), "ord": F.col("ord") + 1000}
    return _both(nxt, {c: echo.get(c, F.col(c)) for c in o.columns}, F.expr("i % 5 = 1 AND next_text IS NOT NULL AND text IS NOT NULL"), o)


def _both(rows, other, asked, like):
    """The columns of ``like`` of each row, and, where ``asked``, those of ``other`` as a row beside it: no union, so rows stay where they are dealt."""
    kinds = {f.name: f.dataType for f in like.schema.fields}
    row = lambda of: F.struct(*[of[c].cast(kinds[c]).alias(c) for c in kinds])
    spread = rows.select("doc_id", F.explode(F.array_compact(F.array(row({c: F.col(c) for c in kinds}), F.when(asked, row(other))))).alias("b"))
    return spread.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"b.{c}").alias(c) for c in kinds])


def echoes(spark, d):
    return L.echoes(with_echoes(spark, d), dealt=True)


def duplicates(spark, d):
    return L.contained_duplicates(with_echoes(spark, d), dealt=True)


def margins(spark, d):
    return L.repeated_margins(ordered(spark, d), B.PAGE_HEIGHT, B.PAGE_WIDTH)


def postprocessed(spark, d):
    o = ordered(spark, d)
    typed = o.join(margins(spark, d), KEY, "left").withColumn("type", F.coalesce("new_type", "type")).drop("new_type")
    kept = L.renumber(L.postprocess(typed.withColumn("text", F.when(F.col("type") != "figure", F.col("noisy")))))
    return kept.select(*KEY, "ord", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))


def line_groups(spark, d):
    t = blocks(spark, d).select(*PAGE, "block_id", (F.col("y0") + F.col("i") % 3).alias("y")).groupBy(*PAGE, "y").agg(F.count("*").alias("n"))
    return L.run_groups(t, PAGE, "y", 17.5).select(*PAGE, "y", "n", "run")


def ocr_lines(spark, d):
    """Recognised lines: the blocks, shifted, of which many lie where no block is."""
    return lines_of(blocks(spark, d))


def lines_of(t):
    return t.filter("type <> 'figure'").select(*PAGE, *_line())


def _line():
    dy, dx = F.when(F.col("i") % 4 == 0, 6.0).when(F.col("i") % 4 == 1, 260.0).otherwise(0.0), F.when(F.col("i") % 4 == 2, 5.0).otherwise(0.0)
    return (F.col("i") + 1).alias("line_no"), F.col("text"), F.greatest("confidence", F.lit(0.5)).alias("confidence"), (F.col("x0") + dx).alias("x0"), (F.col("y0") + dy).alias("y0"), (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1")


def recovered(spark, d):
    placed = ordered(spark, d).select(*KEY, "type", "text", "ord", "x0", "y0", "x1", "y1")
    return L.recover_lines(kept(placed, "ordered"), kept(ocr_lines(spark, d), "lines"), B.PAGE_HEIGHT, step=kept)


def refined(spark, d):
    from ..operators.refine import refined_in_place

    o = dealt_in_order(spark, d).select(*KEY, "type", "text", "i", "x0", "y0", "x1", "y1")
    block = F.struct(*[c for c in o.columns if c != "i"])
    line = F.when(F.col("type") != "figure", F.struct(*_line()).withField("confidence", F.lit(0.96)))
    both = o.withColumn("confidence", F.lit(0.96)).select("doc_id", "page_index", F.inline(F.array(F.struct(block.alias("block"), F.lit(None).alias("line")), F.struct(F.lit(None).alias("block"), line.alias("line")))))
    return refined_in_place(both).select(*KEY, "refined", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))


def pushed(spark, d):
    size = F.lit(11.0)
    needed = F.greatest(F.col("y1") - F.col("y0"), F.when(F.col("type") != "figure", typography.text_height(F.col("text"), F.col("x1") - F.col("x0"), size)).otherwise(0.0))
    return L.push_down(dealt_in_order(spark, d).withColumn("needed", needed)).withColumn("top", F.round("top", 4))


def units(spark, d):
    cells = B.cells(B.table(spark, d, "lineitem")).select(F.col("table_id").alias("doc_id"), F.lit(0).alias("page_index"), F.lit("t0").alias("block_id"), "row", "col", "text")
    return match.units(blocks(spark, d), cells).select("doc_id", "unit_id", "page", F.length("text").alias("chars"))


def ir_words(spark, d):
    from ..functions import text as X

    words = X.words(F.col("text"))
    w = ordered(spark, d).select("doc_id", F.struct("page_index", "ord", words.alias("w")).alias("x"))
    lists = w.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["w"])).alias("words"))
    return lists.select("doc_id", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ")).alias("md5"))


def batches(spark, d):
    t = blocks(spark, d).filter("text IS NOT NULL").select("doc_id", "page_index", "block_id", "text")
    packed = match.pack(t, ["doc_id"], ["page_index", "block_id"], 400)
    checked = packed.select("doc_id", "batch").distinct()
    from ..operators.jobs import first_per_budget

    return first_per_budget(checked, ["doc_id"], ["batch"], 20).groupBy("doc_id").agg(F.count("*").alias("batches"), F.count_if("checked").alias("checked"))


def blank_fields(spark, d):
    """Rules of forms within lines: what is left of a line beside them."""
    from ..operators.refine import reserve_gaps

    lines = blocks(spark, d).filter("type = 'text' AND x1 - x0 > 60").select(*PAGE, F.col("block_id").alias("line_id"), "x0", "y0", "x1", "y1")
    rules = blocks(spark, d).filter("type = 'text' AND x1 - x0 > 60 AND i % 3 = 0").select(*PAGE, (F.col("x0") + 20).alias("x0"), (F.col("y0") + 10).alias("y0"), (F.col("x0") + 50).alias("x1"), (F.col("y0") + 11).alias("y1"))
    return reserve_gaps(lines, rules)


def typography_standard(spark, d):
    runs = blocks(spark, d).filter("text IS NOT NULL").select(F.col("type").alias("role"), F.when(F.col("i") % 9 == 0, "Arial").otherwise("Times").alias("family"), (10.0 + F.col("i") % 3).alias("size"), (F.col("i") % 2 == 0).alias("bold"), F.lit(False).alias("italic"), "text")
    return typography.standard(runs).select("role", "family", "size", "bold", "italic", F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"))


def typography_fit(spark, d):
    runs = blocks(spark, d).filter("text IS NOT NULL")
    profile = typography.standard(runs.select(F.col("type").alias("role"), F.lit("Times").alias("family"), (10.0 + F.col("i") % 3).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), "text"))
    return typography.fit(runs.select(*KEY, F.col("type").alias("role"), "text", "x0", "x1"), profile).select(*KEY, "size_pt", "overflow")


def style_review(spark, d):
    t = blocks(spark, d).select("doc_id", "page_index", "block_id", (F.col("i") + 2).alias("line_id"), F.when(F.col("i") % 3 == 2, F.col("i") + 1).alias("parent_line_id"), "text", (F.col("i") % 4 == 0).alias("review_required"), F.when(F.col("i") % 8 == 0, "glyphs").alias("review_reason"))
    return typography.review_items(t, ["doc_id", "page_index"]).select("doc_id", "page_index", "line_id", "reason")


def unreadable(spark, d):
    from ..operators.refine import unreadable_blocks

    return unreadable_blocks(blocks(spark, d).withColumn("text", F.when(F.col("type") != "figure", F.col("noisy"))), B.PAGE_WIDTH, B.PAGE_HEIGHT)


QUERIES = {
    "w01_reading_order": reading_order,
    "w02_postprocess": postprocessed,
    "w03_repeated_margins": margins,
    "w04_push_down": pushed,
    "w06_line_groups": line_groups,
    "w08_review_batches": batches,
    "j01_captions": captions,
    "j02_recovered_lines": recovered,
    "j04_refined_blocks": refined,
    "j05_figure_leaks": leaks,
    "j06_contained_duplicates": duplicates,
    "j07_echoes": echoes,
    "j11_blank_fields": blank_fields,
    "x23_review_units": units,
    "x24_model_words": ir_words,
    "a05_typography_standard": typography_standard,
    "p03_typography_fit": typography_fit,
    "p05_style_review": style_review,
    "p07_unreadable": unreadable,
}

ORDERED = """cols AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id, page_index ORDER BY x0, y0, block_id)::INT AS page_column FROM (
    SELECT *, CASE WHEN x0 > max(x1) OVER (PARTITION BY doc_id, page_index ORDER BY x0, y0, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 18 THEN 1 ELSE 0 END AS opens FROM all_blocks)
), ordered AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, page_index ORDER BY page_column, y0, x0, block_id) - 1)::INT AS ord FROM cols
)"""
B.SQL["ordered"] = ORDERED
_ALL = ("blocks", "all_blocks", "ordered")
CAPTIONS = """pairs AS (
  SELECT c.doc_id, c.page_index, c.block_id AS caption_id, c.ord AS caption_ord, f.block_id AS figure_id, f.ord AS figure_ord, CASE WHEN c.y1 <= f.y0 THEN f.y0 - c.y1 ELSE c.y0 - f.y1 END AS gap
  FROM ordered c JOIN ordered f ON c.doc_id = f.doc_id AND c.page_index = f.page_index AND c.type = 'caption' AND f.type = 'figure' AND abs(c.x0 - f.x0) <= greatest(c.x1 - c.x0, f.x1 - f.x0)
), links AS (
  SELECT doc_id, page_index, figure_id, caption_id FROM (SELECT * FROM pairs WHERE gap BETWEEN 0 AND 48 QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, caption_id ORDER BY gap, figure_ord) = 1)
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, figure_id ORDER BY caption_ord DESC) = 1
)"""
B.SQL["links"] = CAPTIONS
ORACLES = {
    "w01_reading_order": sql("SELECT doc_id, page_index, block_id, page_column, ord FROM ordered", *_ALL),
    "w06_line_groups": sql(
        """SELECT doc_id, page_index, y, n, (sum(opens) OVER (PARTITION BY doc_id, page_index ORDER BY y) - 1)::INT AS run FROM (
  SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page_index ORDER BY y) <= 17.5 THEN 0 ELSE 1 END AS opens FROM (
    SELECT doc_id, page_index, y0 + i % 3 AS y, count(*) AS n FROM all_blocks GROUP BY ALL))""",
        "blocks",
        "all_blocks",
    ),
    "j01_captions": sql("SELECT * FROM links", *_ALL, "links"),
    "j05_figure_leaks": sql(
        r"""SELECT a.doc_id, a.page_index, a.block_id, arg_min(f.block_id, f.ord) AS figure_id FROM ordered a JOIN ordered f ON a.doc_id = f.doc_id AND a.page_index = f.page_index AND f.type = 'figure'
  AND a.type NOT IN ('figure', 'caption') AND regexp_matches(a.text, '\S') AND a.x0 >= f.x0 - 2 AND a.x1 <= f.x0 + 302 AND a.y0 >= f.y0 - 2 AND a.y1 <= f.y1 + 38 GROUP BY ALL""",
        *_ALL,
    ),
    "x23_review_units": sql(
        """SELECT doc_id, 'p' || (page_index + 1) || ':' || block_id AS unit_id, page_index + 1 AS page, length(text)::INT AS chars FROM all_blocks WHERE coalesce(text, '') <> ''
UNION ALL SELECT table_id, 'p1:t0:c' || row || ',' || col, 1, length(text)::INT FROM cells""",
        "blocks",
        "all_blocks",
        "cells",
    ),
    "x24_model_words": sql(
        r"""SELECT doc_id, sum(len(w))::BIGINT AS n, md5(array_to_string(flatten(list(w ORDER BY page_index, ord)), ' ')) AS md5
FROM (SELECT doc_id, page_index, ord, regexp_extract_all(replace(lower(coalesce(text, '')), 'ё', 'е'), '[\p{L}\p{N}_]+') AS w FROM ordered) GROUP BY doc_id""",
        *_ALL,
    ),
    "a05_typography_standard": sql(
        """, w AS (SELECT type AS role, CASE WHEN i % 9 = 0 THEN 'Arial' ELSE 'Times' END AS family, 10.0::DOUBLE + i % 3 AS size, i % 2 = 0 AS bold, sum(length(text)) AS weight FROM all_blocks WHERE regexp_matches(text, '\\S') GROUP BY ALL
), r AS (SELECT *, sum(weight) OVER (PARTITION BY role) AS total, row_number() OVER (PARTITION BY role ORDER BY weight DESC, family, size, bold) AS rank FROM w)
SELECT b.role, b.family, b.size, b.bold, false AS italic, (SELECT array_to_string(list_sort(list(DISTINCT o.size::VARCHAR)), ',') FROM r o WHERE o.role = b.role AND o.family = b.family AND o.bold = b.bold AND (o.weight >= o.total * 0.05 OR o.size = b.size)) AS sizes FROM r b WHERE rank = 1""".lstrip(),
        "blocks",
        "all_blocks",
    ).replace(")\n, w AS", "),\nw AS"),
    "p05_style_review": sql(
        """SELECT l.doc_id, l.page_index, l.i + 2 AS line_id, max(r.reason) AS reason
FROM all_blocks l JOIN (SELECT *, CASE WHEN i % 8 = 0 THEN 'glyphs' ELSE 'check the formatting' END AS reason FROM all_blocks WHERE i % 4 = 0) r
  ON l.doc_id = r.doc_id AND l.page_index = r.page_index AND l.i % 3 <> 2 AND (r.i = l.i AND r.i % 3 <> 2 OR r.i % 3 = 2 AND r.i = l.i + 1) GROUP BY l.doc_id, l.page_index, l.i""",
        "blocks",
        "all_blocks",
    ),
}
