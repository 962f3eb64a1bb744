"""Checks on what was read back from exports: pages and texts of a PDF, objects of a DOCX, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import match
from .checks import judged, listed


def _row(name: str, status: Column, detail: Column) -> list[Column]:
    return ["doc_id", F.lit(name).alias("check"), status.alias("status"), detail.alias("detail")]


def pdf_checks(docs: DataFrame, files: DataFrame, pages: DataFrame, model_pages: DataFrame, model_words: DataFrame, fallback: DataFrame) -> DataFrame:
    """Four checks of each document's PDF: that it opens, shows its text, has all pages, and holds the model's words.

    files: doc_id, error (null if it was opened); pages: doc_id, page_index, text, hidden (text that isn't painted);
    model_pages: doc_id, page_index; model_words: doc_id, text; fallback: doc_id of documents with regions kept as images.
    A document whose PDF is missing or can't be read has the first check only.
    """
    opened = docs.select("doc_id").join(files.select("doc_id", "error", F.lit(True).alias("there")), "doc_id", "left")
    read = opened.filter("there AND error IS NULL").select("doc_id")
    found = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("hidden"), F.col("page_index") + 1))), 1, 10), lambda x: x.cast("string")), ", ").alias("hidden"), F.max((X.strip(X.or_empty(F.col("text"))) != "").cast("int")).alias("any"))
    wanted = model_pages.groupBy("doc_id").agg(F.count("*").alias("wanted"))
    facts = read.join(found, "doc_id", "left").join(wanted, "doc_id", "left").join(fallback.select("doc_id", F.lit(True).alias("fallback")), "doc_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    ok = F.col("there") & F.col("error").isNull()
    first = opened.join(found.select("doc_id", "n"), "doc_id", "left").select(
        *_row("searchable_pdf", F.when(ok, "PASS").otherwise("FAIL"), F.when(ok, F.concat(F.lit("pages read: "), number("n").cast("string"))).when(F.col("there"), F.concat(F.lit("not readable: "), "error")).otherwise("no file"))
    )
    painted = facts.select(*_row("visible_pdf_text", F.when(F.coalesce("hidden", F.lit("")) != "", "FAIL").otherwise("PASS"), F.when(F.coalesce("hidden", F.lit("")) != "", F.concat(F.lit("hidden text on pages "), "hidden")).otherwise("all text is painted")))
    same = number("n") == number("wanted")
    counted = facts.select(*_row("searchable_pages", F.when(same, "PASS").otherwise("FAIL"), F.concat(number("n").cast("string"), F.lit(" of "), number("wanted").cast("string"))))
    text = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_index", X.or_empty(F.col("text")).alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    matched = match.match_shares(model_words.select("doc_id", "text"), text, ["doc_id"])
    has_words = model_words.groupBy("doc_id").agg(F.coalesce(F.bool_or(X.first_word(F.col("text")) != ""), F.lit(False)).alias("has_words"))
    held = facts.join(matched, "doc_id", "left").join(has_words, "doc_id", "left")
    recall = F.when(F.coalesce("has_words", F.lit(False)), F.coalesce("recall", F.lit(0.0))).otherwise(1.0)
    empty, kept = F.coalesce("any", F.lit(0)) == 0, F.coalesce("fallback", F.lit(False))
    status = F.when(empty & kept, "WARN").when(empty, "FAIL").when(recall >= 0.5, "PASS").when(recall >= 0.2, "WARN").otherwise("FAIL")
    detail = F.when(empty & kept, "text is kept as images").when(empty, "no text").otherwise(F.concat(F.lit("words found of a thousand: "), F.floor(recall * 1000).cast("string")))
    return first.unionByName(painted).unionByName(counted).unionByName(held.select(*_row("searchable_text", status, detail)))


def docx_checks(docs: DataFrame, pages: DataFrame, canvases: DataFrame, objects: DataFrame, tables: DataFrame, wanted_tables: DataFrame, slack: float = 0.05) -> DataFrame:
    """docx_structure of each document: one canvas a page, objects placed on their page, tables that fit their frames.

    pages: doc_id, page_index, width_pt, height_pt; canvases: doc_id, n (paragraphs that hold a page's objects), sections, body_tables;
    objects: doc_id, page_index, object_id, name, from_page (placed from the page's corner), x, y, width, height in points;
    tables: doc_id, page_index, table_no, exact (all row heights are fixed), rows, row_sum (points), border (points of an inner
    rule), frame_height; wanted_tables: doc_id, n. A document without canvases has no file.
    """
    count = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    sums = docs.select("doc_id").join(canvases, "doc_id", "left").join(count, "doc_id", "left").join(tables.groupBy("doc_id").agg(F.count("*").alias("n_tables")), "doc_id", "left").join(wanted_tables.select("doc_id", F.col("n").alias("wanted")), "doc_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), F.lit("no file")),
            F.when(F.col("sections") != n("pages"), F.lit("sections differ from pages")),
            F.when(F.col("n") != n("pages"), F.lit("canvases differ from pages")),
            F.when(F.col("body_tables") > 0, F.lit("a table stands outside the canvases")),
            F.when(F.col("n").isNotNull() & (n("n_tables") != n("wanted")), F.lit("tables differ from the model's")),
        )
    )
    of = lambda rows, problems, place: rows.select("doc_id", F.lit(1).alias("part"), *place, F.explode(problems).alias("message"))
    page = F.concat(F.lit("page "), (F.col("page_index") + 1).cast("string"), F.lit(": "))
    placed = objects.join(pages, ["doc_id", "page_index"])
    out = (F.least("x", "y") < -slack) | (F.col("x") + F.col("width") > F.col("width_pt") + slack) | (F.col("y") + F.col("height") > F.col("height_pt") + slack)
    loose = F.array_compact(F.array(F.when(~F.col("from_page"), F.concat(page, F.col("name"), F.lit(" isn't placed from the page"))), F.when(out, F.concat(page, F.col("name"), F.lit(" lies off the page")))))
    place = [F.col("page_index").cast("int").alias("page_index"), F.col("name").alias("at")]
    # Neighbouring rows share a rule: one for each row, and a point of room.
    needed = F.col("row_sum") + F.col("rows") * F.col("border") + 1
    grids = F.array_compact(F.array(F.when(~F.col("exact"), F.concat(page, F.lit("a row may grow"))).when(needed > F.col("frame_height") + 0.1, F.concat(page, F.lit("a table is taller than its frame")))))
    twice = objects.groupBy("doc_id", "object_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id").distinct()
    found = of(placed, loose, place).unionByName(of(tables, grids, [F.col("page_index").cast("int").alias("page_index"), F.col("table_no").cast("string").alias("at")]))
    found = found.unionByName(twice.select("doc_id", F.lit(2).alias("part"), F.lit(0).alias("page_index"), F.lit("").alias("at"), F.lit("objects share an id").alias("message")))
    found = found.unionByName(sums.select("doc_id", F.lit(0).alias("part"), F.posexplode(whole).alias("page_index", "message")).select("doc_id", "part", "page_index", F.lit("").alias("at"), "message"))
    fine = F.lit("pages, objects and tables are in place")
    return judged(docs, listed(found, F.col("message"), ["part", "page_index", "at"]), "docx_structure", "FAIL", fine)


def word_bands(bands: DataFrame, key: list[str]) -> DataFrame:
    """The bands of ink of a cell (key, band, ink, n_words) that may be its lines: no more than it has words, the blackest, in place."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ink"), "band"))
    count = F.count("*").over(Window.partitionBy(*key))
    limit = F.when(F.col("n_words") > 0, F.least("n_words", count)).otherwise(count)
    return bands.withColumn("_rank", rank).withColumn("_limit", limit).filter("_rank <= _limit").drop("_rank", "_limit")
